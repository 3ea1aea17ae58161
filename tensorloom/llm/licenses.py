"""Operator 2: licence scans by Dice coefficient over word bigrams, in DataFrame functions only.

Text is normalised to lower-case runs of letters and digits.  A document's segments (each line, and
the whole text) are compared with licence templates: Dice = 2 * shared / (own + template's) over
sets of adjacent word pairs.  Dice >= t bounds the sizes: shared can't exceed the smaller set, so
own * t / (2 - t) <= template's <= own * (2 - t) / t.  It also bounds what may be missing: a match
holds at least ceil(t / (2 - t) * B) of the template's B pairs, so it holds one of any
B - that + 1 of them; those with the longest words are the keys by which segments find templates.
Every key holds one of a few long words, and texts without any of these are passed over.

Notices wrapped over several lines inside a longer text are found as runs of lines.  For a template
of W words, the run that begins at a line ends with the line where W words are reached (or with the
text); so each line begins one run per template, and none of more than 2 W words is compared.
"""

from __future__ import annotations

import json
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

THRESHOLD = 0.8

# Public licence notices, headers and short licences, as they are commonly quoted.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "BSD": (
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Licensed under CC0 1.0 Universal.", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
}


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


# Words that any English text has: poor keys.
COMMON = {"a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "not", "of", "on", "or", "that", "the", "this", "to", "under", "with", "you"}


def _weight(word: str) -> int:
    return 0 if word in COMMON else len(word)


def prepared(templates: dict[str, tuple[str, ...]], threshold: float) -> tuple[list[tuple], list[str]]:
    """Rows (license, template_no, pairs, keys), and the words of which every key holds one.

    Any B - least + 1 of a template's pairs may be its keys, so they are taken by few words that all
    templates share: words are chosen greedily until each template has as many pairs with one of them.
    """
    named = [(name, no, sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})) for name, texts in templates.items() for no, w in enumerate(map(words_of, texts))]
    needed = [len(pairs) - math.ceil(threshold / (2 - threshold) * len(pairs) - 1e-9) + 1 for _, _, pairs in named]
    holding: dict[str, dict[int, set[str]]] = {}
    for t, (_, _, pairs) in enumerate(named):
        for pair in pairs:
            for w in pair.split():
                holding.setdefault(w, {}).setdefault(t, set()).add(pair)
    chosen: list[str] = []
    covered: list[set[str]] = [set() for _ in named]

    def gain(w: str) -> int:
        return sum(max(0, min(needed[t] - len(covered[t]), len(own - covered[t]))) for t, own in holding[w].items())

    # long words are rare in other text; short ones serve where a template has too few of those
    for pool in ([w for w in holding if _weight(w) >= 6], [w for w in holding if 0 < _weight(w) < 6], list(holding)):
        while best := max(pool, key=lambda w: (gain(w), _weight(w), w), default=""):
            if not gain(best):
                break
            chosen.append(best)
            for t, own in holding[best].items():
                covered[t] |= own
    rows = []
    for t, (name, no, pairs) in enumerate(named):
        by_length = sorted(covered[t], key=lambda p: (-max(map(_weight, p.split())), p))
        rows.append((name, no, pairs, by_length[: needed[t]]))
    return rows, chosen


def normalized(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


#: Lines that are handled as one row while runs are made: bounds rows, not results.
CHUNK = 512


def _adjacent(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that later filters and lambdas read, rather than repeat its making: nothing is pushed below a generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _dice(w: Column, pairs: Column) -> Column:
    # bound as a lambda's argument, the pairs are made once
    own = F.array(F.array_distinct(_adjacent(w)))
    return F.get(F.transform(own, lambda o: 2 * F.size(F.array_intersect(o, pairs)) / F.greatest(F.size(o) + F.size(pairs), F.lit(1))), F.lit(0))


def runs(some: DataFrame, rows: list[tuple], words: dict[tuple[str, int], int], threshold: float) -> DataFrame:
    """(id, license, dice, first_line, last_line) of runs of lines in (id, text) rows; lines without a word don't count.

    Runs have two lines or more, aren't the whole text, and hold no line that reaches the threshold
    with the template by itself.  Of a template's runs in a document the best stands (ties: the first),
    unless one of another template overlaps it and shares more pairs (ties: the larger Dice, then the
    first by name).
    """
    longest = max(words.values())
    pairs = sorted({p for r in rows for p in r[2]})
    least = {(r[0], r[1]): math.ceil(threshold / (2 - threshold) * len(r[2]) - 1e-9) for r in rows}
    known = F.from_json(
        F.lit(json.dumps([{"license": r[0], "no": r[1], "size": words[r[0], r[1]], "least": least[r[0], r[1]], "pairs": r[2]} for r in rows])),
        "array<struct<license: string, no: int, size: int, least: int, pairs: array<string>>>",
    )
    # a line end is a token of its own; the k-th one, at token p, has p - k words before it
    spaced = F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z0-9\n]+", " "), "\n", " \n ")
    tokens = F.filter(F.split(spaced, " +"), lambda t: t != "")
    split = _once(some.filter(F.instr("text", "\n") > 0), "tokens", tokens).select("id", "tokens")
    split = _once(split, "w", F.filter("tokens", lambda t: t != "\n"))
    ends = F.filter(F.transform("tokens", lambda t, i: F.when(t == "\n", i)), lambda p: p.isNotNull())
    # where lines with words begin, and at last the text's end
    starts = F.filter(F.array_distinct(F.concat(F.array(F.lit(0)), F.transform(ends, lambda p, k: p - k))), lambda p: p < F.size("w"))
    split = _once(split, "s", F.concat(starts, F.array(F.size("w")))).select("id", "w", "s")
    lines = F.size("s") - 1
    at = lambda i: F.get("s", F.least(i, lines))
    chunk = lambda c: F.struct(
        c.alias("from"), F.slice("s", c + 1, F.lit(CHUNK + longest + 1)).alias("s"), F.slice("w", at(c) + 1, at(c + CHUNK) - at(c) + 2 * longest).alias("w"), F.size("w").alias("n")
    )
    chunks = split.filter(lines > 1).select("id", F.explode(F.transform(F.sequence(F.lit(0), lines - 1, F.lit(CHUNK)), chunk)).alias("c")).select("id", "c.*")
    hits = F.filter(F.transform(_adjacent(F.col("w")), lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda h: h["p"].isin(pairs))
    chunks = _once(chunks, "hits", hits).filter(F.size("hits") >= min(least.values()))

    def window(i: Column) -> Column:
        begin = F.get("s", i) - F.get("s", F.lit(0))
        return F.struct(
            (F.col("from") + i).alias("k"),
            F.transform(F.slice("s", i + 1, F.lit(longest + 1)), lambda p: p - F.get("s", i)).alias("s"),
            F.slice("w", begin + 1, F.lit(2 * longest)).alias("w"),
            (F.col("n") - F.get("s", i)).alias("rest"),
            F.transform(F.filter("hits", lambda h: (h["i"] >= begin) & (h["i"] < begin + 2 * longest)), lambda h: h["p"]).alias("near"),
        )

    inside = F.least(F.size("s") - 1, F.lit(CHUNK))
    begun = chunks.select("id", F.explode(F.transform(F.sequence(F.lit(0), inside - 1), window)).alias("c")).select("id", "c.*")
    # a match shares so many pairs at least
    may = F.filter(known, lambda t: (t["least"] <= F.size("near")) & (F.size(F.array_intersect(t["pairs"], F.col("near"))) >= t["least"]))
    tried = begun.select("id", "k", "s", "w", "rest", F.explode(may).alias("t"))
    end = F.coalesce(F.get(F.filter("s", lambda p: p >= F.col("t.size")), F.lit(0)), F.col("rest"))
    tried = _once(tried, "e", end)
    tried = tried.filter((F.col("e") > F.get("s", F.lit(1))) & (F.col("e") <= 2 * F.col("t.size")) & ((F.col("k") > 0) | (F.col("e") < F.col("rest"))))
    tried = _once(tried.withColumn("w", F.slice("w", F.lit(1), F.col("e"))), "dice", _dice(F.col("w"), F.col("t.pairs")))
    scored = tried.filter(F.col("dice") >= threshold)
    starts = F.filter("s", lambda p: p < F.col("e"))
    alone = F.exists(F.zip_with(starts, F.slice("s", F.lit(2), F.size(starts)), lambda a, b: F.slice("w", a + 1, F.least(b, F.col("e")) - a)), lambda line: _dice(line, F.col("t.pairs")) >= threshold)
    shared = F.col("dice") * (F.size(F.array_distinct(_adjacent(F.col("w")))) + F.size("t.pairs")) / 2
    found = scored.filter(~alone).select("id", "t.license", "t.no", "dice", F.round(shared).cast("int").alias("shared"), F.col("k").alias("first_line"), (F.col("k") + F.size(starts) - 1).alias("last_line"))
    rank = F.struct(-F.col("shared"), -F.col("dice"), "license", "no").alias("rank")
    best = found.groupBy("id", "license", "no").agg(F.min_by(F.struct("first_line", "last_line", "license", "dice", rank), F.struct(-F.col("dice"), "first_line")).alias("r"))
    # bounded: a template has one run at most
    each = best.groupBy("id").agg(F.collect_list("r").alias("all"))
    stands = lambda r: ~F.exists("all", lambda o: (o["first_line"] <= r["last_line"]) & (r["first_line"] <= o["last_line"]) & (o["rank"] < r["rank"]))
    return each.select("id", F.explode(F.filter("all", stands)).alias("r")).select("id", "r.license", "r.dice", "r.first_line", "r.last_line")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Licences found in each document.

    Result: id, license, dice (the best segment's, at least ``threshold``), n_segments (segments
    whose best template is this licence; ties go to the first licence by name).  A segment is a line
    of two words or more, the whole text if it has several lines, or a run of lines that holds a
    wrapped notice (see ``runs``: one at most per template).  Null and empty texts have no
    segments and no rows; rows of one id are one document; an empty table gives no rows; other
    columns aren't read.  The templates are a short fixed list, so broadcasting them is safe.
    """
    spark: SparkSession = docs.sparkSession
    rows, keywords = prepared(templates, threshold)
    table = spark.createDataFrame(rows, "license string, template_no int, pairs array<string>, keys array<string>")
    text = F.col(text_col)
    # bound as a lambda's argument, the text is lower-cased once for all keywords
    short = "|".join(w for w in keywords if len(w) < 6)
    tests = [lambda low, w=w: low.contains(w) for w in keywords if len(w) >= 6]
    tests += [lambda low: low.rlike(f"(?<![a-z0-9])(?:{short})(?![a-z0-9])")] if short else []
    hit = F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, [t(low) for t in tests]))
    # only texts with a key are kept, for lines and runs both start from these
    keyed_text = F.exists(_adjacent(F.split(normalized(F.col("text")), " ")), lambda p: p.isin(sorted({k for r in rows for k in r[3]})))
    some = written(docs.select(F.col(id_col).alias("id"), text.alias("text")).filter(hit).filter(keyed_text))
    # line 0 is the whole text
    whole = F.when(F.instr("text", "\n") > 0, F.col("text")).otherwise(F.lit(""))
    lines = some.select("id", F.posexplode(F.concat(F.array(whole), F.split("text", "\n"))).alias("line", "segment"))
    sizes = [len(r[2]) for r in rows]
    low_size, high_size = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    split = lines.select("id", "line", F.split(normalized(F.col("segment")), " ").alias("w"))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    paired = split.filter(n > 0).select("id", "line", F.array_distinct(F.zip_with(F.slice("w", F.lit(1), n), F.slice("w", F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))).alias("own"))
    sized = paired.filter(F.size("own").between(low_size - 1e-9, high_size + 1e-9))
    by_key = sized.select("id", "line", "own", F.explode("own").alias("pair"))
    keyed = F.broadcast(table.select("license", "template_no", "pairs", F.explode("keys").alias("pair")))
    found = by_key.join(keyed, "pair")
    shared = F.size(F.array_intersect("own", "pairs"))
    dice = 2 * shared / (F.size("own") + F.size("pairs"))
    within = (F.size("own") * threshold / (2 - threshold) <= F.size("pairs") + 1e-9) & (F.size("pairs") <= F.size("own") * (2 - threshold) / threshold + 1e-9)
    matched = found.filter(within).select("id", "line", "license", dice.alias("dice")).filter(F.col("dice") >= threshold)
    best = matched.groupBy("id", "line").agg(F.max("dice").alias("dice"), F.min_by("license", F.struct(-F.col("dice"), F.col("license"))).alias("license"))
    size = {(name, no): len(words_of(t)) for name, texts in templates.items() for no, t in enumerate(texts)}
    wrapped = runs(some, rows, size, threshold).select("id", "license", "dice")
    return best.select("id", "license", "dice").unionByName(wrapped).groupBy(F.col("id").alias(id_col), "license").agg(F.max("dice").alias("dice"), F.count("*").alias("n_segments"))
