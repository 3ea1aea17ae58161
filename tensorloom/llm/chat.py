"""Operator 9: chat formatting by incremental black-box rendering.

A template is any function from a list of turns to text.  The operator learns what a turn adds by
rendering successive prefixes of the conversation and comparing each output with the one before: if
the old output is not a prefix of the new one, the template has rewritten history, and the turn says
so instead of getting a wrong span.  Where a turn's own text lies inside its span is found the same
way, by rendering the prefix again with two probe texts in its place.

All prefixes are rendered from the conversation's true start, whatever its length, so templates may
look back or forward as they like; this costs the square of a conversation's length.  Rows arrive
sorted, and a task holds one conversation at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# --- the template -------------------------------------------------------------------------------
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|<</?ROLE")


def escape(text: str) -> str:
    """A backslash before every backslash and control string; no control string is left bare."""
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\|(?=[<\[]))", lambda m: m[1], text)


def instruct(turns: list[Turn]) -> str:
    """``<s>`` once, ``[INST] user [/INST]``, ``assistant </s>``, and named blocks for other roles."""
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f" {escape(text)} </s>")
        else:
            # the name is hex, so any role can be read back
            out.append(f"<<ROLE {role.encode().hex()}>> {escape(text)} <</ROLE>>")
    return "".join(out)


_TURN = re.compile(r"(?s)\[INST\] (?P<user>(?:\\.|(?! \[/INST\])[^\\])*) \[/INST\]|<<ROLE (?P<role>[0-9a-f]*)>> (?P<other>(?:\\.|(?! <</ROLE>>)[^\\])*) <</ROLE>>| (?P<assistant>(?:\\.|(?! </s>)[^\\])*) </s>")


def read_back(text: str) -> list[Turn]:
    """The turns of what :func:`instruct` wrote; raises ValueError on anything else."""
    if not text.startswith("<s>"):
        raise ValueError("no start mark")
    at, out = 3, []
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        if m["user"] is not None:
            out.append(("user", unescape(m["user"])))
        elif m["assistant"] is not None:
            out.append(("assistant", unescape(m["assistant"])))
        else:
            out.append((bytes.fromhex(m["role"]).decode(), unescape(m["other"])))
        at = m.end()
    return out


# --- the black box ------------------------------------------------------------------------------
PROBES = ("a", "b")


def _spans(template: Template, turns: list[Turn]) -> Iterator[tuple[dict, str]]:
    before = template([])
    for i in range(len(turns)):
        now = template(turns[: i + 1])
        one, two = (template([*turns[:i], (turns[i][0], p)]) for p in PROBES)
        rewrites = not now.startswith(before)
        base = 0 if rewrites else len(before)
        begin = next((k for k, (x, y) in enumerate(zip(one, two, strict=False)) if x != y), len(one))
        tail = len(one) - begin - 1
        hidden = len(one) != len(two) or begin == len(one) or begin < base  # the text isn't shown once, or is shown earlier
        end = len(now) - tail
        yield {"added": now[base:], "begin": None if hidden else begin - base, "end": None if hidden else end - base, "rewrites": rewrites}, now
        before = now


def spans(template: Template, turns: list[Turn]) -> tuple[list[dict], str]:
    """For each turn: what it added and where its text lies in that.

    Returns one dict per turn, ``added``, ``begin``, ``end`` (of the rendered text in ``added``) and
    ``rewrites`` (history changed; then ``added`` is the whole output), and the last output.
    """
    found, last = [], template([])
    for span, last in _spans(template, turns):
        found.append(span)
    return found, last


def rendered(template: Template, turns: Iterator[Turn]) -> Iterator[tuple[Turn, dict]]:
    """(turn, span) of each turn of a conversation of any length, handed on one by one."""
    held = list(turns)
    start = template([])
    for i, (span, _) in enumerate(_spans(template, held)):
        if i == 0 and not span["rewrites"]:  # what the template writes before any turn
            span = span | {"added": start + span["added"], "begin": _plus(span["begin"], len(start)), "end": _plus(span["end"], len(start))}
        yield held[i], span


def _plus(a: int | None, b: int) -> int | None:
    return None if a is None else a + b


def _stream(frames: Iterator[pd.DataFrame], template: Template) -> Iterator[pd.DataFrame]:
    """Sorted rows in, a row per turn out; conversations may go on from one batch to the next."""
    rows = ((c, t, r, x) for f in frames for c, t, r, x in zip(f["conv"], f["turn"], f["role"], f["text"], strict=True))
    ahead = next(rows, None)
    out: list[tuple] = []
    while ahead is not None:
        conv = ahead[0]
        keys: list = []

        def turns(conv=conv, keys=keys) -> Iterator[Turn]:
            nonlocal ahead
            while ahead is not None and (ahead[0] == conv or (pd.isna(ahead[0]) and pd.isna(conv))):
                _, turn, role, text = ahead
                keys.append(turn)
                ahead = next(rows, None)
                yield ("" if role is None else role, "" if text is None else text)

        pos, at = 0, 0
        for (role, _), f in rendered(template, turns()):
            begin = None if f["begin"] is None else at + f["begin"]
            end = None if f["end"] is None else at + f["end"]
            out.append((conv, pos, keys[0], role, f["added"], at, begin, end, f["rewrites"], None if f["begin"] is None else f["added"][f["begin"] : f["end"]]))
            keys.pop(0)
            at += len(f["added"])
            pos += 1
            if len(out) >= 2000:
                yield _frame(out)
                out = []
    if out:
        yield _frame(out)


_COLUMNS = ["conv", "pos", "turn", "role", "added", "at", "text_begin", "text_end", "rewrites", "shown"]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=_COLUMNS)
    for c in ("conv", "turn", "text_begin", "text_end"):
        f[c] = f[c].astype("Int64")
    return f


def format_turns(conversations: DataFrame, template: Template = instruct) -> DataFrame:
    """What each turn adds to its conversation's rendering.

    Input rows have conv_id, turn, role, text; other columns are not read.  Result, a row per input
    row: conv_id, pos int (0 from the first), turn, role, added (text that the turn adds), at long
    (where it begins in the output), text_begin and text_end long (the turn's own text in the
    output, null if the template hides it), rewrites boolean (the template changed what it had
    written before; ``added`` is then the whole new output) and shown (the text as rendered).

    Null text and null role count as empty; a null conv_id is one conversation; a null turn comes
    first; turns of one number are ordered by role and text, so repeated rows are repeated turns.
    An empty table gives no rows.  One shuffle by conversation; tasks stream.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    schema = "conv long, pos long, turn long, role string, added string, at long, text_begin long, text_end long, rewrites boolean, shown string"
    return rows.mapInPandas(lambda frames: _stream(frames, template), schema).withColumnRenamed("conv", "conv_id")


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of each conversation, read back from the rendering; sorted rows, constant memory."""
    conv, state, out = None, None, []

    def close() -> None:
        out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))

    for f in frames:
        for c, pos, added, shown, role, rewrites in zip(f["conv_id"], f["pos"], f["added"], f["shown"], f["role"], f["rewrites"], strict=True):
            if pos == 0:
                if state:
                    close()
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            turn = read_back(added if pos == 0 else "<s>" + added)
            if len(turn) != 1:
                raise ValueError("a turn's output isn't one turn")
            state[0] += 1
            state[1].update(f"{turn[0][0]}\n{turn[0][1]}\n".encode())
            if role == "assistant":  # the loss mask covers its text, as located by the probes
                text = unescape(shown)
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(added)
            state[5] += bool(rewrites)
        if len(out) >= 2000:
            yield _digest_frame(out)
            out.clear()
    if state:
        close()
    if out:
        yield _digest_frame(out)


def _digest_frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewrites"])
    f["conv_id"] = f["conv_id"].astype("Int64")
    return f


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation: what can be read back from the built-in template's output.

    ``turns`` comes from :func:`format_turns`, whose partitions hold whole conversations in order,
    so no second shuffle is needed.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewrites long"
    return turns.mapInPandas(_fold, schema)
