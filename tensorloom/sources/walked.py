"""Files whose headers must be walked: one pass in Python gives each tensor's row and cuts its bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tensorloom.shared import bounded_batches

#: name, dtype, shape, first byte in the file (or null), bytes (null if unknown), inline data (or null)
Tensor = tuple[str, str, list[int], int | None, int | None, bytes | None]
COLUMNS = ["path", "ordinal", "name", "dtype", "shape", "byte_len", "in_bounds", "data", "error"]
#: A batch is handed on when it holds so many rows or bytes.
ROWS, BYTES = 4096, 8_000_000


def tensors(files: DataFrame, walk: Callable[[bytes], Iterator[Tensor]]) -> DataFrame:
    """(path, ordinal, name, dtype, shape, byte_len, in_bounds, data, error) of (path, content) files.

    A file that can't be walked gives one row with its ``error``; a tensor beyond the file has
    ``in_bounds`` false and null data.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    content = bytes(content)  # no content is an error as well
                    found = list(walk(content))
                except Exception as e:  # whatever a broken file makes of a walk is that file's row
                    out.append((path, 0, None, None, None, None, False, None, f"{type(e).__name__}: {e}"))
                    continue
                for i, (name, dtype, shape, start, n, inline) in enumerate(found):
                    inside = inline is not None or (start is not None and n is not None and 0 <= start and start + n <= len(content))
                    data = inline if inline is not None else content[start : start + n] if inside else None
                    out.append((path, i, name, dtype, shape, n, inside, data, None))
                    size += len(data or b"")
                    if len(out) >= ROWS or size >= BYTES:
                        yield _frame(out)
                        out, size = [], 0
        if out:
            yield _frame(out)

    bounded_batches(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, ordinal long, name string, dtype string, shape array<bigint>, byte_len long, in_bounds boolean, data binary, error string")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS, dtype=object).astype({"byte_len": "Int64"})
