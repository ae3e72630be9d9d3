"""Words and counts of whole UTF-8 texts.

Texts arrive as bytes: ``bytes.split`` and ``bytes.strip`` know exactly the white space
``[\\x20\\x09-\\x0D]`` and ``bytes.lower`` changes exactly ``A-Z``, so nothing has to be decoded
and malformed UTF-8 cannot stop a job. A null text is an empty one.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.workspace import materialise

#: The seed of Spark's ``xxhash64``; hashes made here equal those that Spark computes.
SEED = 42


def as_bytes(column: str | Column) -> Column:
    """The text as it is passed to a worker: its bytes, empty for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def carried(columns: list[str]) -> Column:
    """Input columns as one struct ``row``, so no name of theirs meets a computed one."""
    return F.struct(*[F.col(f"`{name}`") for name in columns]).alias("row")


def hashes(items, count: int) -> np.ndarray:
    """XXH64 of each of ``count`` byte strings."""
    return np.fromiter(map(xxhash.xxh64_intdigest, items, repeat(SEED)), np.uint64, count)


def repeated_window_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    starts = len(words) - width + 1
    if starts < 2:
        return 0
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(starts, np.uint64)
    for k in range(width):
        windows = (windows ^ codes[k : k + starts]) * np.uint64(0x9E3779B97F4A7C15)
        windows ^= windows >> np.uint64(29)
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(starts, np.int64)
    again[order[1:][same]] = 1
    again[order[:-1][same]] = 1
    opened = np.zeros(len(words) + 1, np.int64)
    opened[:starts] += again
    opened[width : width + starts] -= again
    return int((np.cumsum(opened)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


#: A table of at most so many rows of a few numbers is broadcast: about 200 MB.
SMALL_ROWS = 1 << 21


def identified(df: DataFrame, scan: bool = False) -> DataFrame:
    """``df`` with ``_file`` and ``_place`` for each row: a hash of its file's path, and its number in it.

    ``scan`` says that ``df`` is read from files, with nothing but projections and filters; any other frame is
    written first, so a row keeps its place when it is read again.
    """
    rows = df if scan else materialise(df, "rows")[0]
    return rows.select("*", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its counted ``rows`` are few; otherwise Spark chooses the join."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df
