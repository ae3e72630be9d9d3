"""Near copies by SimHash: fingerprints, covering bit masks, components.

Every pair of fingerprints within the radius ``r`` is found, for certain: each bit position gets a
vector of ``r + 1`` bits, and each of the ``2**(r + 1) - 1`` non-zero vectors ``v`` makes one table
whose mask keeps the positions not orthogonal to ``v``. The positions at which a pair differs span
at most ``r`` dimensions, so some ``v`` is orthogonal to all of them, and the pair has equal keys in
its table. With 64 bits and radius 3 these are 15 tables of about 34 kept bits.

Equal fingerprints are one node from the start, so exact copies make no pairs at all. A bucket of
up to ``cap`` distinct fingerprints is compared inside one task, which returns a forest of its links
and not the links. A larger bucket goes down a level instead: the positions its mask left out are
covered by 15 masks again. A level keeps about half of the open positions, so a bucket of the third
level holds at most 2**7 fingerprints by counting bits, and nothing is capped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.links import components
from millrace.llm.text import as_bytes, carried, hashes, identified, if_small
from millrace.workspace import materialise

BITS = 64
#: Set bits of each byte value, most significant first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def text_fingerprint(text: bytes, width: int) -> int:
    """The fingerprint of one text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    count = max(1, len(words) - width + 1)
    spans = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    found = hashes(spans, count).astype(">u8").view(np.uint8).reshape(count, 8)
    ones = np.concatenate([np.bincount(found[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def fingerprint(text: str | Column, width: int = 3) -> Column:
    """SimHash of the word shingles of a text as a signed 64-bit number (hex digits: ``hex_digits``)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        made = np.fromiter((text_fingerprint(x.as_buffer().to_pybytes(), width) for x in texts), np.uint64, len(texts))
        return pa.array(made.view(np.int64))

    return of(as_bytes(text))


def hex_digits(fingerprints: str | Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fingerprints)), 16, "0")


def covering_masks(positions: tuple[int, ...], radius: int) -> list[int]:
    """One mask for each table over the given bit positions."""
    vectors = 2 ** (radius + 1) - 1
    of = {position: k % vectors + 1 for k, position in enumerate(positions)}
    return [
        sum(1 << p for p in positions if (of[p] & v).bit_count() % 2) for v in range(1, vectors + 1)
    ]


def _table(code: int, radius: int) -> tuple[int, tuple[int, ...]]:
    """The kept bits and the open positions of a table; its code has a digit for each level."""
    if code == 0:
        return 0, tuple(range(BITS))
    parent, digit = divmod(code, 2 ** (radius + 1))
    kept, positions = _table(parent, radius)
    mask = covering_masks(positions, radius)[digit - 1]
    return kept | mask, tuple(p for p in positions if not mask >> p & 1)


def _keyed(radius: int):
    """Rows ``table, fp`` to rows ``table, key, fp`` of the tables one level down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, int] = {}  # of the tables met by this task
        for batch in batches:
            codes, fps = (np.asarray(batch.column(k)) for k in (0, 1))
            for code in np.unique(codes):
                own = fps[codes == code]
                for digit in range(1, 2 ** (radius + 1)):
                    child = int(code) * 2 ** (radius + 1) + digit
                    if child not in masks:
                        masks[child] = _table(child, radius)[0]
                    kept = np.array([masks[child]], np.uint64).view(np.int64)[0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), child, np.int64)), pa.array(own & kept), pa.array(own)],
                        ["table", "key", "fp"],
                    )

    return run


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket's distinct fingerprints that join exactly what is linked within it."""
    unsigned = fps.view(np.uint64)  # bits of a negative number are not those of its absolute value
    near = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        low = np.where(near, label[None, :], len(fps)).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    rest = label != np.arange(len(fps))
    return fps[rest], fps[label[rest]]


def _linked(radius: int):
    """Sorted rows ``table, key, fp`` to links; a bucket is a run of equal ``table, key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 3), np.int64)

        def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            edges = np.concatenate([[0], cuts, [len(rows)]])
            made = [
                _forest(np.ascontiguousarray(rows[start:end, 2]), radius)
                for start, end in zip(edges[:-1], edges[1:], strict=True)
                if end - start > 1
            ]
            if made:
                a, b = (np.concatenate(x) for x in zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = np.column_stack([np.asarray(batch.column(k)) for k in range(3)])
            rows = np.concatenate([held, rows])
            # The last bucket may go on in the next batch.
            last = int(np.flatnonzero((rows[:, :2] == rows[-1, :2]).all(axis=1))[0]) if len(rows) else 0
            held = rows[last:]
            yield from links(rows[:last])
        yield from links(held)

    return run


def near_links(fingerprints: DataFrame, radius: int = 3, cap: int = 1024) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs within ``radius`` bits.

    ``fingerprints`` has one column of distinct numbers that are not null.
    """
    name = fingerprints.columns[0]
    rest = fingerprints.select(F.lit(0).cast("long").alias("table"), F.col(name).alias("fp"))
    found = None
    for level in (1, 2, 3):
        keyed = rest.mapInArrow(_keyed(radius), "table long, key long, fp long")
        if level < 3:
            keyed, _ = materialise(keyed, "keyed")
            large, rows = materialise(
                keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("fps")).filter(F.col("fps") > cap), "buckets"
            )
            rest = keyed.join(large, ["table", "key"], "left_semi").select("table", "fp")
            small = keyed.join(large, ["table", "key"], "left_anti") if rows else keyed
        else:
            small, rows = keyed, 0
        runs = small.repartition("table", "key").sortWithinPartitions("table", "key")
        links = runs.mapInArrow(_linked(radius), "a long, b long")
        found = links if found is None else found.union(links)
        if not rows:
            break
    return found.distinct()


def near_copies(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, carry: list[str] | None = None
) -> DataFrame:
    """``row, fp, root, component`` for every input row.

    ``row`` holds the ``carry`` columns (default: the id). ``root`` is the smallest fingerprint and
    ``component`` the smallest id reachable over links of fingerprints at ``radius`` or fewer differing
    bits. A null or empty text has fingerprint 0 and is linked like any other; rows are never merged,
    so repeated rows and repeated ids stay; a component all of whose ids are null has a null
    ``component``; an empty table gives an empty result.
    """
    marked, _ = materialise(
        df.select(carried(carry or [id_column]), F.col(id_column).alias("id"), fingerprint(text, width).alias("fp")), "marked"
    )
    nodes, _ = materialise(marked.groupBy("fp").agg(F.min("id").alias("id")), "nodes")
    roots = components(near_links(nodes.select("fp"), radius))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root")
    )
    lowest = placed.groupBy("root").agg(F.min("id").alias("component"))
    of = placed.join(lowest, "root").select("fp", "root", "component")
    return marked.join(of, "fp").select("row", "fp", "root", "component")


def without_copies(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3, scan: bool = False
) -> DataFrame:
    """The rows of ``df`` with one of each component: that of the smallest id.

    Of several rows with that id the one with the smallest fingerprint stays, and of those any one;
    a component without any id keeps the row with its smallest fingerprint. ``scan`` says that ``df`` is a scan of
    files, whose rows need not be written to be told apart.
    """
    rows = identified(df, scan)
    slim = rows.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"), "_file", "_place")
    found = near_copies(slim, "id", "text", width, radius, carry=["id", "_file", "_place"])
    found, _ = materialise(found.select("row", "fp", "root"), "found")
    # One row for each component and task before the shuffle, whatever the size of the component.
    order = F.struct(F.col("row.id").isNull().alias("none"), "row.id", "fp", "row._file", "row._place")
    firsts = found.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    # The few rows that go are joined with the texts, not the many that stay.
    dropped = found.join(firsts, "root").filter((F.col("row._file") != F.col("first._file")) | (F.col("row._place") != F.col("first._place")))
    dropped, many = materialise(dropped.select("row._file", "row._place"), "dropped")
    return rows.join(if_small(dropped, many), ["_file", "_place"], "left_anti").select(*[f"`{name}`" for name in df.columns])
