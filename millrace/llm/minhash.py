"""Near copies by MinHash: one permutation, densified, banded buckets, stars of candidates, exact checks.

A document is the set of hashes of its word shingles. Texts of equal sets are one node from the start,
so exact copies make no links. One hash of every shingle fills ``BANDS * ROWS`` bins with the smallest
value that falls into each; an empty bin copies a filled one that a hash of its own number points to
(optimal densification), so two bins agree with the probability of the sets' similarity. Each band of
``ROWS`` bins is the key of a bucket: of pairs at a similarity of 0.85 a share of 2e-9 meets in none.

Every member of a bucket is joined to the smallest one, a star, so a bucket of n makes n - 1 candidate
edges. A star can miss a link between two of its rays; so what is checked are the components of the
candidate edges, not the edges: one task compares the full sets of a component, by one centre against all
that follow in order of size, and returns stars that join what is linked. A component of more than ``cap`` sets or
``TOKENS`` shingles is checked bucket by bucket, and a bucket above these bounds in pairs of blocks. So
every two texts that share a bucket are compared on their full sets, at any size, and no group of pairs
is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.links import components
from millrace.llm.text import as_bytes, carried, hashes
from millrace.workspace import materialise

#: Bands and bins of a band; bins are a power of two.
BANDS, ROWS = 64, 8
BINS = BANDS * ROWS
#: Sets and shingles that one task compares.
CAP, TOKENS = 1 << 13, 1 << 22

_BIN_SHIFT = np.uint64(64 - (BINS - 1).bit_length())
_ODD, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; of all its words if they are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    count = max(1, len(words) - width + 1)
    spans = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.unique(hashes(spans, count))


def signature(found: np.ndarray) -> np.ndarray:
    """The densified bins of a set that is not empty."""
    mixed = np.sort(_mix(found * _ODD))
    filled, first = np.unique(mixed >> _BIN_SHIFT, return_index=True)
    values, known = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[filled] = mixed[first]
    known[filled] = True
    empty, attempt = np.flatnonzero(~known), 0
    while len(empty):
        tries = (np.arange(attempt, attempt + 32, dtype=np.uint64)[:, None] << np.uint64(32)) + empty.astype(np.uint64)
        source = (_mix((tries + np.uint64(1)) * _ODD) >> _BIN_SHIFT).astype(np.int64)
        hits = known[source]
        found_one = hits.any(axis=0)
        pick = hits.argmax(axis=0)[found_one]
        values[empty[found_one]] = values[source[pick, np.flatnonzero(found_one)]]
        empty = empty[~found_one]
        attempt += 32
    return values


def band_keys(bins: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different in every band."""
    keys = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD)
    for column in bins.reshape(BANDS, ROWS).T:
        keys = _mix((keys ^ column) * _ODD)
    return keys


def least_size(percent: int) -> int:
    """Smaller sets are linked with no other set: ``n / (n + 1)`` is below the similarity."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


def sketched(text: Column, width: int, percent: int) -> Column:
    """``n`` shingles, a 128-bit hash ``c1, c2`` of their set, and its band keys (none for sets too small for links)."""
    least = least_size(percent)

    @F.arrow_udf("struct<n: long, c1: long, c2: long, bands: binary>")
    def of(texts: pa.Array) -> pa.Array:
        sizes, halves, bands = [], [], []
        for x in texts:
            found = shingles(x.as_buffer().to_pybytes(), width)
            sizes.append(len(found))
            halves.append(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64))
            bands.append(band_keys(signature(found)).tobytes() if len(found) >= least else None)
        halves = np.array(halves, np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(bands, pa.binary())],
            ["n", "c1", "c2", "bands"],
        )

    return of.asNondeterministic()(text)


def _sets(width: int):
    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(x.as_buffer().to_pybytes(), width).tobytes() for x in texts], pa.binary())

    return of


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``node, bands`` to ``key, node``."""
    for batch in batches:
        nodes = np.asarray(batch.column(0))
        keys = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.repeat(nodes, BANDS))], ["key", "node"]
            )


def forest(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Stars that join exactly what the pairs of unequal sides (of any, if there is one side) join.

    A pair is linked if ``100 * intersection >= percent * union``. Every set that is linked at all, but for the
    one of the smallest node it is joined with, gives one row: that node, and its own.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    nodes, side, sizes, sets = nodes[order], side[order], sizes[order], [sets[k] for k in order]
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(int(local.max()) + 1, np.int32)
    root = np.arange(len(sets))
    two = (side != side[0]).any()
    for k in range(len(sets) - 1):
        # Sets that follow are no smaller, and too large ones cannot be similar enough.
        end = int(np.searchsorted(sizes * percent, 100 * sizes[k], side="right"))
        rest = root[k + 1 : end] != root[k]
        if two:
            rest &= side[k + 1 : end] != side[k]
        if not rest.any():
            continue
        own = local[starts[k] : starts[k + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[local[starts[k + 1] : starts[end]]], starts[k + 1 : end] - starts[k + 1])
        mark[own] = 0
        near = 100 * shared >= percent * (sizes[k] + sizes[k + 1 : end] - shared)
        for other in np.flatnonzero(near & rest) + k + 1:
            if root[other] != root[k]:
                root[root == root[other]] = root[k]
    least = np.full(len(sets), np.iinfo(np.int64).max)
    np.minimum.at(least, root, nodes)
    centres = least[root]
    return [(int(c), int(n)) for c, n in zip(centres, nodes, strict=True) if c != n]


def _confirmed(percent: int):
    """Sorted rows ``g1, g2, side, node, shingles`` to links ``a, b``; a group is a run of equal ``g1, g2``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []

        def links() -> Iterator[pa.RecordBatch]:
            if len(members) > 1:
                sides, nodes, sets = zip(*members, strict=True)
                made = forest(np.array(nodes), list(sets), np.array(sides), percent)
                if made:
                    a, b = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            first, second, sides, nodes = (np.asarray(batch.column(k)) for k in range(4))
            for k, value in enumerate(batch.column(4)):
                if (first[k], second[k]) != group:
                    yield from links()
                    group, members = (first[k], second[k]), []
                members.append((sides[k], nodes[k], np.frombuffer(value.as_buffer().to_pybytes(), np.uint64)))
        yield from links()

    return run


def _groups_of_buckets(members: DataFrame, cap: int, tokens: int) -> DataFrame:
    """``g1, g2, side, node`` of ``key, node, n``: a bucket is one group, or a group for each pair of its blocks."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("held")).filter("many > 1")
    blocks = F.greatest(F.ceil(F.col("many") / cap), F.ceil(F.col("held") / tokens)).cast("int")
    dealt = members.join(sizes.select("key", blocks.alias("blocks")), "key")
    own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
    pairs = dealt.select("key", "node", "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")
    # In a group of two blocks only pairs across are compared; a block meets itself in a group of its own.
    side = F.when((F.col("own") > F.col("other")), F.lit(1)).otherwise(0)
    return pairs.select(F.col("key").alias("g1"), pair.alias("g2"), side.alias("side"), "node")


def near_links(nodes: DataFrame, sets, percent: int = 85, cap: int = CAP, tokens: int = TOKENS) -> DataFrame:
    """Links ``a, b`` whose components are those of all pairs that share a bucket and are similar enough.

    ``nodes`` has ``node, n, bands``; ``sets`` gives ``node, shingles`` for a table of ``node``.
    """
    keyed, _ = materialise(
        nodes.filter("bands IS NOT NULL").select("node", "bands").mapInArrow(_exploded, "key long, node long"), "bands"
    )
    stars = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    stars, _ = materialise(stars.select("key", "centre"), "stars")
    shared, _ = materialise(keyed.join(stars, "key"), "shared")
    placed, rows = materialise(components(shared.select("node", "centre")), "candidates")
    spark = nodes.sparkSession
    if not rows:
        return spark.createDataFrame([], "a long, b long")
    # The smallest node of a component has no row of its own there.
    placed = placed.union(placed.select(F.col("root").alias("node"), "root").distinct())
    placed, _ = materialise(placed.join(nodes.select("node", "n"), "node"), "placed")
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("held"))
    sizes, _ = materialise(sizes.withColumn("large", (F.col("many") > cap) | (F.col("held") > tokens)), "sizes")
    sized = placed.join(sizes.select("root", "large"), "root")
    whole = sized.filter("NOT large").select(
        F.col("root").alias("g1"), F.lit(-1).cast("long").alias("g2"), F.lit(0).alias("side"), "node"
    )
    members = shared.select("key", "node").join(sized.filter("large").select("node", "n"), "node")
    groups = whole.union(_groups_of_buckets(members, cap, tokens))
    full, _ = materialise(sets(placed.select("node")), "sets")
    rows = groups.join(full, "node").select("g1", "g2", "side", "node", "shingles")
    rows = rows.repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    return rows.mapInArrow(_confirmed(percent), "a long, b long").distinct()


def near_copies(
    df: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 85,
    carry: list[str] | None = None,
    cap: int = CAP,
    tokens: int = TOKENS,
) -> DataFrame:
    """``row, n_shingles, component`` for every input row.

    ``row`` holds the ``carry`` columns (default: the id). Texts are linked whose sets of ``width``-word
    shingles (A-Z lower-cased; fewer words: the whole sequence) have ``100 * intersection >= percent *
    union``; ``component`` is the smallest id reachable over links. A text without words, or null, has no
    shingle and is linked with nothing: its component is its own id. Repeated rows and repeated ids stay,
    a component all of whose ids are null has a null ``component``, texts of any length are compared whole,
    and an empty table gives an empty result.
    """
    of_text, own = as_bytes(text), F.col(f"`{id_column}`")
    marked = df.select(
        carried(carry or [id_column]), own.alias("id"), F.xxhash64(of_text).alias("mark"), sketched(of_text, width, percent).alias("made")
    )
    marked, _ = materialise(marked.select("row", "id", "mark", "made.*"), "marked")
    # The texts that stand for a class: those of its smallest id (of any, if that has several of one set).
    first = F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("first")
    classes = marked.filter("n > 0").groupBy("c1", "c2").agg(first, F.min("n").alias("n"), F.min("bands").alias("bands"))
    classes, _ = materialise(
        classes.select(
            F.monotonically_increasing_id().alias("node"), "c1", "c2", "n", "first.id", "first.mark", "bands"
        ),
        "classes",
    )

    def sets(wanted: DataFrame) -> DataFrame:
        of = classes.join(wanted, "node").select("node", "id", F.col("mark").alias("own"))
        texts = df.select(own.alias("of"), of_text.alias("text")).withColumn("mark", F.xxhash64("text"))
        met = texts.join(of, (F.col("mark") == F.col("own")) & F.col("of").eqNullSafe(F.col("id")))
        # Rows of one text and one id are the same set, so any one of them will do.
        return met.groupBy("node").agg(F.min("text").alias("text")).select("node", _sets(width)("text").alias("shingles"))

    found = components(near_links(classes.select("node", "n", "bands"), sets, percent, cap, tokens))
    rooted = classes.join(found, "node", "left").select("c1", "c2", "id", F.coalesce("root", "node").alias("root"))
    rooted, _ = materialise(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("id").alias("component"))
    placed, _ = materialise(rooted.join(lowest, "root").select("c1", "c2", "component"), "placed")
    linked = marked.filter("n > 0").select("row", "n", "c1", "c2").join(placed, ["c1", "c2"])
    return linked.select("row", F.col("n").alias("n_shingles"), "component").union(
        marked.filter("n = 0").select("row", F.col("n").alias("n_shingles"), F.col("id").alias("component"))
    )
