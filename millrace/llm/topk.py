"""Exact top-k by inner product over a metric tree, best first.

The tree has routing objects, below each of them a node of further routing objects or a page of entries,
level by level until a page holds at most ``page`` entries; so it grows with the rows. A routing object
has its covering radius and its distance to the object above it, an entry its distance to the object of its
page. The objects of a node are fitted on a bounded sample of what lies there; every row is indexed.

For a query ``q``, an object ``o`` and anything ``x`` at distance ``d`` from it, ``q.x <= q.o + |q| d``. So
a subtree whose ``q.o + |q| radius`` is below the k-th score found so far is passed over; an object that its stored
distance to the object above, plus its radius, already rules out is not even computed; and of a page only
the entries far enough from its object are, which stand by falling distance.

Every query keeps the nodes it has not looked into, with their bounds. In each wave it looks into the
best of them, twice as many as in the wave before; what it finds raises its k-th score, and nodes below that
are dropped. The search ends when no query has a node left. Nodes meet their queries in one shuffle, the
node's own rows first; a task holds one node or page and a batch of queries. Vectors that many rows share,
which no distance tells apart, lie in several pages of radius 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.workspace import materialise

#: Rows that the objects of a node are fitted to at most, the first by hash, and objects of a node.
SAMPLE, FAN = 1024, 32
#: Entries of a page.
PAGE = 256
#: Rows of a node that one task gives to its objects.
DEALT = 1 << 16
#: Levels; a node still larger below is cut into pages as it is.
DEEPEST = 12

def whole_numbers(vector: str | Column, scale: int = 256) -> Column:
    """Each component ``x`` as ``floor(scale * x)``; null if the vector or a component is null or not finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; a shorter one ends in zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(column), width).astype(np.int64, copy=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _doubles(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


def centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Routing objects: some steps of k-means from different, evenly spread rows."""
    sample = sample.astype(float)
    different = np.unique(sample, axis=0)
    found = different[np.linspace(0, len(different) - 1, min(count, len(different))).astype(int)]
    for _ in range(4):
        place = _nearest(sample, found)[0]
        sums = np.zeros_like(found)
        np.add.at(sums, place, sample)
        rows = np.bincount(place, minlength=len(found))
        found = np.where(rows[:, None] > 0, sums / np.maximum(rows, 1)[:, None], found)
    return found


def _nearest(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest routing object of each row and the distance to it."""
    squares = (found * found).sum(axis=1)
    place = np.concatenate(
        [np.argmin(squares - 2 * rows[k : k + 1024] @ found.T, axis=1) for k in range(0, len(rows), 1024)] or [np.empty(0, int)]
    )
    return place, np.linalg.norm(rows - found[place], axis=1)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of batches in which the first ``keys`` columns are the same, with their values."""
    for batch in batches:
        if batch.num_rows:
            marks = np.column_stack([np.asarray(batch.column(k)) for k in range(keys)])
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                yield tuple(int(x) for x in marks[start]), batch.slice(start, end - start)


# The tree


def _fitted(width: int):
    """The sample of a node to its objects, numbered."""

    def run(table: pa.Table) -> pa.Table:
        found = centres(_matrix(table["v"].combine_chunks(), width), FAN)
        node = table["node"][0].as_py()
        return pa.table(
            {
                "node": pa.array([node] * len(found), pa.int64()),
                "child": pa.array(np.arange(len(found), dtype=np.int64) + node * FAN + 1),
                "o": _lists(found),
            }
        )

    return run


def _dealt(width: int):
    """Sorted ``node, part, kind, child, o, number, id, v`` to entries below their nearest object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, objects, children = None, [], None, None
        for (node, part, kind), run_ in _runs(batches, 3):
            if (node, part) != at:
                at, held, objects = (node, part), [], None
            if kind == 0:
                held.append(run_)
                continue
            if objects is None:
                objects = np.concatenate([_doubles(x.column(4), width) for x in held])
                children = np.concatenate([np.asarray(x.column(3)) for x in held])
            place, distance = _nearest(_matrix(run_.column(7), width).astype(float), objects)
            yield pa.RecordBatch.from_arrays(
                [pa.array(children[place]), run_.column(5), run_.column(6), run_.column(7), pa.array(distance)],
                ["node", "number", "id", "v", "distance"],
            )

    return run


def _tree(rows: DataFrame, count: int, width: int, page: int) -> tuple[DataFrame, DataFrame]:
    """Routing entries ``parent, node, o, radius, above, parts`` (0 parts: an inner node) and pages ``node, part, number, id, v, distance``.

    Nodes are numbered as in a heap; the root is node 0.
    """
    open_ = rows.select(F.lit(0).cast("long").alias("node"), "number", "id", "v")
    above = None  # the objects of the nodes that are split
    sizes = rows.sparkSession.createDataFrame([(0, count)], "node long, rows long")
    routing, pages = [], []
    for level in range(DEEPEST):
        by_hash = [F.xxhash64("v", "id"), F.col("number")]
        sample = open_.withColumn("part", F.pmod(F.xxhash64("number"), F.lit(64)))
        for group in (["node", "part"], ["node"]):
            sample = sample.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*by_hash))).filter(F.col("rank") <= SAMPLE)
        objects = sample.select("node", "v").groupBy("node").applyInArrow(_fitted(width), "node long, child long, o array<double>")
        objects, _ = materialise(objects, "objects")
        tasks = sizes.select("node", F.ceil(F.col("rows") / DEALT).cast("int").alias("tasks"))
        empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("child", "long"), ("o", "array<double>"))]
        entry = [F.lit(None).cast(kind).alias(name) for name, kind in (("number", "long"), ("id", "long"), ("v", "array<long>"))]
        met = (
            objects.join(tasks, "node")
            .select("node", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part"), F.lit(0).alias("kind"), "child", "o", *entry)
            .unionByName(
                open_.join(tasks, "node").select(
                    "node", F.pmod(F.xxhash64("number"), F.col("tasks")).cast("int").alias("part"), F.lit(1).alias("kind"), *empty, "number", "id", "v"
                )
            )
        )
        met = met.repartition("node", "part").sortWithinPartitions("node", "part", "kind")
        dealt, _ = materialise(
            met.mapInArrow(_dealt(width), "node long, number long, id long, v array<long>, distance double"), "dealt"
        )
        found = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.max("distance").alias("radius"))
        # What distances do not tell apart, and what is too deep, is cut as it is.
        whole = (F.col("rows") <= page) | (F.col("radius") <= 1e-9) | F.lit(level == DEEPEST - 1)
        found = found.withColumn("parts", F.when(whole, F.ceil(F.col("rows") / page)).otherwise(0).cast("int"))
        entries = found.join(objects.select(F.col("child").alias("node"), F.col("node").alias("parent"), "o"), "node")
        if above is None:
            entries = entries.withColumn("above", F.lit(None).cast("double"))
        else:
            entries = entries.join(above.select(F.col("node").alias("parent"), F.col("o").alias("upper")), "parent")
            squares = F.aggregate(F.zip_with("o", "upper", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x)
            entries = entries.withColumn("above", F.sqrt(squares))
        entries, _ = materialise(entries.select("parent", "node", "o", "radius", "above", "parts", "rows"), "routing")
        routing.append(entries.drop("rows"))
        placed = dealt.join(entries.select("node", "parts"), "node")
        pages.append(
            placed.filter("parts > 0").select("node", F.pmod(F.xxhash64("number"), F.col("parts")).cast("int").alias("part"), "number", "id", "v", "distance")
        )
        sizes, above = entries.filter("parts = 0").select("node", "rows"), entries.filter("parts = 0").select("node", "o")
        open_, left = materialise(placed.filter("parts = 0").select("node", "number", "id", "v"), "open")
        if not left:
            break

    def joined(parts: list[DataFrame]) -> DataFrame:
        whole_ = parts[0]
        for one in parts[1:]:
            whole_ = whole_.unionByName(one)
        return whole_

    return joined(routing), materialise(joined(pages), "pages")[0]


# The search


def _bound(product, length, distance):
    """Upper bound of a product, raised by what rounding may have taken from it."""
    return product + length * distance + 1e-9 * (np.abs(product) + length * distance) + 1e-3


_OPEN = "query long, node long, part int, product double, bound double"


def _expanded(width: int):
    """Sorted ``node, kind, child, o, radius, above, parts, query, v, product, kth`` to what the queries may still look into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, own = None, [], None
        for (node, kind), part in _runs(batches, 2):
            if node != at:
                at, held, own = node, [], None
            if kind == 0:
                held.append(part)
                continue
            if not held:
                continue
            if own is None:
                table = pa.Table.from_batches(held)
                own = {
                    "node": table["child"].to_numpy(), "o": _doubles(table["o"].combine_chunks(), width),
                    "radius": table["radius"].to_numpy(), "parts": table["parts"].to_numpy(),
                    "above": table["above"].to_pandas().to_numpy(float),  # missing at the root: nan
                }
            q = _matrix(part.column(8), width).astype(float)
            kth = part.column(10).to_numpy()[:, None]
            length = np.linalg.norm(q, axis=1)[:, None]
            # By the stored distances alone: objects that need not be computed.
            far = np.nan_to_num(own["above"], nan=np.inf)[None, :] + own["radius"][None, :]
            with np.errstate(invalid="ignore"):
                maybe = ~(_bound(np.nan_to_num(part.column(9).to_numpy())[:, None], length, far) < kth) | (length == 0)
            columns = np.flatnonzero(maybe.any(axis=0))
            product = np.full(maybe.shape, -np.inf)
            product[:, columns] = q @ own["o"][columns].T
            bound = _bound(product, length, own["radius"][None, :])
            rows, children = np.nonzero(maybe & ~(bound < kth))
            values = product[rows, children], bound[rows, children]
            many = np.maximum(1, own["parts"][children])
            again = np.repeat(np.arange(len(rows)), many)
            piece = np.arange(len(again)) - np.repeat(np.cumsum(many) - many, many)
            piece[own["parts"][children][again] == 0] = -1
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(7).take(pa.array(rows[again])), pa.array(own["node"][children][again]), pa.array(piece.astype(np.int32)),
                    pa.array(values[0][again]), pa.array(values[1][again]),
                ],
                ["query", "node", "part", "product", "bound"],
            )

    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers; one that does not fit 64 bits is an error."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2**53:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    return (q.astype(object) @ x.astype(object).T).astype(np.int64)


_HIT = "query long, query_id long, number long, id long, score long"


def _read(width: int, k: int):
    """Sorted ``node, part, kind, number, id, v, distance, kth`` to the best ``k`` entries of each query in each page.

    Of a query ``distance`` is its product with the object of the page.
    """

    def answers(page: dict, batch: pa.RecordBatch) -> pa.RecordBatch:
        q = _matrix(batch.column(5), width)
        product, kth = (batch.column(x).to_numpy(zero_copy_only=False)[:, None] for x in (6, 7))
        length = np.linalg.norm(q.astype(float), axis=1)[:, None]
        open_ = ~(_bound(product, length, page["distance"][None, :]) < kth)
        reach = int(np.flatnonzero(open_.any(axis=0)).max(initial=-1)) + 1  # entries stand by falling distance
        scores = _products(q, page["v"][:reach])
        usable = open_[:, :reach] & (page["number"][None, :reach] != batch.column(3).to_numpy()[:, None])
        out = []
        for row in range(len(q)):
            at = np.flatnonzero(usable[row])
            own = scores[row][at]
            if len(at) > k:
                cut = np.partition(own, len(own) - k)[len(own) - k]
                at, own = at[own >= cut], own[own >= cut]
            order = np.lexsort((page["number"][at], page["id"][at], page["null"][at], -own))[:k]
            out.append((np.full(len(order), row), at[order], own[order]))
        rows, at, own = (np.concatenate(x) if x else np.empty(0, np.int64) for x in zip(*out, strict=True))
        ids = pa.array(page["id"][at], mask=page["null"][at])
        return pa.RecordBatch.from_arrays(
            [batch.column(3).take(pa.array(rows)), batch.column(4).take(pa.array(rows)), pa.array(page["number"][at]), ids, pa.array(own)],
            ["query", "query_id", "number", "id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, page = None, [], None
        for (node, part, kind), rows in _runs(batches, 3):
            if (node, part) != at:
                at, held, page = (node, part), [], None
            if kind == 0:
                held.append(rows)
                continue
            if page is None:
                table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                order = np.argsort(-table.column(6).to_numpy(zero_copy_only=False), kind="stable")
                page = {
                    "number": table.column(3).to_numpy()[order],
                    "id": table.column(4).fill_null(0).to_numpy()[order],
                    "null": table.column(4).is_null().to_numpy(zero_copy_only=False)[order],
                    "v": _matrix(table.column(5), width)[order],
                    "distance": table.column(6).to_numpy(zero_copy_only=False)[order],
                }
            for start in range(0, rows.num_rows, 256):
                yield answers(page, rows.slice(start, 256))

    return run


def nearest(
    df: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = 256, page: int = PAGE
) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` highest products with every query row, ties to the smaller id.

    A null condition is none. Every other row is a candidate, also one with the query's id; of equal ids
    the row numbered first comes first, and a null id comes last. Vectors that are null or hold a null or
    non-finite component take no part. A shorter vector ends in zeros. A query row that comes twice is
    answered twice. Fewer candidates than ``k`` are all returned; without rows or queries there are none.
    """
    spark = df.sparkSession
    rows, count = materialise(
        df.select(
            F.monotonically_increasing_id().alias("number"),
            F.col(f"`{id_column}`").cast("long").alias("id"),
            whole_numbers(F.col(f"`{vector}`"), scale).alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        ).filter(F.col("v").isNotNull()),
        "vectors",
    )
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if not width:  # vectors without components: all products are 0
        rows, width = rows.withColumn("v", F.array(F.lit(0).cast("long"))), 1
    routing, pages = _tree(rows, count, width, page)
    queries, asking = materialise(rows.filter("asks").select(F.col("number").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("q")), "queries")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "number")
    hits = spark.createDataFrame([], _HIT)
    lowest = F.lit(float("-inf"))
    # Every query begins at the root.
    open_ = queries.select("query", F.lit(0).cast("long").alias("node"), F.lit(-1).alias("part"), F.lit(0.0).alias("product"), F.lit(float("inf")).alias("bound"))
    left, looks = asking, 1
    while left:
        reached = hits.groupBy("query").agg(F.count(F.lit(1)).alias("many"), F.min("score").cast("double").alias("low"))
        kths = queries.join(reached, "query", "left").select(
            "query", "query_id", "q", F.when(F.col("many") >= k, F.col("low")).otherwise(lowest).alias("kth")
        )
        kths, _ = materialise(kths, "kths")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "node", "part"))
        ranked, _ = materialise(open_.withColumn("rank", rank), "ranked")
        looked = ranked.filter(F.col("rank") <= looks).join(kths, "query")
        inner = looked.filter("part < 0").select(
            "node", F.lit(1).alias("kind"), *_missing(("child", "long"), ("o", "array<double>"), ("radius", "double"), ("above", "double"), ("parts", "int")),
            "query", F.col("q").alias("v"), "product", "kth",
        )
        objects = routing.select(
            F.col("parent").alias("node"), F.lit(0).alias("kind"), F.col("node").alias("child"), "o", "radius", "above", "parts",
            *_missing(("query", "long"), ("v", "array<long>"), ("product", "double"), ("kth", "double")),
        )
        wanted = objects.join(inner.select("node").distinct(), "node", "left_semi")
        met = wanted.unionByName(inner).repartition("node").sortWithinPartitions("node", "kind")
        children = met.mapInArrow(_expanded(width), _OPEN)
        asked = looked.filter("part >= 0").select(
            "node", "part", F.lit(1).alias("kind"), F.col("query").alias("number"), F.col("query_id").alias("id"),
            F.col("q").alias("v"), F.col("product").alias("distance"), "kth",
        )
        entries = pages.join(asked.select("node", "part").distinct(), ["node", "part"], "left_semi").select(
            "node", "part", F.lit(0).alias("kind"), "number", "id", "v", "distance", lowest.alias("kth")
        )
        read = entries.unionByName(asked).repartition("node", "part").sortWithinPartitions("node", "part", "kind")
        found = hits.unionByName(read.mapInArrow(_read(width, k), _HIT))
        hits, _ = materialise(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).drop("rank"), "hits")
        now = hits.groupBy("query").agg(F.count(F.lit(1)).alias("many"), F.min("score").cast("double").alias("low"))
        now = now.filter(F.col("many") >= k).select("query", "low")
        further = ranked.filter(F.col("rank") > looks).drop("rank").unionByName(children)
        open_, left = materialise(
            further.join(now, "query", "left").filter(F.col("low").isNull() | (F.col("bound") >= F.col("low"))).drop("low"), "open"
        )
        looks *= 4
    ranked = hits.withColumn("rank", F.row_number().over(best))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _missing(*columns: tuple[str, str]) -> list[Column]:
    return [F.lit(None).cast(kind).alias(name) for name, kind in columns]
