"""Many-hop questions over edge tables.

The driver only counts rounds. Every round is one distributed join whose new rows become one
partition of a table in the shared folder, so plans do not grow and a lost executor costs the
current round at most. The table is dealt by the state of a row, so a round shuffles what it reaches and
never what was found before. State is one row per (start, node) or (start, node, subtype), never one
row per path: diamonds do not multiply rows, and cycles end.

Both sides of every join on a node are scans of such tables, so a node with a third of all edges
is split by adaptive execution, and a small side is broadcast by its measured size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.sources.facts import DIRECT, DIRECT_SUBTYPES
from millrace.workspace import fresh_database, materialise


#: Edges of a graph for each bucket of the rows found in it.
BUCKET_EDGES = 50_000


class _Rounds:
    """Rows found so far: a table with one partition per round, dealt by the ``state`` columns.

    The table is bucketed by the state, so what was found before is joined with what a round reaches where
    it lies: only the new rows are shuffled. ``edges`` is the number of edges of the graph, from which the
    number of buckets follows.
    """

    def __init__(self, first: DataFrame, label: str, edges: int, state: Sequence[str] | None = None):
        self._spark = first.sparkSession
        self._state = list(state or first.columns)
        self._buckets = min(int(self._spark.conf.get("spark.sql.shuffle.partitions")), edges // BUCKET_EDGES + 1)
        self._table = f"{fresh_database(self._spark, label)}.found"
        self._columns = first.columns
        self.number = 0
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        self.number += 1
        seen = Observation()
        writer = (
            rows.observe(seen, F.count(F.lit(1)).alias("rows"))
            .withColumn("round", F.lit(self.number))
            .write.partitionBy("round")
            .bucketBy(self._buckets, *self._state)
        )
        writer.mode("append").saveAsTable(self._table)
        self.newest_rows = seen.get["rows"]

    def add_new(self, reached: DataFrame, *measures: Column) -> None:
        """Add the different rows of ``reached`` whose state was not found before, with measures over them."""
        self.add(_not_in(reached, self.all(), self._state, *measures))

    def all(self) -> DataFrame:
        return self._spark.table(self._table)

    def newest(self) -> DataFrame:
        return self.of(self.number)

    def of(self, number: int) -> DataFrame:
        """What one round has found."""
        return self.all().where(F.col("round") == number).select(*self._columns)


def _not_in(reached: DataFrame, found: DataFrame, state: Sequence[str], *measures: Column) -> DataFrame:
    """Different rows of ``reached`` whose state is not in ``found``, with measures over them."""
    different = reached.groupBy(*state).agg(*measures) if measures else reached.select(*state).distinct()
    return different.join(found.select(*state), list(state), "left_anti")


def _walk(
    first: DataFrame, advance: Callable[[DataFrame], DataFrame], edges: int, depth: int | None = None
) -> DataFrame:
    """Breadth first: what one hop reaches, then only what every further hop reaches anew.

    Ends when a round finds nothing new; only a given ``depth`` ends it before. Adds ``hops``.
    """
    state = first.columns
    found = _Rounds(first.distinct(), "hops", edges)
    while found.newest_rows and (depth is None or found.number < depth):
        found.add_new(advance(found.newest()).select(*state))
    return found.all().withColumnRenamed("round", "hops")


def reach(step: DataFrame, many: int, starts: DataFrame) -> DataFrame:
    """``node``: the starts and all that ``step`` (``node, next``, ``many`` rows) leads to from any of them, each once."""

    def advance(frontier: DataFrame) -> DataFrame:
        return frontier.join(step, "node").select(F.col("next").alias("node"))

    return _walk(starts.select("node"), advance, many).select("node")


def _all_pairs(links: DataFrame, depth: int | None = None) -> DataFrame:
    """All pairs ``start, node, hops`` up to ``depth`` hops; the longest path known doubles per round.

    A shortest path longer than ``span`` passes a node that is exactly ``span`` hops from its
    start, so only pairs of exactly that length are extended.
    """
    links, edges = materialise(links.distinct(), "links")
    found, span = _Rounds(links.withColumn("hops", F.lit(1)), "pairs", edges, ("start", "node")), 1
    while found.newest_rows and (depth is None or span < depth):
        reach = span if depth is None else min(span, depth - span)
        known = found.all().drop("round")
        left = found.newest().where(F.col("hops") == span).alias("l")
        right = known.where(F.col("hops") <= reach).alias("r")
        longer = (
            left.join(right, F.col("l.node") == F.col("r.start"))
            .where(F.col("l.start") != F.col("r.node"))
            .select("l.start", "r.node", (F.col("l.hops") + F.col("r.hops")).alias("hops"))
        )
        found.add_new(longer, F.min("hops").alias("hops"))
        span += reach
    return found.all().drop("round")


def _numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``start, node`` as numbers, and the ``name`` of each ``number``: what a walk moves and sorts is 16 bytes a row."""
    names = links.select(F.explode(F.array("start", "node")).alias("name")).distinct()
    names, _ = materialise(names.withColumn("number", F.monotonically_increasing_id()), "names")
    for end in ("start", "node"):
        links = links.withColumnRenamed(end, "name").join(names, "name").drop("name").withColumnRenamed("number", end)
    links, _ = materialise(links.select("start", "node"), "numbered")
    return links, names


def upstream(dataset_edges: DataFrame, depth: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """``dataset, upstream, hops``: all data sets that feed a data set, within ``depth`` hops if it is given.

    With ``starts`` (column ``dataset``) only what those data sets depend on is visited, hop by
    hop; without it the answer covers all data sets and takes a logarithmic number of rounds. Its
    size is that of the closure: ask it of a graph whose closure is wanted.
    """
    links = dataset_edges.select(F.col("out_dataset").alias("start"), F.col("in_dataset").alias("node")).where(
        F.col("start") != F.col("node")
    )
    if starts is None:
        pairs = _all_pairs(links, depth)
    else:
        edges, many = materialise(links.distinct(), "edges")
        edges, names = _numbered(edges)
        step = edges.select(F.col("start").alias("node"), F.col("node").alias("next"))

        def advance(frontier: DataFrame) -> DataFrame:
            onward = frontier.join(step, "node").where(F.col("start") != F.col("next"))
            return onward.select("start", F.col("next").alias("node"))

        wanted = names.join(starts.select(F.col("dataset").alias("name")), "name", "left_semi")
        wanted, _ = materialise(wanted.select(F.col("number").alias("start")), "starts")
        pairs = _walk(edges.join(wanted, "start"), advance, many, depth)
        for end in ("start", "node"):
            pairs = pairs.withColumnRenamed(end, "number").join(names, "number").drop("number").withColumnRenamed("name", end)
    return pairs.select(F.col("start").alias("dataset"), F.col("node").alias("upstream"), "hops")


def downstream(dataset_edges: DataFrame, depth: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """``dataset, downstream, hops``: all data sets that a data set feeds, within ``depth`` hops if it is given."""
    reverse = dataset_edges.select(F.col("in_dataset").alias("out_dataset"), F.col("out_dataset").alias("in_dataset"))
    return upstream(reverse, depth, starts).withColumnRenamed("upstream", "downstream")


OUT = ("out_dataset", "out_column")
IN = ("in_dataset", "in_column")


def _renamed(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(old, new)))


def _walk_columns(
    edges: DataFrame, many: int, starts: DataFrame, near: Sequence[str], far: Sequence[str], depth: int | None
) -> DataFrame:
    """Follow edges from their ``near`` end at ``starts`` to the ``far`` end, keeping the strongest subtype."""
    step = edges.select(
        *[F.col(old).alias(new) for old, new in zip(near, far)],
        *[F.col(old).alias(f"next_{old}") for old in far],
        F.col("strength").alias("next_strength"),
    )

    def advance(frontier: DataFrame) -> DataFrame:
        return frontier.join(step, list(far)).select(
            *near,
            *[F.col(f"next_{name}").alias(name) for name in far],
            F.greatest("strength", "next_strength").alias("strength"),
        )

    return _walk(edges.join(starts, list(near)).select(*near, *far, "strength"), advance, many, depth)


def _direct_edges(column_edges: DataFrame) -> tuple[DataFrame, int]:
    """Different direct edges with the ``strength`` of their subtype, written down, and how many they are."""
    strength = F.array_position(F.array(*[F.lit(kind) for kind in DIRECT_SUBTYPES]), F.col("subtype")).cast("int")
    return materialise(
        column_edges.where((F.col("type") == DIRECT) & F.col("subtype").isin(*DIRECT_SUBTYPES))
        .select(*OUT, *IN, strength.alias("strength"))
        .distinct(),
        "edges",
    )


def _ends(edges: DataFrame, starts: DataFrame | None) -> tuple[DataFrame, int, DataFrame, int]:
    """Mart columns and raw columns of direct edges, written down, and how many they are."""
    written, read = edges.select(*OUT).distinct(), edges.select(*IN).distinct()
    mart_columns = written.join(_renamed(read, IN, OUT), list(OUT), "left_anti") if starts is None else starts
    marts, mart_count = materialise(mart_columns.select(*OUT).distinct(), "marts")
    raws, raw_count = materialise(read.join(_renamed(written, OUT, IN), list(IN), "left_anti"), "raws")
    return marts, mart_count, raws, raw_count


def _subtype(strength: str) -> Column:
    return F.element_at(F.array(*[F.lit(subtype) for subtype in DIRECT_SUBTYPES]), F.col(strength))


def column_sources(column_edges: DataFrame, depth: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """From every mart column to the raw columns it comes from, with hops and effective subtype.

    Mart columns are ``starts`` (``out_dataset, out_column``), or else the columns no edge reads.
    Raw columns are those no edge writes. A path aggregates if one of its edges does, and
    transforms if one of its edges does and none aggregates. ``hops`` is the length of the
    shortest path of that subtype. The walk begins at the marts or at the raw columns,
    whichever are fewer, and gives the same answer from either side.
    """
    edges, many = _direct_edges(column_edges)
    marts, mart_count, raws, raw_count = _ends(edges, starts)
    if mart_count <= raw_count:
        paths = _walk_columns(edges, many, marts, OUT, IN, depth).join(raws, list(IN), "left_semi")
    else:
        paths = _walk_columns(edges, many, raws, IN, OUT, depth).join(marts, list(OUT), "left_semi")
    return paths.select(*OUT, *IN, _subtype("strength").alias("subtype"), "hops")


def column_paths(column_edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """One shortest path for every row of ``column_sources``, a row for each column on it.

    ``out_dataset, out_column`` is the mart column, ``in_dataset, in_column`` the raw one, ``subtype`` that of the
    whole path; ``position`` counts from 0 at the mart column, and ``dataset, column`` is what stands there. Of
    several shortest paths the one whose columns, seen from the raw end, come first by name is taken (of two edges
    between the same columns, the path that is the weaker up to there).

    The walk begins at the marts or at the raw columns, whichever are fewer, and gives the same answer from
    either side.
    """
    edges, many = _direct_edges(column_edges)
    marts, mart_count, raws, raw_count = _ends(edges, starts)
    side = _paths_from_marts if mart_count <= raw_count else _paths_from_raws
    parts = side(edges, many, marts, raws)
    found_paths = parts[0]
    for part in parts[1:]:
        found_paths = found_paths.unionByName(part)
    return found_paths.select(*OUT, *IN, _subtype("kind").alias("subtype"), "position", "dataset", "column")


def _paths_from_marts(edges: DataFrame, many: int, marts: DataFrame, raws: DataFrame) -> list[DataFrame]:
    """Rows of ``column_paths``, ``kind`` being the strength of a path.

    Every state of the walk keeps the smallest state that it was reached from. The paths are then read backward,
    a hop at a time, and each hop meets only the states of its own round.
    """
    state = [*OUT, *IN, "strength"]
    nobody = F.lit(None).cast("struct<in_dataset: string, in_column: string, strength: int>")
    step = edges.select(
        *[F.col(old).alias(new) for old, new in zip(OUT, IN)],
        *[F.col(name).alias(f"next_{name}") for name in IN],
        F.col("strength").alias("next_strength"),
    )
    found = _Rounds(edges.join(marts, list(OUT)).select(*state).distinct().withColumn("before", nobody), "paths", many, state)
    while found.newest_rows:
        reached = found.newest().join(step, list(IN)).select(
            *OUT,
            *[F.col(f"next_{name}").alias(name) for name in IN],
            F.greatest("strength", "next_strength").alias("strength"),
            F.struct(*IN, "strength").alias("before"),
        )
        found.add_new(reached, F.min("before").alias("before"))
    ends, rows = materialise(found.all().join(raws, list(IN), "left_semi"), "ends")
    whole = [*OUT, F.struct(*IN, "strength").alias("end")]
    first = ends.select(*whole, F.lit(0).alias("position"), F.col("out_dataset").alias("dataset"), F.col("out_column").alias("column"))
    parts, going = [first], None
    for number in range(found.number if rows else 0, 0, -1):
        # Paths that end in this round, and those that come back from the next one.
        here = ends.where(F.col("round") == number).select(*whole, *IN, "strength")
        here = here if going is None else here.unionByName(going)
        met, _ = materialise(here.join(found.of(number), state).select(*OUT, "end", *IN, "before"), "hop")
        parts.append(
            met.select(*OUT, "end", F.lit(number).alias("position"), F.col("in_dataset").alias("dataset"), F.col("in_column").alias("column"))
        )
        going = met.select(*OUT, "end", "before.*")
    return [part.select(*OUT, "end.in_dataset", "end.in_column", F.col("end.strength").alias("kind"), "position", "dataset", "column") for part in parts]


def _paths_from_raws(edges: DataFrame, many: int, marts: DataFrame, raws: DataFrame) -> list[DataFrame]:
    """The same rows, walking from the raw columns.

    A state is a column, a raw column, the ``kind`` of the whole path and how strong the path is ``so_far``, from the
    mart column to here (0 at the mart column itself); it keeps the first of the states that follow on a shortest
    path. First is what has the lowest ``place``: the states of a round are sorted by the place of what follows
    them, then by name and strength, so places compare whole paths as seen from the raw end.
    """
    node = ("node_dataset", "node_column")
    state = [*node, *IN, "kind", "so_far"]
    ordered = ["before.place", *node, "so_far", *IN, "kind"]
    read = _renamed(edges.select(*IN).distinct(), IN, OUT).withColumn("is_read", F.lit(True))
    step = edges.join(marts.withColumn("is_mart", F.lit(True)), list(OUT), "left").join(read, list(OUT), "left")
    step, _ = materialise(
        step.select(
            *[F.col(old).alias(new) for old, new in zip(IN, node)],
            *[F.col(old).alias(f"next_{new}") for old, new in zip(OUT, node)],
            "strength",
            *[F.coalesce(name, F.lit(False)).alias(name) for name in ("is_mart", "is_read")],
        ),
        "onward",
    )

    def advance(frontier: DataFrame) -> DataFrame:
        # What a path may be before an edge so that it is ``so_far`` behind it.
        weaker = F.when(F.col("strength") == F.col("so_far"), F.sequence(F.lit(0), "so_far")).otherwise(F.array("so_far"))
        allowed = F.filter(weaker, lambda x: F.when(x == 0, F.col("is_mart")).otherwise(F.col("is_read")))
        return (
            frontier.join(step, list(node))
            .where(F.col("strength") <= F.col("so_far"))
            .select(
                *[F.col(f"next_{name}").alias(name) for name in node],
                *IN,
                "kind",
                F.explode(allowed).alias("before_edge"),
                F.struct("place", *node, "so_far").alias("before"),
            )
            .withColumnRenamed("before_edge", "so_far")
        )

    smallest = F.min("before").alias("before")
    kinds = F.explode(F.array(*[F.lit(k + 1) for k in range(len(DIRECT_SUBTYPES))]))
    begin = raws.select(*[F.col(old).alias(new) for old, new in zip(IN, node)], *IN, kinds.alias("kind"))
    begin = begin.select("*", F.col("kind").alias("so_far"), F.lit(0).cast("bigint").alias("place"))
    found = _Rounds(advance(begin).groupBy(*state).agg(smallest), "paths", many, state)
    rounds = []
    while found.newest_rows:
        onward = found.newest().where("so_far > 0").orderBy(*ordered)
        placed, _ = materialise(onward.withColumn("place", F.monotonically_increasing_id()), "placed")
        rounds.append(placed)
        found.add_new(advance(placed), smallest)
    ends, _ = materialise(found.all().where("so_far = 0"), "ends")
    whole = [*OUT, *IN, "kind", "length"]
    met, parts = None, []
    for number in range(len(rounds), 0, -1):
        # Paths that begin in this round, and those that come from the one before.
        here = ends.where(F.col("round") == number).select(
            *[F.col(old).alias(new) for old, new in zip(node, OUT)], *IN, "kind", F.col("round").alias("length"), *node, "before"
        )
        if met is not None:
            going = met.select(*whole, "before.*").drop("place")
            here = here.unionByName(going.join(rounds[number - 1].select(*state, "before"), state).select(*whole, *node, "before"))
        met, _ = materialise(here, "hop")
        parts.append(met.select(*whole[:-1], (F.col("length") - number).alias("position"), *node))
    if met is None:
        met = begin.limit(0).select(*[F.col(old).alias(new) for old, new in zip(node, OUT)], *IN, "kind", F.lit(0).alias("length"))
    parts.append(met.select(*whole[:-1], F.col("length").alias("position"), *[F.col(old).alias(new) for old, new in zip(IN, node)]))
    return [part.withColumnsRenamed({"node_dataset": "dataset", "node_column": "column"}) for part in parts]


def without_hidden(dataset_edges: DataFrame, hidden: DataFrame) -> DataFrame:
    """The graph that remains if the ``hidden`` data sets (column ``dataset``) are never written.

    A visible data set is then fed directly by the nearest visible ones behind the hidden ones.
    """
    edges, many = materialise(dataset_edges.select("out_dataset", "in_dataset").distinct(), "edges")
    gone, _ = materialise(hidden.select(F.col("dataset").alias("out_dataset")).distinct(), "hidden")
    hidden_inputs = _renamed(gone, ["out_dataset"], ["in_dataset"])
    visible = edges.join(gone, "out_dataset", "left_anti")
    # Only hidden nodes lead on, so the walk stops at the first visible ones.
    step, _ = materialise(
        edges.join(gone, "out_dataset", "left_semi").select(
            F.col("out_dataset").alias("in_dataset"), F.col("in_dataset").alias("next")
        ),
        "onward",
    )

    def advance(frontier: DataFrame) -> DataFrame:
        return frontier.join(step, "in_dataset").select("out_dataset", F.col("next").alias("in_dataset"))

    behind = _walk(
        visible.join(hidden_inputs, "in_dataset", "left_semi").select("out_dataset", "in_dataset"), advance, many
    ).drop("hops")
    return (
        visible.unionByName(behind)
        .join(hidden_inputs, "in_dataset", "left_anti")
        .select("out_dataset", "in_dataset")
        .distinct()
    )


def lineage_graph(job_io: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """``start, id, type, direction, hops``: data sets and jobs before and after given nodes.

    ``starts`` has ``id`` and ``type`` (``DATASET`` or ``JOB``). A hop leads from a data set to a job that
    reads or writes it, or from a job to one of its data sets. Versions of a job are one node.
    """
    is_input = F.coalesce(F.col("role") == "INPUT", F.lit(False))
    job = F.concat(F.lit("JOB/"), "job").alias("job")
    dataset = F.concat(F.lit("DATASET/"), "dataset").alias("dataset")
    ends = job_io.select(job, dataset, is_input.alias("is_input"))
    reads, read = materialise(ends.where("is_input").select("job", "dataset").distinct(), "reads")
    writes, wrote = materialise(ends.where("not is_input").select("job", "dataset").distinct(), "writes")
    named = starts.select(F.concat("type", F.lit("/"), "id").alias("start")).distinct()
    wanted = {kind: materialise(named.where(F.startswith("start", F.lit(f"{kind}/"))), "starts") for kind in ("DATASET", "JOB")}
    other = {"DATASET": "JOB", "JOB": "DATASET"}

    def reached(of_datasets: DataFrame, of_jobs: DataFrame, direction: str) -> DataFrame:
        # Data sets and jobs take turns, so a round meets the links of its own kind of nodes only.
        links = {
            "DATASET": of_datasets.select(F.col("dataset").alias("node"), F.col("job").alias("next")),
            "JOB": of_jobs.select(F.col("job").alias("node"), F.col("dataset").alias("next")),
        }
        turns = [kind for kind, (_, many) in wanted.items() if many] or ["DATASET"]
        first = reduce(
            DataFrame.unionByName,
            [
                links[kind].join(wanted[kind][0], F.col("node") == F.col("start")).select("start", F.col("next").alias("node"))
                for kind in turns
            ],
        )

        def advance(frontier: DataFrame) -> DataFrame:
            turns[:] = [other[kind] for kind in turns]
            onward = reduce(DataFrame.unionByName, [frontier.join(links[kind], "node") for kind in turns])
            return onward.where(F.col("start") != F.col("next")).select("start", F.col("next").alias("node"))

        return _walk(first, advance, read + wrote, depth).withColumn("direction", F.lit(direction))

    both = reached(writes, reads, "UPSTREAM").unionByName(reached(reads, writes, "DOWNSTREAM"))

    def cut(node: str, what: str) -> Column:
        return F.regexp_extract(node, "(?s)^([^/]*)/(.*)$", 1 if what == "type" else 2)

    return both.select(
        cut("start", "id").alias("start"), cut("node", "id").alias("id"), cut("node", "type").alias("type"), "direction", "hops"
    )
