"""Cycles and levels of a data set graph: in which order data sets can be made again.

Nodes whose inputs are all settled leave in rounds, sources first; so do, on the way to the cycles, nodes
that nothing open reads. What is left lies on or between cycles. There a node takes the smallest name that
reaches it; the nodes whose name is their own and what reads into them within the same name are one
cycle each, and leave; the rest goes on. The driver only counts rows; every round is written to the
shared folder, and only edges that are still open are moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.operators.lineage.graph import reach
from millrace.workspace import fresh_path, materialise, write_counted

#: Rows that one task takes the highest levels of.
TASK_ROWS = 1_000_000


def _peeled(edges: DataFrame, end: str, other: str) -> DataFrame:
    """Edges ``a, b`` without those that lead, over any number of edges, only to nodes without an edge at ``end``."""
    edges, left = materialise(edges, "open")
    before = None
    while left and left != before:
        before = left
        going_on = edges.select(F.col(end).alias("node")).distinct()
        edges, left = materialise(edges.join(going_on, edges[other] == going_on["node"], "left_semi"), "open")
    return edges


def _spread(named: DataFrame, steps: DataFrame) -> DataFrame:
    """``node, name``: the smallest name that a node has of its own or over ``steps`` (``node, next``)."""
    newest = named
    while True:
        offered = newest.join(steps, "node").groupBy(F.col("next").alias("node")).agg(F.min("name").alias("offer"))
        better = F.coalesce(F.col("offer") < F.col("name"), F.lit(False))
        path, seen = fresh_path(named.sparkSession, "named"), Observation()
        both = named.join(offered, "node", "left").select(
            "node", F.when(better, F.col("offer")).otherwise(F.col("name")).alias("name"), better.alias("renamed")
        )
        both.observe(seen, F.count(F.when(F.col("renamed"), 1)).alias("renamed")).write.parquet(path)
        written = named.sparkSession.read.schema(both.schema).parquet(path)
        named, newest = written.select("node", "name"), written.where("renamed").select("node", "name")
        if not seen.get["renamed"]:
            return named


def cycles(dataset_edges: DataFrame) -> DataFrame:
    """``dataset, cycle``: the data sets that feed themselves over others, with the smallest of those they share cycles with.

    Two data sets have one ``cycle`` if each feeds the other. An edge of a data set to itself makes no cycle.
    """
    spark = dataset_edges.sparkSession
    edges = dataset_edges.select(F.col("out_dataset").alias("a"), F.col("in_dataset").alias("b")).where("a <> b").distinct()
    found = spark.createDataFrame([], "dataset STRING, cycle STRING")
    while True:
        edges = _peeled(_peeled(edges, "a", "b"), "b", "a")
        edges, left = materialise(edges, "cyclic")
        if not left:
            return found
        nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
        nodes, _ = materialise(nodes.select("node", F.col("node").alias("name")), "nodes")
        # Data flows from b to a: the smallest name upstream of each node, its own included.
        named = _spread(nodes, edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
        sides = edges.join(named.select(F.col("node").alias("a"), F.col("name").alias("of_a")), "a").join(
            named.select(F.col("node").alias("b"), F.col("name").alias("of_b")), "b"
        )
        inner, _ = materialise(sides.where("of_a = of_b").select("a", "b", F.col("of_a").alias("name")), "inner")
        # Back from the nodes that gave their names, within the same name: what feeds them is their cycle.
        reached, rows = materialise(named.where("node = name"), "reached")
        members = reached
        while rows:
            further = inner.join(reached.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node"), "name").distinct()
            reached, rows = materialise(further.join(members, "node", "left_anti"), "reached")
            members = members.unionByName(reached)
        members, _ = materialise(members, "members")
        sizes = members.groupBy("name").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
        whole = members.join(sizes, "name").select(F.col("node").alias("dataset"), F.col("name").alias("cycle"))
        found, _ = materialise(found.unionByName(whole), "cycles")
        done = members.select(F.col("node").alias("done"))
        edges = edges.join(done, edges["a"] == done["done"], "left_anti").join(
            done.withColumnRenamed("done", "done_b"), F.col("b") == F.col("done_b"), "left_anti"
        )


def levels(dataset_edges: DataFrame, of_cycles: DataFrame | None = None) -> DataFrame:
    """``dataset, level``: 0 without inputs, otherwise one more than the highest level of an input.

    The level is that of the longest way from a source. Data sets of one cycle have one level, as if they were
    one data set. ``of_cycles`` is the result of ``cycles``, if it is at hand.
    """
    edges = dataset_edges.select(F.col("out_dataset").alias("a"), F.col("in_dataset").alias("b")).distinct()
    nodes, _ = materialise(edges.select(F.explode(F.array("a", "b")).alias("dataset")).distinct(), "nodes")
    if of_cycles is None:
        settled, rest, left = _leveled(edges)
        if not left:  # no cycles
            return _with_levels(nodes.select("dataset", F.col("dataset").alias("node")), settled)
        of_cycles = cycles(rest.select(F.col("a").alias("out_dataset"), F.col("b").alias("in_dataset")))
    grouped, _ = materialise(of_cycles, "cycles")
    for end in ("a", "b"):
        of = grouped.select(F.col("dataset").alias(end), F.col("cycle").alias("whole"))
        edges = edges.join(of, end, "left").withColumn(end, F.coalesce("whole", end)).drop("whole")
    settled, _, left = _leveled(edges.select("a", "b"))
    if left:
        raise ValueError("of_cycles does not hold every cycle of the graph")
    return _with_levels(nodes.join(grouped, "dataset", "left").select("dataset", F.coalesce("cycle", "dataset").alias("node")), settled)


def _leveled(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``node, level`` of the nodes with inputs that are not on or behind a cycle, the edges never settled, and how many.

    A node has open inputs in as many rounds as its level says. The open edges of every round are a partition of
    one table, which is read once for all levels.
    """
    spark, root = edges.sparkSession, fresh_path(edges.sparkSession, "open")
    level, rows, before = 1, 0, None
    edges = edges.select("a", "b").where("a <> b").distinct()
    left = write_counted(edges, f"{root}/level=1")
    while left and left != before:
        before, rows, level = left, rows + left, level + 1
        edges = spark.read.schema(edges.schema).parquet(f"{root}/level={level - 1}")
        heads = edges.select(F.col("a").alias("node")).distinct()
        left = write_counted(edges.join(heads, edges["b"] == heads["node"], "left_semi"), f"{root}/level={level}")
    every = spark.read.schema("a string, b string, level int").option("basePath", root).parquet(root)
    # Dealt by node before the highest is taken: what a task holds is bounded by TASK_ROWS.
    dealt = every.select("a", "level").repartition(rows // TASK_ROWS + 1, "a")
    settled, _ = materialise(dealt.groupBy(F.col("a").alias("node")).agg(F.max("level").alias("level")), "levels")
    return settled, spark.read.schema(edges.schema).parquet(f"{root}/level={level}"), left


def _with_levels(named: DataFrame, settled: DataFrame) -> DataFrame:
    return named.join(settled, "node", "left").select("dataset", F.coalesce("level", F.lit(0)).alias("level"))


def rerun_order(dataset_edges: DataFrame, failed: DataFrame) -> DataFrame:
    """``dataset, level``: what has to be made again after the ``failed`` ones (column ``dataset``), in the order of levels.

    That is the failed data sets and all that they feed. Those of one level do not need each other, but for
    the data sets of one cycle.
    """
    edges, many = materialise(dataset_edges.select(F.col("in_dataset").alias("node"), F.col("out_dataset").alias("next")).distinct(), "fed")
    again = reach(edges, many, failed.select(F.col("dataset").alias("node"))).withColumnRenamed("node", "dataset")
    return levels(dataset_edges).join(again, "dataset", "left_semi")
