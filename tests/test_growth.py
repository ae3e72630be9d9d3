"""What grows with the input only as fast as it must: rows of walks, shapes of plans, memory of a task."""

from __future__ import annotations

import bisect
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.lineage import asof, edges, graph, order
from millrace.sources.facts import COLUMN_EDGES, DIRECT_SUBTYPES
from test_plans import plan, written  # noqa: F401

PAIRS = "out_dataset STRING, in_dataset STRING"


@pytest.fixture
def found_rows(monkeypatch):
    """How many rows each round of a walk has written."""
    seen, kept = [], graph._Rounds.add

    def add(self, rows):
        kept(self, rows)
        seen.append(self.newest_rows)

    monkeypatch.setattr(graph._Rounds, "add", add)
    return seen


def _columns(spark, links):
    return spark.createDataFrame(
        [("j", "1", f"t{a // 3}", f"c{a % 3}", f"t{b // 3}", f"c{b % 3}", "DIRECT", DIRECT_SUBTYPES[k]) for a, b, k in links], COLUMN_EDGES
    )


@pytest.mark.parametrize("seed", range(2))
def test_paths_are_the_same_from_either_end(spark, rows, seed):
    draw, links = random.Random(seed), []
    for _ in range(36):
        a, b = draw.randrange(14), draw.randrange(14)
        links.append((*((b + 1, a) if seed < 2 and a <= b else (a, b)), draw.randrange(3)))
    starts = spark.createDataFrame([("t3", "c0"), ("t3", "c1"), ("t1", "c1")], "out_dataset STRING, out_column STRING") if seed else None
    direct, many = graph._direct_edges(_columns(spark, links))
    marts, _, raws, _ = graph._ends(direct, starts)
    one, other = ([rows(part) for part in side(direct, many, marts, raws)] for side in (graph._paths_from_marts, graph._paths_from_raws))
    assert sorted(x for part in one for x in part) == sorted(x for part in other for x in part)


def test_paths_begin_at_the_fewer_ends(spark, found_rows):
    """120 marts above 30 columns in a row above one raw column."""
    links = [(k + 1, k, 0) for k in range(30)] + [(31 + k, 30, 0) for k in range(120)]
    paths = graph.column_paths(_columns(spark, links))
    assert paths.count() == 120 * 32
    assert sum(found_rows) <= 120 * 3 + 30 * 6


def test_few_last_versions_are_broadcast(spark):
    lines = spark.range(1000).selectExpr(
        "'load' AS job", "string(id % 2) AS version", "'s' || id AS out_dataset", "'c' AS out_column", "'f' AS in_dataset", "'c' AS in_column",
        "'DIRECT' AS type", "'IDENTITY' AS subtype",
    )
    times = spark.range(1000).selectExpr("'load' AS job", "string(id % 2) AS version", "timestamp_seconds(id) AS ts")
    text = plan(edges.latest_edges(lines, times))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_repetitions_are_removed_from_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(edges, "TASK_EDGES", 100)
    found = edges.different(spark.range(1000).selectExpr("id % 7 AS a", "id % 2 AS b"), "a", "b", most=1000)
    assert "hashpartitioning(a#" in plan(found) and ", 11), REPARTITION_BY_NUM" in plan(found)
    assert found.count() == 14


def test_what_failed_is_walked_once(spark, found_rows, rows):
    """All of a chain has failed: a row for each data set, not for each pair."""
    chain = spark.createDataFrame([(f"d{k + 1}", f"d{k}") for k in range(20)], PAIRS)
    failed = spark.createDataFrame([(f"d{k}",) for k in range(21)], "dataset STRING")
    assert rows(order.rerun_order(chain, failed)) == sorted((f"d{k}", k) for k in range(21))
    assert sum(found_rows) == 21


def test_levels_are_read_in_one_scan(spark, written, rows):  # noqa: F811
    chain = spark.createDataFrame([(f"d{k + 1}", f"d{k}") for k in range(9)], PAIRS)
    assert rows(order.levels(chain)) == sorted((f"d{k}", k) for k in range(10))
    assert not any("Union" in text and "max(level" in text for text in written)


def test_ranges_of_time_are_found_by_halving(spark):
    bounds = sorted(random.Random(1).sample(range(2000), 255))
    found = spark.range(2100).select("id", asof._range_of(F.col("id"), bounds).alias("range"))
    assert "lambda" not in plan(found)
    assert all(row["range"] == bisect.bisect_right(bounds, row["id"]) for row in found.collect())
    assert spark.range(1).select(asof._range_of(F.col("id"), [])).first()[0] == 0


def test_a_walk_moves_numbers(spark, monkeypatch, rows):
    types, kept = [], graph._Rounds.add
    monkeypatch.setattr(graph._Rounds, "add", lambda self, found: (types.append({t for _, t in found.dtypes}), kept(self, found)))
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c"), (None, "a")], PAIRS)
    starts = spark.createDataFrame([("c",), ("c",), (None,), ("elsewhere",)], "dataset STRING")
    assert rows(graph.upstream(links, starts=starts)) == [("c", "a", 2), ("c", "b", 1)]
    assert types and all(t == {"bigint"} for t in types)


def test_a_round_meets_links_of_its_own_kind(spark, written, rows):  # noqa: F811
    """Starts are data sets: the second round joins what jobs read, and not what they write."""
    io = [("j1", "INPUT", "a"), ("j1", "OUTPUT", "b"), ("j2", "INPUT", "b"), ("j2", "OUTPUT", "c"), ("j2", None, "d")]
    io = spark.createDataFrame([(job, "1", role, name) for job, role, name in io], "job STRING, version STRING, role STRING, dataset STRING")
    found = graph.lineage_graph(io, spark.createDataFrame([("c", "DATASET")], "id STRING, type STRING"))
    assert rows(found) == [("c", "a", "DATASET", "UPSTREAM", 4), ("c", "b", "DATASET", "UPSTREAM", 2), ("c", "j1", "JOB", "UPSTREAM", 3), ("c", "j2", "JOB", "UPSTREAM", 1)]
    joins = [text for text in written if "LeftAnti" in text]
    assert joins and all(("/reads-" in text) != ("/writes-" in text) for text in joins)
    mixed = spark.createDataFrame([("b", "DATASET"), ("j2", "JOB")], "id STRING, type STRING")
    assert graph.lineage_graph(io, mixed).groupBy("start", "direction").count().count() == 4
