"""Renames by content, widened reads, the schema that a run saw, merged marts, slices and drawn numbers."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import uniform
from millrace.operators import marts, measures
from millrace.operators.lineage import asof, content, graph
from millrace.sinks.writers import rewrite_partitions
from millrace.sources.facts import COLUMN_EDGES
from millrace.sources.widened import common_schema, common_type, read_widened, schema_groups

DAY = datetime(2024, 1, 1)


# Renames


def _people(spark, many=300):
    rows = [(k, f"name {k % 97}", f"p{k}@x", k * 2, None) for k in range(many)]
    return spark.createDataFrame(rows, "id LONG, name STRING, email STRING, score INT, nothing STRING")


def test_renamed_column_is_found_among_others(spark):
    before = _people(spark)
    after = before.select("id", F.col("name").alias("full_name"), F.upper("email").alias("mail"), F.col("score").cast("long").alias("points"))
    found = {tuple(r) for r in content.renames_by_content(before, after).collect()}
    assert found == {("name", "full_name"), ("score", "points")}  # the e-mails changed, and their types need not agree


def test_renames_need_their_overlap(spark):
    before = _people(spark).select("id", "email")
    after = before.select("id", F.when(F.col("id") < 200, F.col("email")).otherwise(F.concat("email", F.lit("x"))).alias("mail"))
    # 200 values in common, 400 in either
    assert content.renames_by_content(before, after, least=0.5).count() == 1
    assert content.renames_by_content(before, after, least=0.51).count() == 0


def test_the_best_match_wins_and_empty_columns_match_nothing(spark):
    before = _people(spark).select(F.col("email").alias("a"), F.when(F.col("id") < 250, F.col("email")).alias("b"), F.col("nothing"))
    after = _people(spark).select(F.col("email").alias("c"), F.col("nothing").alias("void"))
    assert [tuple(r) for r in content.renames_by_content(before, after).collect()] == [("a", "c")]
    assert content.renames_by_content(before.limit(0), after.limit(0)).count() == 0
    assert content.renames_by_content(before, before).count() == 0


def test_large_columns_by_their_sketches(spark):
    """More values than a sketch of 2**9 hashes holds: the estimate decides, and its error is small."""
    before = spark.range(200_000).select(F.col("id").alias("old"))
    after = before.select(F.col("old").alias("new"), (F.col("old") + 100_000).alias("shifted"))
    found = content.renames_by_content(before, after, least=0.7, log_hashes=9)
    assert [tuple(r) for r in found.collect()] == [("old", "new")]
    assert content.renames_by_content(before, after.select("shifted"), least=0.5, log_hashes=9).count() == 0


def test_history_of_renames(spark):
    one = _people(spark).select("id", "name")
    two = one.withColumnRenamed("name", "title")
    found = content.history_of_renames([one, one, two, one])
    assert sorted(tuple(r) for r in found.collect()) == [(3, "name", "title"), (4, "title", "name")]
    with pytest.raises(ValueError):
        content.history_of_renames([one])


# Widened reads


def test_common_types():
    integer, big, double, text = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()
    assert common_type(integer, big) == common_type(big, integer) == big
    assert common_type(big, double) == common_type(T.FloatType(), integer) == double
    assert common_type(double, text) == common_type(T.BooleanType(), integer) == text
    assert common_type(T.DecimalType(10, 2), big) == T.DecimalType(21, 2)
    assert common_type(T.DecimalType(38, 10), big) == T.DecimalType(38, 10)
    assert common_type(T.DecimalType(38, 30), big) == text
    assert common_type(T.DateType(), T.TimestampNTZType()) == T.TimestampNTZType()
    merged = common_schema([T.StructType().add("a", integer), T.StructType().add("b", text).add("a", double)])
    assert [(f.name, f.dataType) for f in merged] == [("a", double), ("b", text)]


def test_batches_of_all_types_are_one_table(spark, folder):
    spark.range(3).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("v")).write.mode("append").parquet(folder)
    spark.range(3, 6).select(F.col("id").alias("k"), (F.col("id") + 2**40).alias("v"), F.lit("x").alias("more")).write.mode("append").parquet(folder)
    spark.range(6, 9).select("id", F.col("id").alias("k"), F.lit(0.5).alias("v")).write.mode("append").parquet(folder)
    found = read_widened(spark, folder, "k", "v", "more", "id")
    assert dict(found.dtypes) == {"k": "bigint", "v": "double", "more": "string", "id": "bigint"}
    expected = {(k, 1.0, None, None) for k in range(3)} | {(k, float(k + 2**40), "x", None) for k in range(3, 6)}
    assert {tuple(r) for r in found.collect()} == expected | {(k, 0.5, None, k) for k in range(6, 9)}
    spark.createDataFrame([(9, "n/a")], "k INT, v STRING").write.mode("append").parquet(folder)
    texts = {r.k: r.v for r in read_widened(spark, folder, "k", "v").collect()}
    assert texts[9] == "n/a" and texts[0] == "1" and texts[6] == "0.5" and len(texts) == 10
    with pytest.raises(Exception, match="MERGE"):
        spark.read.option("mergeSchema", "true").parquet(folder)


def test_files_that_agree_are_read_together(spark, folder):
    for turn in range(4):
        kind = "int" if turn % 2 else "string"
        spark.range(8).select(F.col("id").cast(kind).alias("v")).repartition(4).write.mode("append").parquet(folder)
    files = sorted(str(p) for p in Path(folder).rglob("*.parquet"))
    groups = schema_groups(spark, files, folder)
    assert sorted(len(part) for _, part in groups) == [8, 8]
    assert read_widened(spark, folder, "v").count() == 32


def test_partition_columns_stay(spark, folder):
    spark.range(4).select("id", F.lit(1).alias("day")).write.partitionBy("day").mode("append").parquet(folder)
    spark.range(4).select(F.col("id").cast("string"), F.lit(2).alias("day")).write.partitionBy("day").mode("append").parquet(folder)
    assert {(r.id, r.day) for r in read_widened(spark, folder, "id", "day").collect()} == {(str(k), d) for k in range(4) for d in (1, 2)}


# The schema that a run saw


@pytest.mark.parametrize("ranges", [1, 4, 256])
def test_schema_of_every_run(spark, ranges):
    draw = random.Random(ranges)
    moment = lambda: DAY + timedelta(minutes=draw.randrange(500))
    versions = [("n", f"d{draw.randrange(4)}", v, moment()) for v in range(30)] + [("n", "d0", 99, None)]
    runs = [(k, "n", "d0" if k % 3 else f"d{draw.randrange(5)}", moment()) for k in range(400)]
    runs += [(900, "n", "d1", None), (901, None, "d1", DAY), (902, "n", "d0", versions[0][3]), (902, "n", "d0", versions[0][3])]
    found = asof.schema_of_runs(
        spark.createDataFrame(runs, "run_id LONG, namespace STRING, name STRING, started_at TIMESTAMP_NTZ").repartition(3),
        spark.createDataFrame(versions, "namespace STRING, name STRING, version INT, since TIMESTAMP_NTZ"),
        ranges,
    )

    def plain(run):
        seen = [(since, v) for n, d, v, since in versions if (n, d) == run[1:3] and since is not None and run[3] is not None and since <= run[3]]
        return (*run, max(seen)[1] if seen else None)

    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(map(plain, runs), key=repr)


def test_a_hot_data_set_is_worked_on_in_ranges(spark, monkeypatch):
    """A third of all runs read one data set; no window holds more than a few ranges of them."""
    runs = spark.range(3000).select(
        F.col("id").alias("run_id"), F.lit("n").alias("namespace"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("d"), F.col("id") % 50)).alias("name"),
        F.timestamp_seconds(F.col("id") * 7).cast("timestamp_ntz").alias("started_at"),
    )
    versions = runs.where("run_id % 100 = 0").select("namespace", "name", F.col("run_id").cast("int").alias("version"), F.col("started_at").alias("since"))
    windows = []
    plain = asof.materialise

    def looked_at(df, label):
        if label == "found":
            windows.append(df._jdf.queryExecution().optimizedPlan().toString())
            assert "range" in windows[0].split("windowspecdefinition(")[1].split("ASC")[0]
        return plain(df, label)

    monkeypatch.setattr(asof, "materialise", looked_at)
    found = asof.schema_of_runs(runs, versions, ranges=32)
    assert windows and found.count() == 3000
    times = runs.where("name = 'hot'").count()
    assert times == 1000  # of which a range of 32 holds about a 32nd


# Marts by batches


def test_merged_mart_equals_the_whole_after_every_batch(spark, rows):
    draw = random.Random(4)
    orders = [
        (k, None if k % 41 == 0 else draw.choice([3, 40_000, 2**40, draw.randrange(200_000)]), None if k % 17 == 0 else Decimal(draw.randrange(10**6)) / 100,
         DAY + timedelta(hours=draw.randrange(999)), draw.choice(["x", "y", None]))
        for k in range(600)
    ]
    schema = "order_id LONG, customer_id LONG, amount DECIMAL(18,2), order_ts TIMESTAMP_NTZ, country STRING"
    kept, so_far = None, []
    for batch in (orders[:200], orders[200:201], [], orders[201:]):
        so_far += batch
        kept = marts.merged_mart(spark.createDataFrame(batch, schema), "country", kept)
        whole = marts.mart_of(spark.createDataFrame(so_far, schema), "country")
        assert rows(marts.mart(kept, "country").select(*whole.columns)) == rows(whole)
    assert kept[0].count() == 3


def test_a_merge_reads_only_the_new_batch(spark, folder):
    for k in range(2):
        spark.range(k * 100, k * 100 + 100).select(
            F.col("id").alias("customer_id"), F.lit(Decimal("1.00")).alias("amount"), F.lit(DAY).cast("timestamp_ntz").alias("order_ts"), F.lit("x").alias("country")
        ).write.parquet(f"{folder}/batch{k}")
    kept = marts.merged_mart(spark.read.parquet(f"{folder}/batch0"), "country")
    kept = marts.merged_mart(spark.read.parquet(f"{folder}/batch1"), "country", kept)
    files = [name for part in kept for name in part.inputFiles()]
    assert files and not any("batch" in name for name in files)
    assert marts.mart(kept, "country").first().unique_customers == 200


# Slices


def test_only_slices_with_rows_are_replaced(spark, folder, rows):
    first = spark.range(30).select("id", (F.col("id") % 3).alias("day"))
    rewrite_partitions(first, folder, "day")
    files = {str(p) for p in Path(folder).rglob("*.parquet")}
    again = first.where("day = 1").withColumn("id", F.col("id") + 1000)
    for _ in range(5):
        rewrite_partitions(again, folder, "day")
    now = {str(p) for p in Path(folder).rglob("*.parquet")}
    assert {f for f in files if "day=1" not in f} <= now and not {f for f in files if "day=1" in f} & now
    left = spark.read.parquet(folder).select("id", F.col("day").cast("long"))
    assert rows(left) == rows(first.where("day <> 1").unionByName(again))
    rewrite_partitions(first.limit(0), folder, "day")
    assert rows(spark.read.parquet(folder).select("id", F.col("day").cast("long"))) == rows(left)


def test_a_slice_may_be_made_from_itself(spark, folder):
    rewrite_partitions(spark.range(10).select("id", F.lit(1).alias("day")), folder, "day")
    for _ in range(2):
        rewrite_partitions(spark.read.parquet(folder).withColumn("id", F.col("id") + 1), folder, "day")
    assert {r.id for r in spark.read.parquet(folder).collect()} == set(range(2, 12))


# Drawn numbers


def test_drawn_numbers_do_not_depend_on_partitions(spark):
    drawn = [
        sorted(tuple(r) for r in spark.range(500).repartition(parts).select("id", uniform(F.col("id"), 7).alias("u")).collect())
        for parts in (1, 4, 17)
    ]
    assert drawn[0] == drawn[1] == drawn[2]
    ends = spark.createDataFrame([(-1,), (2**63 - 1,), (-(2**63),), (None,)], "id LONG").select(uniform(F.col("id"), 7)).collect()
    assert all(0 <= r[0] < 1 for r in ends[:3]) and ends[3][0] is None


def test_drawn_numbers_are_spread_evenly(spark):
    """Cells of a square by two seeds: a chi-square of 99 degrees stays below its tail of 1e-6."""
    many = 100_000
    cells = spark.range(many).select(
        F.floor(uniform(F.col("id"), 1) * 10).alias("x"), F.floor(uniform(F.col("id"), 2) * 10).alias("y")
    ).groupBy("x", "y").count().collect()
    assert len(cells) == 100
    assert sum((r["count"] - many / 100) ** 2 / (many / 100) for r in cells) < 180
    neighbours = spark.range(many).select(uniform(F.col("id"), 1).alias("a"), uniform(F.col("id") + 1, 1).alias("b"))
    assert abs(neighbours.agg(F.corr("a", "b")).first()[0]) < 0.015


def test_seeded_estimate_is_the_same_over_any_slices(spark):
    found = {measures.circle_estimate(spark, 20_000, slices, seed=3).first().inside for slices in (1, 4, 17)}
    assert len(found) == 1
    assert abs(4 * found.pop() / 20_000 - 3.1416) < 0.05
    assert measures.circle_estimate(spark, 20_000, 2, seed=4).first().inside != measures.circle_estimate(spark, 20_000, 2, seed=3).first().inside


# Paths


def test_paths_are_shortest_and_made_of_edges(spark):
    draw = random.Random(9)
    kinds = ("IDENTITY", "TRANSFORMATION", "AGGREGATION")
    edges = {(f"t{a}", "c", f"t{b}", "c", draw.choice(kinds)) for a, b in [(draw.randrange(5, 25), draw.randrange(0, 25)) for _ in range(60)] if b < a}
    edges |= {("t40", "c", "t41", "c", "IDENTITY"), ("t41", "c", "t40", "c", "IDENTITY"), ("t42", "c", "t40", "c", "IDENTITY"), ("t40", "c", "t1", "c", "IDENTITY")}
    df = spark.createDataFrame([("j", "1", *e[:4], "DIRECT", e[4]) for e in edges] * 2, COLUMN_EDGES)
    sources = {tuple(r)[:5]: r.hops for r in graph.column_sources(df).collect()}
    paths = {}
    for r in graph.column_paths(df).collect():
        paths.setdefault(tuple(r)[:5], {})[r.position] = (r.dataset, r.column)
    assert set(paths) == set(sources) and len(paths) > 20
    for end, path in paths.items():
        assert sorted(path) == list(range(sources[end] + 1))
        assert path[0] == end[:2] and path[sources[end]] == end[2:4]
        strongest = {0}
        for k in range(sources[end]):
            steps = {kinds.index(e[4]) for e in edges if e[:4] == (*path[k], *path[k + 1])}
            assert steps
            strongest = {max(a, b) for a in strongest for b in steps}
        assert kinds.index(end[4]) in strongest
    assert graph.column_paths(df.limit(0)).count() == 0
