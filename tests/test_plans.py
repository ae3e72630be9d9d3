"""Shapes of plans, and hot keys: one key holds a third of all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__ as registry
from millrace.operators import measures
from millrace.operators import orders as order_ops
from millrace.operators.lineage import audits, edges, graph
from millrace.plans import bindings, lineage_queries, warehouse_queries
from millrace.sources.tables import table
from millrace.workspace import materialise

DIRECTORY = "/root/testdata/sf0.001"
ROWS = 60_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan after adaptive execution has run it."""
    df.collect()
    return plan(df)


@pytest.fixture
def written(monkeypatch):
    """The plans of all frames that are given to writers."""
    plans = []
    for name in ("parquet", "saveAsTable", "csv", "text", "save"):
        kept = getattr(DataFrameWriter, name)

        def write(self, *args, _kept=kept, **options):
            plans.append(plan(self._df))
            return _kept(self, *args, **options)

        monkeypatch.setattr(DataFrameWriter, name, write)
    return plans


@pytest.mark.parametrize("name", {**warehouse_queries.QUERIES, **lineage_queries.QUERIES})
def test_no_python_rows_and_no_cartesian_product(spark, name, written):
    """Neither in the plan of the answer nor in that of a step that is written on the way."""
    written.append(plan(registry.queries()[name](spark, DIRECTORY)))
    for text in written:
        for node in ("EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert node not in text


def test_a_round_does_not_move_what_was_found(spark, conf, written):
    """Of the rows found before and the rows reached now only the latter are shuffled."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    links = spark.range(1, 3000).selectExpr("'d' || id AS out_dataset", "'d' || (id DIV 2) AS in_dataset")
    rounds = graph._Rounds(links, "moved", edges=10**9)
    reached, _ = materialise(links.limit(50), "reached")
    written.clear()
    rounds.add_new(reached)
    text = written[-1]
    assert "LeftAnti" in text and "Bucketed: true" in text
    found = text[text.rindex("Exchange") :] if text.rindex("Exchange") > text.index("LeftAnti") else text
    assert text.count("Exchange hashpartitioning") == 1 and "reached" in found
    assert rounds.newest_rows == 0 and rounds.all().count() == 2999


def test_literal_bounds_reach_the_scan(spark):
    first, second, third = bindings.staging.drift_batches(
        bindings.orders(spark, DIRECTORY), bindings.customers(spark, DIRECTORY), 200, 400
    )
    assert "LessThan(o_orderkey,200)" in plan(first)
    assert "GreaterThanOrEqual(o_orderkey,200), LessThanOrEqual(o_orderkey,399)" in plan(second)
    assert "GreaterThanOrEqual(o_orderkey,400)" in plan(third)
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan(third)


def test_scans_read_only_used_columns(spark):
    text = plan(registry.queries()["agg1_sum_count"](spark, DIRECTORY))
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in text


def test_aggregation_is_partial_before_the_shuffle(spark):
    text = plan(measures.totals_by(table(spark, DIRECTORY, "lineitem"), "l_returnflag", "l_tax"))
    assert text.index("Exchange hashpartitioning") < text.index("partial_sum")


def test_top_countries_is_no_total_sort(spark):
    assert "TakeOrderedAndProject" in plan(registry.queries()["top1_topk"](spark, DIRECTORY))


def test_country_totals_aggregate_before_the_join(spark, conf):
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    text = plan(order_ops.country_totals(bindings.orders(spark, DIRECTORY), bindings.customers(spark, DIRECTORY)))
    assert text.index("SortMergeJoin [customer_id") < text.index("partial_count(1)")


@pytest.fixture
def skewed(conf):
    """Joins by shuffle, with thresholds that make a hot key visible on small tables."""
    conf(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="16KB",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="32KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )


@pytest.fixture(scope="module")
def hot(spark):
    """Orders of which a third belong to customer 0, and their customers."""
    number = F.col("id")
    customer = F.when(number % 3 == 0, 0).otherwise(number % 5000)
    orders = spark.range(0, ROWS, 1, 8).select(
        number.alias("order_id"),
        customer.alias("customer_id"),
        (number % 1000).cast("double").alias("amount"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("order_ts"),
    )
    customers = spark.range(5000).select(
        "id", F.concat(F.lit("u"), "id").alias("name"), F.concat(F.lit("c"), F.col("id") % 7).alias("country")
    )
    return orders, customers


def test_hot_customer_is_split_in_the_wide_join(spark, hot, skewed):
    wide = order_ops.with_customer(*hot)
    assert "skew=true" in final_plan(wide)
    assert wide.count() == ROWS


def test_hot_customer_is_split_in_the_left_join(spark, hot, skewed):
    orders, _ = hot
    products = spark.range(5000).select(F.col("id").alias("product_id"), F.lit("x").alias("category"), F.lit(1.0).alias("price"))
    same = orders.withColumn("order_id", F.col("customer_id"))
    assert "skew=true" in final_plan(order_ops.with_product(same, products, 6000))


def test_hot_customer_is_one_row_before_the_grouping(spark, hot, skewed, rows):
    direct = order_ops.country_metrics_from_raw(*hot)
    assert "skew=true" not in final_plan(direct)
    assert rows(direct) == rows(measures.order_metrics_by(order_ops.with_customer(*hot), "country"))


def test_hot_event_is_split(spark, skewed):
    number = F.col("id")
    df = spark.range(0, ROWS, 1, 8).select(
        F.when(number % 3 == 0, 0).otherwise(number).alias("event_id"),
        F.concat(F.lit("s3://"), F.md5(number.cast("string")), F.when(number % 10 == 1, "?").otherwise("")).alias("namespace"),
    )
    accepted = audits.accepted_events(df)
    assert "skew=true" in final_plan(accepted)
    bad = set(range(1, ROWS, 10))
    bad = {0 if n % 3 == 0 else n for n in bad}
    assert accepted.count() == sum(1 for n in range(ROWS) if (0 if n % 3 == 0 else n) not in bad)


def test_hot_job_is_split_in_the_indirect_edges(spark, skewed):
    """One job has a third of all outputs and of all keys."""
    number = F.col("id")
    job = F.when(number % 3 == 0, "hot").otherwise(F.concat(F.lit("j"), F.col("id")))
    outputs = spark.range(0, 60_000, 1, 8).select(
        job.alias("job"), F.lit("1").alias("version"), F.lit("d").alias("out_dataset"), F.md5(number.cast("string")).alias("out_column")
    )
    keys = spark.range(0, 60, 1, 8).select(
        job.alias("job"), F.lit("1").alias("version"), F.lit("e").alias("in_dataset"),
        F.concat(F.lit("i"), "id").alias("in_column"), F.lit("JOIN").alias("subtype"),
    )
    found = edges.indirect_edges(outputs, keys)
    assert "skew=true" in final_plan(found)
    assert found.count() == 20_000 * 20 + 40


def test_hot_pair_of_datasets_is_a_row_per_column(spark, skewed):
    """A third of all column pairs belong to one pair of data sets; no array grows with them."""
    number = F.col("id")
    hot_pair = number % 3 == 0
    df = spark.range(0, 30_000, 1, 8).select(
        F.lit("j").alias("job"), F.lit("1").alias("version"),
        F.when(hot_pair, "hot").otherwise(F.concat(F.lit("o"), number % 1000)).alias("out_dataset"),
        F.concat(F.lit("c"), "id").alias("out_column"),
        F.lit("in").alias("in_dataset"), F.lit("k").alias("in_column"),
        F.lit("DIRECT").alias("type"), F.lit("IDENTITY").alias("subtype"),
    )
    form = edges.to_dataset_form(df)
    assert form.agg(F.sum(F.size("pairs")), F.max(F.size("pairs"))).first()[:] == (30_000, 1)
    assert "hashpartitioning(out_dataset" in plan(form) and "out_column#" in plan(form)


def test_hub_is_split_in_a_walk(spark, skewed, rows):
    """A third of all edges leave one data set."""
    number = F.col("id")
    links = spark.range(0, ROWS, 1, 8).select(
        F.when(number % 3 == 0, "hub").otherwise(F.concat(F.lit("d"), number % 500)).alias("out_dataset"),
        F.concat(F.lit("s"), F.md5(number.cast("string"))).alias("in_dataset"),
    )
    above = spark.range(50).select(F.concat(F.lit("mart"), "id").alias("out_dataset"), F.lit("hub").alias("in_dataset"))
    links = links.union(above)
    start = spark.createDataFrame([("mart7",)], "dataset STRING")
    found = graph.upstream(links, starts=start)
    assert found.groupBy("hops").count().orderBy("hops").collect() == [(1, 1), (2, ROWS // 3)]

    hidden = spark.createDataFrame([("hub",)], "dataset STRING")
    kept = graph.without_hidden(links, hidden).groupBy(F.substring("out_dataset", 1, 1).alias("k")).count()
    assert rows(kept) == [("d", ROWS * 2 // 3), ("m", 50 * ROWS // 3)]


def test_start_with_many_edges_is_split(spark, skewed):
    edges_, _ = materialise(
        spark.range(0, ROWS, 1, 8).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("start"), F.md5(F.col("id").cast("string")).alias("node")
        ),
        "edges",
    )
    starts, _ = materialise(spark.range(1000).select(F.col("id").alias("start")).distinct(), "starts")
    assert "skew=true" in final_plan(edges_.join(starts, "start"))
