"""Flows over the generated tables, against values worked out by hand."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions.columns import money
from millrace.operators import measures
from millrace.operators import orders as order_ops
from millrace.plans import flows, staging
from millrace.sources import generated
from millrace.sources.tables import data_files

FIRST = datetime(2023, 11, 14, 22, 13, 20)


@pytest.fixture(scope="module")
def loaded(spark):
    from millrace.workspace import fresh_database

    database = fresh_database(spark, "golden")
    flows.load_generated(spark, database)
    return database


def test_generate_then_aggregate(spark, folder, rows):
    flows.generate(spark, f"{folder}/raw", 1000)
    flows.aggregate(spark, f"{folder}/raw", f"{folder}/agg")
    totals = [9500.0, 9900.0, 10300.0, 9700.0, 10100.0]
    assert rows(spark.read.parquet(f"{folder}/agg")) == [(f"region_{i}", t, 200) for i, t in enumerate(totals)]


def test_generated_rows_do_not_depend_on_partitions(spark, conf, rows):
    first = rows(generated.orders(spark, 50))
    assert rows(generated.orders(spark, 50).repartition(7)) == first
    assert first[0][0] == 0 and len(first) == 50


def test_raw_tables(spark, loaded):
    products = spark.table(f"{loaded}.raw_products")
    assert Counter(row.category for row in products.collect()) == {"books": 17, "food": 17, "tech": 16}
    first = spark.table(f"{loaded}.raw_customers").where("id = 0").first()
    assert tuple(first) == (0, "user_0", "user_0@example.com", "RU")
    assert spark.table(f"{loaded}.raw_orders").agg(F.max("order_ts")).first()[0] == FIRST + timedelta(minutes=499)


def test_staging(spark, loaded):
    basic, enriched = flows.stage_customers(spark, loaded)
    assert (basic.count(), basic.columns) == (100, ["id", "name", "country"])
    assert tuple(enriched.where("id = 0").first()) == (
        0, "user_0 <user_0@example.com>", "USER_0", "example.com", "ru", "0",
    )


def test_customer_stats(spark, loaded):
    stats = flows.customer_stats(spark, loaded).collect()
    assert len(stats) == 100
    for row in stats:
        k = row.customer_id
        assert row.orders_count == 5
        assert row.first_order_ts == FIRST + timedelta(minutes=k)
        assert row.last_order_ts == FIRST + timedelta(minutes=400 + k)
        assert row.total_spent == pytest.approx(sum((k + 100 * i) * 7919 % 100_000 / 100 for i in range(5)))
        assert row.avg_check == row.total_spent / 5


def test_enriched_orders(spark, loaded):
    wide = flows.enriched_orders(spark, loaded)
    assert wide.count() == 500
    assert wide.where("product_category IS NULL AND product_price IS NULL").count() == 80
    assert measures.null_share(wide, "product_category", "null_pct").first()[0] == 16.0


def test_schema_history(spark, loaded):
    assert flows.schema_history(spark, loaded) == [
        ["id", "name", "email"],
        ["id", "name", "email", "country"],
        ["id", "full_name", "country"],
    ]


def test_summary_versions(spark, loaded):
    flows.customer_stats(spark, loaded)
    assert flows.summary_versions(spark, loaded) == [100, 100, 100]
    assert spark.table(f"{loaded}.customer_summary").columns == ["id", "name", "country_code", "total_spent"]


def test_customer_without_orders_spends_nothing(spark, rows):
    customers = spark.createDataFrame([(1, "a", "x", "de"), (2, "b", "y", "fr")], "id INT, name STRING, email STRING, country STRING")
    orders = spark.createDataFrame([(1, 1, 2.5, FIRST)], "order_id INT, customer_id INT, amount DOUBLE, order_ts TIMESTAMP_NTZ")
    found = order_ops.customers_with_spending(customers, measures.order_metrics(orders))
    assert rows(found) == [(1, "a", "DE", 2.5), (2, "b", "FR", 0.0)]


@pytest.fixture(scope="module")
def exact(spark, loaded):
    """The raw tables with decimal amounts, whose totals are the same to the last digit."""
    from millrace.workspace import fresh_database

    database = fresh_database(spark, "exact")
    orders = spark.table(f"{loaded}.raw_orders").withColumn("amount", money(F.col("amount")))
    flows.load_tables(spark, database, raw_customers=spark.table(f"{loaded}.raw_customers"), raw_orders=orders)
    return database


def test_repeated_runs_leave_one_table(spark, exact, rows):
    once = rows(flows.repeated_totals(spark, exact, 1))
    assert rows(flows.repeated_totals(spark, exact, 5)) == once
    assert [row[1] for row in once] == [125] * 4


def test_country_mart(spark, exact, rows):
    mart = rows(flows.country_mart(spark, exact))
    raw = spark.table(f"{exact}.raw_orders"), spark.table(f"{exact}.raw_customers")
    assert rows(flows.country_mart_from_views(*raw)) == mart
    assert len(mart) == 3
    metrics = spark.table(f"{exact}.tmp_country_metrics").collect()
    assert [(row.orders_count, row.unique_customers) for row in metrics] == [(125, 25)] * 4
    by_revenue = sorted(metrics, key=lambda row: -row.revenue)[:3]
    assert sorted((r.country, r.revenue / 25) for r in by_revenue) == [(row[0], row[4]) for row in mart]


def test_mart_from_views_counts_a_repeated_customer_once(spark, rows):
    customers = spark.createDataFrame([(1, "a", "DE"), (1, "b", "DE"), (2, "c", "DE")], "id INT, name STRING, country STRING")
    orders = spark.createDataFrame(
        [(1, 1, 1.0, None), (2, 1, 2.0, None), (3, 2, None, None)],
        "order_id INT, customer_id INT, amount DOUBLE, order_ts TIMESTAMP_NTZ",
    )
    wide = measures.order_metrics_by(order_ops.with_customer(orders, customers), "country")
    assert rows(order_ops.country_metrics_from_raw(orders, customers)) == rows(wide)


def test_schema_drift(spark, loaded, folder):
    orders, customers = spark.table(f"{loaded}.raw_orders"), spark.table(f"{loaded}.raw_customers")
    batches = staging.drift_batches(orders, customers, 200, 400)
    assert [batch.count() for batch in batches] == [200, 200, 100]
    for _ in range(2):
        merged = flows.append_batches(batches, folder, 8)
        assert merged.count() == 500
        assert data_files(spark, folder).count() == 24
        assert len(merged.inputFiles()) == 24
    profile = measures.null_profile(merged).first().asDict()
    assert profile == {"event_id": 0, "user_id": 100, "ts": 0, "country": 300, "device": 400}
    devices = merged.where("device IS NOT NULL").groupBy("device").count().collect()
    assert dict(map(tuple, devices)) == {"ios": 33, "android": 34, "web": 33}
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted(
        map(tuple, staging.union_of(batches).select(*flows.EVENT_COLUMNS).collect()), key=repr
    )


def test_word_count(spark, folder, rows):
    lines = spark.createDataFrame(
        [("Test data for Hadoop cluster",), ("Testing HDFS and YARN integration",), ("",), ("  \t ",)], "value STRING"
    )
    lines.coalesce(1).write.text(folder)
    words = "HDFS Hadoop Test Testing YARN and cluster data for integration".split()
    assert rows(measures.word_counts(spark.read.text(folder))) == [(word, 1) for word in words]


def test_circle_estimate(spark):
    fixed = measures.circle_estimate(spark, 200_000).first()
    assert abs(fixed.pi - 3.14159265) < 1e-3
    assert measures.circle_estimate(spark, 200_000, slices=2).first() == fixed
    random = measures.circle_estimate(spark, 200_000, seed=3).first()
    assert abs(random.pi - 3.14159265) < 0.05
    assert measures.circle_estimate(spark, 0).first().pi is None


def test_null_share_of_no_rows_is_null(spark):
    assert measures.null_share(spark.range(0), "id", "share").first()[0] is None
