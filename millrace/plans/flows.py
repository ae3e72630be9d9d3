"""Flows that write: every step reads only what an earlier step has written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import measures
from millrace.operators import orders as order_ops
from millrace.plans import staging
from millrace.sinks.writers import drop_tables, write_files
from millrace.sources import generated
from millrace.sources.tables import read_merged

EVENT_COLUMNS = ("event_id", "user_id", "ts", "country", "device")


def overwrite_table(df: DataFrame, name: str) -> DataFrame:
    """Create or replace a table from a query and return the table."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def load_tables(spark: SparkSession, database: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        overwrite_table(df, f"{database}.{name}")


def load_generated(spark: SparkSession, database: str) -> None:
    """The three raw tables from the row generators."""
    load_tables(
        spark,
        database,
        raw_customers=generated.customers(spark),
        raw_orders=generated.orders(spark),
        raw_products=generated.products(spark),
    )


def generate(spark: SparkSession, path: str, rows: int) -> None:
    generated.sales(spark, rows).write.mode("overwrite").parquet(path)


def aggregate(spark: SparkSession, source: str, target: str) -> None:
    sales = spark.read.parquet(source)
    measures.totals_by(sales, "region", "amount").write.mode("overwrite").parquet(target)


def stage_customers(spark: SparkSession, database: str) -> tuple[DataFrame, DataFrame]:
    """``stg_customers_basic`` and ``stg_customers_enriched`` from ``raw_customers``."""
    raw = spark.table(f"{database}.raw_customers")
    return (
        overwrite_table(staging.basic(raw), f"{database}.stg_customers_basic"),
        overwrite_table(staging.enriched(raw), f"{database}.stg_customers_enriched"),
    )


def customer_stats(spark: SparkSession, database: str) -> DataFrame:
    metrics = measures.order_metrics(spark.table(f"{database}.raw_orders"))
    return overwrite_table(metrics, f"{database}.agg_customer_stats")


def enriched_orders(spark: SparkSession, database: str, modulus: int = 60) -> DataFrame:
    wide = order_ops.enriched(
        spark.table(f"{database}.raw_orders"),
        spark.table(f"{database}.raw_customers"),
        spark.table(f"{database}.raw_products"),
        modulus,
    )
    return overwrite_table(wide, f"{database}.customer_orders_enriched")


def schema_history(spark: SparkSession, database: str) -> list[list[str]]:
    """Write three schemas into ``stage_customers``; return the field names after each write."""
    target = f"{database}.stage_customers"
    raw = spark.table(f"{database}.raw_customers")
    return [overwrite_table(version, target).columns for version in staging.schema_versions(raw)]


def summary_versions(spark: SparkSession, database: str) -> list[int]:
    """Write three versions of one query into ``customer_summary``; return the row counts.

    The third version needs ``agg_customer_stats``.
    """
    raw = spark.table(f"{database}.raw_customers")
    versions = [
        raw.select("id", "name"),
        raw.select("id", "name", F.upper("country").alias("country_code")),
        order_ops.customers_with_spending(raw, spark.table(f"{database}.agg_customer_stats")),
    ]
    return [overwrite_table(version, f"{database}.customer_summary").count() for version in versions]


def repeated_totals(spark: SparkSession, database: str, runs: int = 5) -> DataFrame:
    """Write the same query several times; every run leaves the same table."""
    target = f"{database}.daily_country_totals"
    totals = order_ops.country_totals(spark.table(f"{database}.raw_orders"), spark.table(f"{database}.raw_customers"))
    for _ in range(runs):
        overwrite_table(totals, target)
    return spark.table(target)


def country_mart(spark: SparkSession, database: str, k: int = 3) -> DataFrame:
    """Raw tables, denormalised orders, country metrics, top countries: every step is a table."""
    drop_tables(spark, database, "tmp_orders_with_customer", "tmp_country_metrics", "mart_top_countries")
    wide = overwrite_table(
        order_ops.with_customer(spark.table(f"{database}.raw_orders"), spark.table(f"{database}.raw_customers")),
        f"{database}.tmp_orders_with_customer",
    )
    metrics = overwrite_table(measures.order_metrics_by(wide, "country"), f"{database}.tmp_country_metrics")
    return overwrite_table(order_ops.top_countries(metrics, k), f"{database}.mart_top_countries")


def country_mart_from_views(orders: DataFrame, customers: DataFrame, k: int = 3) -> DataFrame:
    """The same mart in one plan, nothing written in between."""
    return order_ops.top_countries(order_ops.country_metrics_from_raw(orders, customers), k)


def append_batches(batches: Sequence[DataFrame], path: str, files: int | None = None) -> DataFrame:
    """Write batches of several schemas into one path and read them merged, by the schema they have together."""
    for number, batch in enumerate(batches):
        write_files(batch, path, files, "append" if number else "overwrite")
    schema = staging.union_of(batches).schema
    return read_merged(batches[0].sparkSession, path, *EVENT_COLUMNS, schema=schema)
