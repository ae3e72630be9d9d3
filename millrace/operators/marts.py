"""A mart of order metrics that is kept up to date by batches instead of being made again.

What is kept are states that merge: counts, sums, first and last times by key, and for the exact number of
different customers a bitmap for each key and range of customer ids. A batch is folded to such states, which
combine before the shuffle, and merged with what is kept; orders that were folded before are not read again.
The states grow with keys and customers, not with orders.

A batch must be merged once: its states are added to what is there. A run that failed before the states were
written left nothing and is repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import total
from millrace.workspace import materialise


def _metric_states(orders: DataFrame, key: str) -> DataFrame:
    return orders.groupBy(key).agg(
        F.count(F.lit(1)).alias("orders"),
        F.count("amount").alias("amounts"),
        F.sum("amount").alias("spent"),
        F.min("order_ts").alias("first_order_ts"),
        F.max("order_ts").alias("last_order_ts"),
    )


def _customer_states(orders: DataFrame, key: str) -> DataFrame:
    customer = F.col("customer_id")
    return orders.where(customer.isNotNull()).groupBy(key, F.bitmap_bucket_number(customer).alias("range")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(customer)).alias("seen")
    )


def merged_mart(batch: DataFrame, key: str, kept: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The states of ``batch`` (orders with a column ``key``) merged with the ``kept`` ones, both written down.

    The first table has a row for each key, the second one for each key and range of customer ids.
    """
    metrics, customers = _metric_states(batch, key), _customer_states(batch, key)
    if kept is not None:
        # Amounts are decimals; the type of a sum is kept, so any number of batches can follow.
        spent = kept[0].schema["spent"].dataType
        metrics = (
            kept[0].unionByName(metrics.withColumn("spent", F.col("spent").cast(spent)))
            .groupBy(key)
            .agg(
                F.sum("orders").alias("orders"),
                F.sum("amounts").alias("amounts"),
                F.sum("spent").cast(spent).alias("spent"),
                F.min("first_order_ts").alias("first_order_ts"),
                F.max("last_order_ts").alias("last_order_ts"),
            )
        )
        customers = kept[1].unionByName(customers).groupBy(key, "range").agg(F.bitmap_or_agg("seen").alias("seen"))
    return materialise(metrics, "mart")[0], materialise(customers, "mart_customers")[0]


def mart(kept: tuple[DataFrame, DataFrame], key: str) -> DataFrame:
    """``key, orders_count, unique_customers, revenue, avg_check, first_order_ts, last_order_ts`` of all merged batches."""
    metrics, customers = kept
    different = customers.groupBy(F.col(key).alias("of")).agg(F.sum(F.bitmap_count("seen")).alias("unique_customers"))
    revenue = F.col("spent").cast("double")
    return metrics.join(different, F.col(key).eqNullSafe(F.col("of")), "left").select(
        key,
        F.col("orders").alias("orders_count"),
        F.coalesce("unique_customers", F.lit(0).cast("long")).alias("unique_customers"),
        revenue.alias("revenue"),
        F.try_divide(revenue, "amounts").alias("avg_check"),
        "first_order_ts",
        "last_order_ts",
    )


def mart_of(orders: DataFrame, key: str) -> DataFrame:
    """The same rows, made from all orders at once."""
    return orders.groupBy(key).agg(
        F.count(F.lit(1)).alias("orders_count"),
        F.count_distinct("customer_id").alias("unique_customers"),
        total(F.col("amount")).alias("revenue"),
        F.try_divide(total(F.col("amount")), F.count("amount")).alias("avg_check"),
        F.min("order_ts").alias("first_order_ts"),
        F.max("order_ts").alias("last_order_ts"),
    )
