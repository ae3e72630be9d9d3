"""Joins of orders, customers and products.

No join carries a broadcast hint: Spark broadcasts a side whose measured size is below
``spark.sql.autoBroadcastJoinThreshold`` and otherwise joins by shuffle, where adaptive
execution splits the partitions of hot keys. Where a join is followed by a grouping, orders are
aggregated by customer *before* the join, so at most one row per customer is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import total


def with_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Every order of a known customer, denormalised."""
    o, c = orders.alias("o"), customers.alias("c")
    return o.join(c, F.col("c.id") == F.col("o.customer_id")).select(
        "o.order_id",
        "o.amount",
        "o.order_ts",
        F.col("c.id").alias("customer_id"),
        F.col("c.name").alias("customer_name"),
        "c.country",
    )


def with_product(orders: DataFrame, products: DataFrame, modulus: int | Column) -> DataFrame:
    """Every order with the product whose id is ``order_id % modulus``, NULL where there is none."""
    o, p = orders.alias("o"), products.alias("p")
    return o.join(p, F.col("p.product_id") == F.col("o.order_id") % modulus, "left").select(
        "o.*",
        F.col("p.category").alias("product_category"),
        F.col("p.price").alias("product_price"),
    )


def enriched(orders: DataFrame, customers: DataFrame, products: DataFrame, modulus: int | Column) -> DataFrame:
    """Wide table of orders, their customers and, where known, their products."""
    o, c, p = orders.alias("o"), customers.alias("c"), products.alias("p")
    return (
        o.join(c, F.col("c.id") == F.col("o.customer_id"))
        .join(p, F.col("p.product_id") == F.col("o.order_id") % modulus, "left")
        .select(
            "o.order_id",
            F.col("c.id").alias("customer_id"),
            F.col("c.name").alias("customer_name"),
            F.col("c.country").alias("customer_country"),
            F.col("o.amount").alias("order_amount"),
            F.col("o.order_ts").alias("order_ts"),
            F.col("p.category").alias("product_category"),
            F.col("p.price").alias("product_price"),
        )
    )


def customers_with_spending(customers: DataFrame, stats: DataFrame) -> DataFrame:
    """Every customer with the money spent, 0 for a customer without orders."""
    c, s = customers.alias("c"), stats.alias("s")
    return c.join(s, F.col("s.customer_id") == F.col("c.id"), "left").select(
        "c.id",
        "c.name",
        F.upper("c.country").alias("country_code"),
        F.coalesce(F.col("s.total_spent"), F.lit(0.0)).alias("total_spent"),
    )


def _per_customer(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count("amount").alias("amounts"),
        F.sum("amount").alias("spent"),
    )


def country_totals(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """``country, orders, revenue``."""
    spent, c = _per_customer(orders).alias("s"), customers.alias("c")
    return (
        spent.join(c, F.col("c.id") == F.col("s.customer_id"))
        .groupBy("c.country")
        .agg(F.sum("s.orders").alias("orders"), total(F.col("s.spent")).alias("revenue"))
    )


def country_metrics_from_raw(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """The rows of ``order_metrics_by`` country over ``with_customer``, without the wide join."""
    spent, c = _per_customer(orders).alias("s"), customers.alias("c")
    revenue = total(F.col("s.spent"))
    return (
        spent.join(c, F.col("c.id") == F.col("s.customer_id"))
        .groupBy("c.country")
        .agg(
            F.sum("s.orders").alias("orders_count"),
            F.count_distinct("s.customer_id").alias("unique_customers"),
            revenue.alias("revenue"),
            F.try_divide(revenue, F.sum("s.amounts")).alias("avg_check"),
        )
    )


def top_countries(metrics: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` countries with the highest revenue and their revenue per customer."""
    return (
        metrics.select(
            "country",
            "orders_count",
            "unique_customers",
            "revenue",
            F.try_divide("revenue", "unique_customers").alias("revenue_per_customer"),
        )
        .orderBy(F.desc_nulls_last("revenue"), "country")
        .limit(k)
    )
