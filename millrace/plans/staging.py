"""Staging tables: column copies and string expressions over the raw tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import contact, email_domain, pick

# Devices of the third batch.
DEVICES = ("ios", "android", "web")


def basic(customers: DataFrame) -> DataFrame:
    return customers.select("id", "name", "country")


def enriched(customers: DataFrame) -> DataFrame:
    return customers.select(
        "id",
        contact(F.col("name"), F.col("email")).alias("contact"),
        F.upper("name").alias("name_upper"),
        email_domain(F.col("email")).alias("email_domain"),
        F.lower("country").alias("country_lower"),
        F.col("id").cast("string").alias("id_str"),
    )


def schema_versions(customers: DataFrame) -> list[DataFrame]:
    """Three schemas of one table: base, a column more, one renamed and one dropped."""
    return [
        customers.select("id", "name", "email"),
        customers.select("id", "name", "email", "country"),
        customers.select("id", F.col("name").alias("full_name"), "country"),
    ]


def drift_batches(
    orders: DataFrame, customers: DataFrame, second: int | Column, third: int | Column
) -> list[DataFrame]:
    """Three disjoint batches of events with three schemas, cut by order id.

    The batches hold the ids below ``second``, from ``second`` to ``third - 1``, and from
    ``third`` on.
    """
    o, c = orders.alias("o"), customers.alias("c")
    event = F.col("o.order_id").alias("event_id")
    user = F.col("o.customer_id").alias("user_id")
    ts = F.col("o.order_ts").alias("ts")
    first_batch = o.where(F.col("o.order_id") < second).select(event, user, ts)
    second_batch = (
        o.where(F.col("o.order_id").between(second, third - 1))
        .join(c, F.col("c.id") == F.col("o.customer_id"))
        .select(event, user, ts, F.col("c.country").alias("country"))
    )
    third_batch = o.where(F.col("o.order_id") >= third).select(
        event, ts, pick(DEVICES, F.col("o.order_id") % len(DEVICES) + 1).alias("device")
    )
    return [first_batch, second_batch, third_batch]


def union_of(batches: Sequence[DataFrame]) -> DataFrame:
    """Batches of several schemas as one table, matched by column name."""
    merged = batches[0]
    for batch in batches[1:]:
        merged = merged.unionByName(batch, allowMissingColumns=True)
    return merged
