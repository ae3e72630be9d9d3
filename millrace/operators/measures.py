"""Aggregations. Each one combines on the map side, so a key with a third of all rows is
already one row per task when it is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import in_quarter_circle, mean, split_words, total, uniform


def totals_by(df: DataFrame, key: str, amount: str) -> DataFrame:
    """``key, total_amount, row_count``."""
    return df.groupBy(key).agg(
        total(F.col(amount)).alias("total_amount"),
        F.count(F.lit(1)).alias("row_count"),
    )


def order_metrics(orders: DataFrame) -> DataFrame:
    """Orders, money and first and last order of every customer."""
    amount = F.col("amount")
    return orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("orders_count"),
        total(amount).alias("total_spent"),
        mean(amount).alias("avg_check"),
        F.min("order_ts").alias("first_order_ts"),
        F.max("order_ts").alias("last_order_ts"),
    )


def order_metrics_by(orders: DataFrame, key: str) -> DataFrame:
    """Orders, different customers and money of every value of ``key``.

    The distinct count is planned as an aggregation by (key, customer) first, so a hot value is
    spread over the cluster by its customers.
    """
    amount = F.col("amount")
    return orders.groupBy(key).agg(
        F.count(F.lit(1)).alias("orders_count"),
        F.count_distinct("customer_id").alias("unique_customers"),
        total(amount).alias("revenue"),
        mean(amount).alias("avg_check"),
    )


def null_share(df: DataFrame, column: str, name: str) -> DataFrame:
    """Percentage of rows without a value, one decimal place, as double."""
    missing = F.count(F.when(F.col(column).isNull(), 1))
    share = F.round(F.try_divide(100.0 * missing.cast("decimal(20,0)"), F.count(F.lit(1)).cast("decimal(20,0)")), 1)
    return df.agg(share.cast("double").alias(name))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Number of NULLs of every column in one pass: one row, one column each."""
    return df.agg(*[F.count(F.when(F.col(name).isNull(), 1)).alias(name) for name in columns or df.columns])


def row_count(df: DataFrame, name: str = "cnt") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def word_counts(lines: DataFrame, text: str = "value") -> DataFrame:
    """``word, n`` over whole texts."""
    words = lines.select(F.explode(split_words(F.col(text))).alias("word")).where(F.col("word") != "")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def circle_estimate(spark: SparkSession, points: int, slices: int | None = None, seed: int | None = None) -> DataFrame:
    """``inside, points, pi``: four times the share of points in the quarter circle.

    The points follow a fixed sequence; with a ``seed`` each point is drawn by its number, so the
    estimate does not depend on the number of slices either.
    """
    rows = spark.range(0, points, 1, slices) if slices else spark.range(points)
    if seed is None:
        return circle_share(rows)
    drawn = rows.select(uniform(F.col("id"), seed).alias("x"), uniform(F.col("id"), seed + 1).alias("y"))
    return _share_of_hits(drawn.select((F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1).alias("hit")))


def circle_share(numbers: DataFrame) -> DataFrame:
    """``inside, points, pi`` of the points of the fixed sequence that ``id`` numbers."""
    return _share_of_hits(numbers.select(in_quarter_circle(F.col("id")).alias("hit")))


def _share_of_hits(judged: DataFrame) -> DataFrame:
    hits = F.count(F.when(F.col("hit"), 1))
    return judged.agg(
        hits.alias("inside"),
        F.count(F.lit(1)).alias("points"),
        F.try_divide(4.0 * hits, F.count(F.lit(1))).alias("pi"),
    )
