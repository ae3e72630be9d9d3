"""Row generators. Every value is a function of the row id, so a rerun gives the same rows
however the range is split into tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import label, pick, seconds_after

# Fixed values of the generated tables.
COUNTRIES = ("RU", "US", "DE", "FR")
CATEGORIES = ("books", "food", "tech")
REGIONS = 5
MAIL_DOMAIN = "@example.com"
FIRST_ORDER_SECOND = 1_700_000_000
ORDER_GAP_SECONDS = 60
EPOCH = "1970-01-01 00:00:00"


def _spread(number: Column, ceiling: int) -> Column:
    """A repeatable amount in cents below ``ceiling``, as double."""
    return (number * 7919 % (ceiling * 100)).cast("double") / 100


def sales(spark: SparkSession, rows: int) -> DataFrame:
    """``id, region, amount``: sales spread over five regions."""
    return sales_of(spark.range(rows))


def sales_of(numbers: DataFrame) -> DataFrame:
    """One sale for each row of ``id``."""
    number = F.col("id")
    return numbers.select(
        "id",
        label("region_", number % REGIONS).alias("region"),
        (number * 7 % 100).cast("double").alias("amount"),
    )


def customers(spark: SparkSession, rows: int = 100) -> DataFrame:
    """``id, name, email, country``."""
    number = F.col("id")
    name = label("user_", number)
    return spark.range(rows).select(
        "id",
        name.alias("name"),
        F.concat(name, F.lit(MAIL_DOMAIN)).alias("email"),
        pick(COUNTRIES, number % len(COUNTRIES) + 1).alias("country"),
    )


def orders(spark: SparkSession, rows: int = 500, customers: int = 100) -> DataFrame:
    """``order_id, customer_id, amount, order_ts``: one order a minute."""
    number = F.col("id")
    return spark.range(rows).select(
        number.alias("order_id"),
        (number % customers).alias("customer_id"),
        _spread(number, 1000).alias("amount"),
        seconds_after(EPOCH, F.lit(FIRST_ORDER_SECOND) + number * ORDER_GAP_SECONDS).alias("order_ts"),
    )


def products(spark: SparkSession, rows: int = 50) -> DataFrame:
    """``product_id, category, price``."""
    number = F.col("id")
    return spark.range(rows).select(
        number.alias("product_id"),
        pick(CATEGORIES, number % len(CATEGORIES) + 1).alias("category"),
        _spread(number, 100).alias("price"),
    )
