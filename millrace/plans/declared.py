"""What the steps of the flows declare about themselves, as lineage fact tables.

Spark offers no public way to read column edges off a plan, so each step states its inputs, the
source of each output column, and the keys it joins, groups, filters or sorts by.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from millrace.sources import facts

IDENTITY, TRANSFORMATION, AGGREGATION = facts.DIRECT_SUBTYPES


@dataclass(frozen=True)
class Step:
    """One version of one job: ``columns`` maps an output column to its ``(source, subtype)`` pairs,
    ``keys`` are ``(source, subtype)`` pairs; a source is written ``table.column``."""

    job: str
    version: str
    output: str
    columns: dict[str, tuple[tuple[str, str], ...]]
    keys: tuple[tuple[str, str], ...] = ()

    def inputs(self) -> list[str]:
        sources = [source for column in self.columns.values() for source, _ in column]
        sources += [source for source, _ in self.keys]
        return sorted({source.split(".")[0] for source in sources})


def _copied(table: str, *names: str, **renamed: str) -> dict[str, tuple[tuple[str, str], ...]]:
    """Columns taken over unchanged, ``new=old`` for those with another name."""
    taken = {name: name for name in names} | renamed
    return {new: ((f"{table}.{old}", IDENTITY),) for new, old in taken.items()}


def _made(subtype: str, *sources: str) -> tuple[tuple[str, str], ...]:
    return tuple((source, subtype) for source in sources)



_CUSTOMER_JOIN = _made("JOIN", "raw_customers.id", "raw_orders.customer_id")
_BATCH_FILTER = _made("FILTER", "raw_orders.order_id")

STEPS = (
    Step("projections", "1", "stg_customers_basic", _copied("raw_customers", "id", "name", "country")),
    Step(
        "expressions",
        "1",
        "stg_customers_enriched",
        {
            **_copied("raw_customers", "id"),
            "contact": _made(TRANSFORMATION, "raw_customers.name", "raw_customers.email"),
            "name_upper": _made(TRANSFORMATION, "raw_customers.name"),
            "email_domain": _made(TRANSFORMATION, "raw_customers.email"),
            "country_lower": _made(TRANSFORMATION, "raw_customers.country"),
            "id_str": _made(TRANSFORMATION, "raw_customers.id"),
        },
    ),
    Step(
        "aggregations",
        "1",
        "agg_customer_stats",
        {
            **_copied("raw_orders", "customer_id"),
            "orders_count": (),
            "total_spent": _made(AGGREGATION, "raw_orders.amount"),
            "avg_check": _made(AGGREGATION, "raw_orders.amount"),
            "first_order_ts": _made(AGGREGATION, "raw_orders.order_ts"),
            "last_order_ts": _made(AGGREGATION, "raw_orders.order_ts"),
        },
        _made("GROUP_BY", "raw_orders.customer_id"),
    ),
    Step(
        "joins",
        "1",
        "customer_orders_enriched",
        {
            **_copied("raw_orders", "order_id", "order_ts", order_amount="amount"),
            **_copied("raw_customers", customer_id="id", customer_name="name", customer_country="country"),
            **_copied("raw_products", product_category="category", product_price="price"),
        },
        _CUSTOMER_JOIN + _made("JOIN", "raw_orders.order_id", "raw_products.product_id"),
    ),
    Step("schema", "1", "stage_customers", _copied("raw_customers", "id", "name", "email")),
    Step("schema", "2", "stage_customers", _copied("raw_customers", "id", "name", "email", "country")),
    Step("schema", "3", "stage_customers", _copied("raw_customers", "id", "country", full_name="name")),
    Step("summary", "1", "customer_summary", _copied("raw_customers", "id", "name")),
    Step(
        "summary",
        "2",
        "customer_summary",
        {**_copied("raw_customers", "id", "name"), "country_code": _made(TRANSFORMATION, "raw_customers.country")},
    ),
    Step(
        "summary",
        "3",
        "customer_summary",
        {
            **_copied("raw_customers", "id", "name"),
            "country_code": _made(TRANSFORMATION, "raw_customers.country"),
            "total_spent": _made(TRANSFORMATION, "agg_customer_stats.total_spent"),
        },
        _made("JOIN", "raw_customers.id", "agg_customer_stats.customer_id"),
    ),
    Step(
        "repeated",
        "1",
        "daily_country_totals",
        {
            **_copied("raw_customers", "country"),
            "orders": (),
            "revenue": _made(AGGREGATION, "raw_orders.amount"),
        },
        _CUSTOMER_JOIN + _made("GROUP_BY", "raw_customers.country"),
    ),
    Step(
        "chain_join",
        "1",
        "tmp_orders_with_customer",
        {
            **_copied("raw_orders", "order_id", "amount", "order_ts"),
            **_copied("raw_customers", "country", customer_id="id", customer_name="name"),
        },
        _CUSTOMER_JOIN,
    ),
    Step(
        "chain_metrics",
        "1",
        "tmp_country_metrics",
        {
            **_copied("tmp_orders_with_customer", "country"),
            "orders_count": (),
            "unique_customers": _made(AGGREGATION, "tmp_orders_with_customer.customer_id"),
            "revenue": _made(AGGREGATION, "tmp_orders_with_customer.amount"),
            "avg_check": _made(AGGREGATION, "tmp_orders_with_customer.amount"),
        },
        _made("GROUP_BY", "tmp_orders_with_customer.country"),
    ),
    Step(
        "chain_mart",
        "1",
        "mart_top_countries",
        {
            **_copied("tmp_country_metrics", "country", "orders_count", "unique_customers", "revenue"),
            "revenue_per_customer": _made(
                TRANSFORMATION, "tmp_country_metrics.revenue", "tmp_country_metrics.unique_customers"
            ),
        },
        _made("SORT", "tmp_country_metrics.revenue"),
    ),
    Step(
        "drift",
        "1",
        "events_parquet",
        _copied("raw_orders", event_id="order_id", user_id="customer_id", ts="order_ts"),
        _BATCH_FILTER,
    ),
    Step(
        "drift",
        "2",
        "events_parquet",
        {
            **_copied("raw_orders", event_id="order_id", user_id="customer_id", ts="order_ts"),
            **_copied("raw_customers", "country"),
        },
        _CUSTOMER_JOIN + _BATCH_FILTER,
    ),
    Step(
        "drift",
        "3",
        "events_parquet",
        {
            **_copied("raw_orders", event_id="order_id", ts="order_ts"),
            "device": _made(TRANSFORMATION, "raw_orders.order_id"),
        },
        _BATCH_FILTER,
    ),
)


def _rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def job_io(spark: SparkSession, steps: Iterable[Step] = STEPS) -> DataFrame:
    ends = [(s, "INPUT", name) for s in steps for name in s.inputs()] + [(s, "OUTPUT", s.output) for s in steps]
    return _rows(spark, ((s.job, s.version, role, name) for s, role, name in ends), facts.JOB_IO)


def job_outputs(spark: SparkSession, steps: Iterable[Step] = STEPS) -> DataFrame:
    outputs = ((s.job, s.version, s.output, column) for s in steps for column in s.columns)
    return _rows(spark, outputs, facts.JOB_OUTPUTS)


def job_keys(spark: SparkSession, steps: Iterable[Step] = STEPS) -> DataFrame:
    keys = ((s.job, s.version, *source.split("."), subtype) for s in steps for source, subtype in s.keys)
    return _rows(spark, keys, facts.JOB_KEYS)


def column_edges(spark: SparkSession, steps: Iterable[Step] = STEPS) -> DataFrame:
    """The direct edges; the indirect ones follow from the outputs and keys of a job version."""
    edges = (
        (s.job, s.version, s.output, column, *source.split("."), facts.DIRECT, subtype)
        for s in steps
        for column, sources in s.columns.items()
        for source, subtype in sources
    )
    return _rows(spark, edges, facts.COLUMN_EDGES)


def dataset_edges(spark: SparkSession, steps: Iterable[Step] = STEPS) -> DataFrame:
    return _rows(spark, sorted({(s.output, name) for s in steps for name in s.inputs()}), facts.DATASET_EDGES)
