"""Audits: freshness of data sets, rejected events, namespaces that collide."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import moment
from millrace.functions.namespaces import dataset_name, dataset_namespace, namespace_fault, normalise_namespace


def freshness(expected: DataFrame, updates: DataFrame, run_start: datetime) -> DataFrame:
    """Each expected data set with its last update: ``missing``, ``stale`` (before the run) or ``fresh``."""
    key = ["namespace", "name"]
    last = updates.groupBy(*key).agg(F.max("updated_at").alias("updated_at"))
    return (
        expected.select(*key)
        .distinct()
        .join(last, key, "left")
        .withColumn(
            "state",
            F.when(F.col("updated_at").isNull(), "missing")
            .when(F.col("updated_at") < moment(run_start), "stale")
            .otherwise("fresh"),
        )
    )


def accepted_events(event_datasets: DataFrame) -> DataFrame:
    """Rows of the events all of whose namespaces are legal; one bad namespace drops the whole event.

    Bad events are reduced to one row per fault, not per event: that leaves the join with a
    shuffle of its own on either side, which adaptive execution can split for a hot event. On an
    aggregation by the join key alone it cannot.
    """
    bad = _faults(event_datasets).distinct()
    return event_datasets.join(bad, "event_id", "left_anti")


def _faults(event_datasets: DataFrame) -> DataFrame:
    faults = event_datasets.select("event_id", namespace_fault(F.col("namespace")).alias("reason"))
    return faults.where(F.col("reason").isNotNull())


def rejections(event_datasets: DataFrame) -> DataFrame:
    """Rejected events by reason; an event with two kinds of fault counts under both."""
    return _faults(event_datasets).groupBy("reason").agg(F.count_distinct("event_id").alias("events"))


def normalised(datasets: DataFrame) -> DataFrame:
    return datasets.withColumn("normalised", normalise_namespace(F.col("namespace")))


def collisions(datasets: DataFrame) -> DataFrame:
    """Normalised namespaces that stand for more than one raw namespace."""
    return (
        datasets.select(normalise_namespace(F.col("namespace")).alias("normalised"), "namespace")
        .groupBy("normalised")
        .agg(F.count_distinct("namespace").alias("raw_namespaces"))
        .where(F.col("raw_namespaces") > 1)
    )


def identities(locations: DataFrame, job_namespace: str) -> DataFrame:
    """``namespace`` and ``name`` of data sets given as paths or catalog names."""
    location = F.col("location")
    return locations.withColumns(
        {"namespace": dataset_namespace(location, job_namespace), "name": dataset_name(location)}
    )
