"""Runs of jobs: state, duration, and how many versions a job has had.

The fold from events to runs only takes minima, maxima and counts, so the order of the events does
not matter, and a state store can carry it on. Batch and stream share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.jobs import query_version

# States of a run event.
START = "START"
COMPLETE = "COMPLETE"
FAIL = "FAIL"


def _in_state(state: str) -> Column:
    return F.when(F.col("state") == state, F.col("ts"))


def different_events(run_events: DataFrame) -> DataFrame:
    """Events delivered more than once, once each."""
    return run_events.dropDuplicates(["event_id"])


def fold_events(run_events: DataFrame) -> DataFrame:
    """One row per run with all that its state needs. ``events`` counts deliveries."""
    return run_events.groupBy("run_id").agg(
        F.min("job").alias("job"),
        F.min(_in_state(START)).alias("started_at"),
        F.min("ts").alias("first_ts"),
        F.max(F.struct("ts", "event_id", "state")).alias("last"),
        F.count(F.lit(1)).alias("events"),
    )


def merge_folds(folds: DataFrame) -> DataFrame:
    """Partial folds of the same runs, of different events, merged to one row per run."""
    return folds.groupBy("run_id").agg(
        F.min("job").alias("job"),
        F.min("started_at").alias("started_at"),
        F.min("first_ts").alias("first_ts"),
        F.max("last").alias("last"),
        F.sum("events").alias("events"),
    )


def run_states(folds: DataFrame) -> DataFrame:
    """State, start, last event and duration of every run.

    The state is that of the latest event; equal times are decided by the event id.
    """
    start = F.coalesce("started_at", "first_ts")
    seconds = (F.col("last.ts") - start).cast("interval second").cast("decimal(18,6)")
    return folds.select(
        "run_id",
        "job",
        F.col("last.state").alias("state"),
        start.alias("started_at"),
        F.col("last.ts").alias("last_ts"),
        (seconds * 1_000_000).cast("bigint").alias("duration_us"),
        "events",
    )


def failed_runs(states: DataFrame) -> DataFrame:
    return states.where(F.col("state") == FAIL)


def runs_per_job(run_events: DataFrame) -> DataFrame:
    return run_events.groupBy("job").agg(F.count_distinct("run_id").alias("runs"))


def versions_per_job(run_events: DataFrame) -> DataFrame:
    """Versions and runs of every job, and whether one version ran often or many versions ran.

    Events are reduced to their different (job, version, run) once; each count is then of whole keys.
    """
    runs = F.col("runs")
    versions = F.col("versions")
    facts = run_events.select("job", "version", "run_id").distinct()

    def different(column: str, name: str) -> DataFrame:
        return facts.select("job", column).distinct().groupBy("job").agg(F.count(column).alias(name))

    return (
        different("version", "versions")
        .join(different("run_id", "runs"), "job")
        .withColumn(
            "history",
            F.when(versions > 1, "many versions")
            .when(runs > 1, "one version, many runs")
            .otherwise("one version, one run"),
        )
    )


def versions_by_query(job_versions: DataFrame) -> DataFrame:
    """Different queries of every job, by their texts, beside the versions reported for them."""
    facts = job_versions.select("job", "version", query_version(F.col("query_text")).alias("query"))

    def different(column: str, name: str) -> DataFrame:
        return facts.select("job", column).distinct().groupBy("job").agg(F.count(column).alias(name))

    return different("query", "queries").join(different("version", "versions"), "job")
