"""Questions about data sets, jobs, applications and their inputs and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def datasets_in(datasets: DataFrame, namespace: str) -> DataFrame:
    return datasets.where(F.col("namespace") == namespace).select("name").distinct()


def jobs_in(jobs: DataFrame, namespace: str, fragment: str = "") -> DataFrame:
    """Jobs of a namespace whose name contains ``fragment``."""
    found = F.contains(F.col("job"), F.lit(fragment))
    return jobs.where((F.col("namespace") == namespace) & found).select("job").distinct()


def job_io_counts(job_io: DataFrame) -> DataFrame:
    """Different input and output data sets of every job version.

    Repeated facts are removed first; the count after that needs no distinct of its own.
    """
    role = F.col("role")
    return (
        job_io.select("job", "version", "role", "dataset")
        .distinct()
        .groupBy("job", "version")
        .agg(
            F.count(F.when((role == "INPUT") & F.col("dataset").isNotNull(), 1)).alias("inputs"),
            F.count(F.when((role == "OUTPUT") & F.col("dataset").isNotNull(), 1)).alias("outputs"),
        )
    )


def placeholder_jobs(jobs: DataFrame, job_io: DataFrame, run_events: DataFrame) -> DataFrame:
    """Jobs without inputs, outputs or runs."""
    return (
        jobs.select("job")
        .distinct()
        .join(job_io.select("job").distinct(), "job", "left_anti")
        .join(run_events.select("job").distinct(), "job", "left_anti")
    )


def jobs_per_application(jobs: DataFrame, at_least: int = 2) -> DataFrame:
    """Applications that ran at least ``at_least`` different jobs."""
    return (
        jobs.where(F.col("app_id").isNotNull())
        .groupBy("app_id")
        .agg(F.count_distinct("job").alias("jobs"))
        .where(F.col("jobs") >= at_least)
    )
