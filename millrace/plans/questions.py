"""Lineage questions by name, asked of a user's own fact tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.lineage import catalog, edges, graph, order, runs, versions
from millrace.sources.facts import read_facts

Facts = Callable[[str], DataFrame]


def _states(facts: Facts) -> DataFrame:
    return runs.run_states(runs.fold_events(runs.different_events(facts("run_events"))))


def _current(facts: Facts) -> DataFrame:
    return edges.latest_edges(facts("column_edges"), facts("run_events"))


#: Questions about all facts.
QUESTIONS: dict[str, Callable[[Facts], DataFrame]] = {
    "schema_history": lambda facts: versions.schema_history(facts("schema_fields")),
    "schema_changes": lambda facts: versions.schema_changes(facts("schema_fields")),
    "runs_per_job": lambda facts: runs.runs_per_job(facts("run_events")),
    "versions_per_job": lambda facts: runs.versions_per_job(facts("run_events")),
    "versions_by_query": lambda facts: runs.versions_by_query(facts("job_versions")),
    "run_states": _states,
    "failed_runs": lambda facts: runs.failed_runs(_states(facts)),
    "current_edges": _current,
    "indirect_edges": lambda facts: edges.indirect_edges(facts("job_outputs"), facts("job_keys")),
    "subtype_counts": lambda facts: edges.subtype_counts(_current(facts)),
    "fan_in": lambda facts: edges.fan_in(_current(facts)),
    "column_paths": lambda facts: graph.column_paths(_current(facts)),
    "cycles": lambda facts: order.cycles(facts("dataset_edges")),
    "levels": lambda facts: order.levels(facts("dataset_edges")),
    "column_sources": lambda facts: graph.column_sources(_current(facts)),
    "job_inputs_outputs": lambda facts: catalog.job_io_counts(facts("job_io")),
    "jobs_per_application": lambda facts: catalog.jobs_per_application(facts("jobs")),
    "placeholder_jobs": lambda facts: catalog.placeholder_jobs(facts("jobs"), facts("job_io"), facts("run_events")),
}


def _named(spark: SparkSession, names: list[str], column: str) -> DataFrame:
    return spark.createDataFrame([(name,) for name in names], f"{column} string")


def _graph(facts: Facts, starts: DataFrame, depth: int | None) -> DataFrame:
    nodes = starts.select(F.col("dataset").alias("id"), F.lit("DATASET").alias("type"))
    return graph.lineage_graph(facts("job_io"), nodes, depth)


#: Questions about some data sets.
FROM_STARTS: dict[str, Callable[[Facts, DataFrame, int | None], DataFrame]] = {
    "upstream": lambda facts, starts, depth: graph.upstream(facts("dataset_edges"), depth, starts),
    "downstream": lambda facts, starts, depth: graph.downstream(facts("dataset_edges"), depth, starts),
    "rerun_order": lambda facts, starts, depth: order.rerun_order(facts("dataset_edges"), starts),
    "lineage_graph": _graph,
}


def ask(
    spark: SparkSession, folder: str, question: str, starts: list[str] | None = None, depth: int | None = None
) -> DataFrame:
    """The answer from the fact tables of ``folder``; only those that the question needs are read."""
    facts = partial(read_facts, spark, folder)
    if question in QUESTIONS:
        return QUESTIONS[question](facts)
    if not starts:
        raise ValueError(f"{question} is asked of given data sets")
    return FROM_STARTS[question](facts, _named(spark, starts, "dataset"), depth)
