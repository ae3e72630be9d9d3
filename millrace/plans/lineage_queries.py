"""Lineage questions over facts derived from the supplied tables, one function per inventory id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.jobs import job_part, known_job
from millrace.operators.lineage import asof, audits, catalog, content, edges, graph, order, runs, versions
from millrace.plans import bindings, staging
from millrace.streaming.run_states import current_run_states, follow_run_events, stream_of
from millrace.workspace import fresh_path

Query = Callable[[SparkSession, str], DataFrame]


def lin1_datasets(spark: SparkSession, d: str) -> DataFrame:
    return catalog.datasets_in(bindings.datasets(spark, d), "BUILDING")


def lin2_jobs(spark: SparkSession, d: str) -> DataFrame:
    return catalog.jobs_in(bindings.jobs(spark, d), "F", "urgent")


def lin3_schema_history(spark: SparkSession, d: str) -> DataFrame:
    history = versions.schema_history(bindings.schema_fields(spark, d))
    return history.select("namespace", "name", "version", "part", F.array_join("fields", ",").alias("fields"))


def lin4_schema_diff(spark: SparkSession, d: str) -> DataFrame:
    return versions.schema_changes(bindings.schema_fields(spark, d))


def lin4_renames(spark: SparkSession, d: str) -> DataFrame:
    changes = versions.schema_changes(bindings.schema_fields(spark, d))
    return versions.renamed_fields(changes, bindings.declared_sources(spark, d))


def lin4_renames_by_content(spark: SparkSession, d: str) -> DataFrame:
    """Renames in the three versions of the customers table, from the data alone."""
    return content.history_of_renames(staging.schema_versions(bindings.customers(spark, d)))


def lin3_schema_of_run(spark: SparkSession, d: str) -> DataFrame:
    """The schema version of its supplier's data set that every order line saw."""
    return asof.schema_of_runs(bindings.supplier_runs(spark, d), bindings.schema_changes_in_time(spark, d))


def lin5_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.runs_per_job(bindings.run_events(spark, d))


def lin6_versions(spark: SparkSession, d: str) -> DataFrame:
    return runs.versions_per_job(bindings.run_events(spark, d))


def lin6_version_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of every job version, by the hash of its query."""
    events = bindings.run_events(spark, d)
    return events.groupBy("job", "version").agg(F.count_distinct("run_id").alias("runs"))


def lin6_queries(spark: SparkSession, d: str) -> DataFrame:
    """Different queries of every job, by their texts, beside the versions reported for them."""
    return runs.versions_by_query(bindings.job_versions(spark, d))


def lin7_run_states(spark: SparkSession, d: str) -> DataFrame:
    return runs.run_states(runs.fold_events(runs.different_events(bindings.run_events(spark, d))))


def lin7_failed(spark: SparkSession, d: str) -> DataFrame:
    return runs.failed_runs(lin7_run_states(spark, d)).select("run_id", "job")


def lin7_stream(spark: SparkSession, d: str) -> DataFrame:
    """The run states again, from a stream over the files of the events table."""
    states = fresh_path(spark, "runs")
    events = stream_of(spark, d + "/{events.parquet}", bindings.run_events_of)
    follow_run_events(events, states, fresh_path(spark, "progress")).awaitTermination()
    return current_run_states(spark, states, events.schema)


def lin8_direct_edges(spark: SparkSession, d: str) -> DataFrame:
    direct = edges.direct_edges(bindings.line_edges(spark, d))
    return direct.select(*edges.EDGE).distinct()


def lin8_current_edges(spark: SparkSession, d: str) -> DataFrame:
    """Direct edges of the version of each load that ran last."""
    versioned = bindings.versioned_edges(spark, d)
    current = edges.latest_edges(versioned, bindings.version_times(spark, d))
    return edges.different(edges.direct_edges(current), "job", "version", *edges.EDGE, most=versioned.count())


def lin8_subtypes(spark: SparkSession, d: str) -> DataFrame:
    return edges.subtype_counts(bindings.line_edges(spark, d))


def lin9_indirect_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges.indirect_edges(bindings.job_outputs(spark, d), bindings.job_keys(spark, d))


def lin10_fan_in(spark: SparkSession, d: str) -> DataFrame:
    return edges.fan_in(bindings.line_edges(spark, d))


def lin11_upstream(spark: SparkSession, d: str) -> DataFrame:
    """Upstream of the views."""
    return graph.upstream(bindings.dataset_edges(spark, d), starts=bindings.hidden_datasets(spark, d))


def lin11_upstream_of_marts(spark: SparkSession, d: str) -> DataFrame:
    """Upstream of the data sets nothing else reads."""
    links = bindings.dataset_edges(spark, d)
    written = links.select(F.col("out_dataset").alias("dataset")).distinct()
    read = links.select(F.col("in_dataset").alias("dataset")).distinct()
    marts = written.join(read, "dataset", "left_anti")
    return graph.upstream(links, starts=marts)


def lin11_downstream(spark: SparkSession, d: str) -> DataFrame:
    """Three hops downstream of the views."""
    return graph.downstream(bindings.dataset_edges(spark, d), depth=3, starts=bindings.hidden_datasets(spark, d))


def lin11_downstream_to_the_end(spark: SparkSession, d: str) -> DataFrame:
    """Everything downstream of the views."""
    return graph.downstream(bindings.dataset_edges(spark, d), starts=bindings.hidden_datasets(spark, d))


def lin11_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Parts that feed themselves over others."""
    return order.cycles(bindings.looped_dataset_edges(spark, d))


def lin11_levels(spark: SparkSession, d: str) -> DataFrame:
    """The level of every part, cycles included."""
    return order.levels(bindings.looped_dataset_edges(spark, d))


def lin11_rerun_order(spark: SparkSession, d: str) -> DataFrame:
    """What has to be made again after the views have failed, and when."""
    return order.rerun_order(bindings.dataset_edges(spark, d), bindings.hidden_datasets(spark, d))


def lin11_node_graph(spark: SparkSession, d: str) -> DataFrame:
    """Jobs and data sets before and after the suppliers in debt."""
    return graph.lineage_graph(bindings.job_io(spark, d), bindings.suppliers_in_debt(spark, d))


def lin12_column_sources(spark: SparkSession, d: str) -> DataFrame:
    return graph.column_sources(bindings.column_edges(spark, d))


def lin12_paths(spark: SparkSession, d: str) -> DataFrame:
    """The columns on the way from every mart column to its raw columns."""
    return graph.column_paths(bindings.column_edges(spark, d))


def lin13_dataset_form(spark: SparkSession, d: str) -> DataFrame:
    """What every output column takes from a data set, as one text per row."""
    form = edges.to_dataset_form(bindings.line_edges(spark, d))
    texts = F.transform(
        "pairs", lambda p: F.concat_ws(">", p["in_column"], p["type"], p["subtype"])
    )
    return form.select(
        "out_dataset",
        "in_dataset",
        "out_column",
        F.size("pairs").cast("bigint").alias("edges"),
        F.array_join(F.array_sort(texts), ";").alias("pairs"),
    )


def lin13_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Column edges that went through the data set form."""
    return edges.from_dataset_form(edges.to_dataset_form(bindings.line_edges(spark, d)))


def lin14_job_io(spark: SparkSession, d: str) -> DataFrame:
    return catalog.job_io_counts(bindings.job_io(spark, d))


def lin15_freshness(spark: SparkSession, d: str) -> DataFrame:
    expected, updates = bindings.expected_datasets(spark, d), bindings.dataset_updates(spark, d)
    return audits.freshness(expected, updates, bindings.RUN_START)


def lin16_normalise(spark: SparkSession, d: str) -> DataFrame:
    return audits.normalised(bindings.namespaces(spark, d))


def lin17_accepted(spark: SparkSession, d: str) -> DataFrame:
    return audits.accepted_events(bindings.event_datasets(spark, d))


def lin17_reasons(spark: SparkSession, d: str) -> DataFrame:
    return audits.rejections(bindings.event_datasets(spark, d))


def lin18_collisions(spark: SparkSession, d: str) -> DataFrame:
    return audits.collisions(bindings.namespaces(spark, d))


def lin19_job_parts(spark: SparkSession, d: str) -> DataFrame:
    job = F.col("job")
    return bindings.job_names(spark, d).select(
        known_job(job).alias("job"),
        job_part(job, 1).alias("app"),
        job_part(job, 2).alias("node"),
        job_part(job, 3).alias("output"),
    )


def lin20_identity(spark: SparkSession, d: str) -> DataFrame:
    return audits.identities(bindings.locations(spark, d), bindings.JOB_NAMESPACE)


def lin21_placeholders(spark: SparkSession, d: str) -> DataFrame:
    return catalog.placeholder_jobs(
        bindings.order_jobs(spark, d), bindings.job_io(spark, d), bindings.returned_runs(spark, d)
    )


def lin22_shared_application(spark: SparkSession, d: str) -> DataFrame:
    return catalog.jobs_per_application(bindings.jobs(spark, d))


def lin23_without_views(spark: SparkSession, d: str) -> DataFrame:
    return graph.without_hidden(bindings.dataset_edges(spark, d), bindings.hidden_datasets(spark, d))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        lin1_datasets, lin2_jobs, lin3_schema_history, lin4_schema_diff, lin4_renames, lin4_renames_by_content, lin3_schema_of_run, lin5_runs, lin6_versions,
        lin6_version_runs, lin6_queries, lin7_run_states, lin7_failed, lin7_stream, lin8_direct_edges, lin8_subtypes,
        lin9_indirect_edges, lin10_fan_in, lin11_upstream, lin11_upstream_of_marts, lin11_downstream,
        lin11_downstream_to_the_end, lin11_cycles, lin11_levels, lin11_rerun_order,
        lin8_current_edges, lin11_node_graph, lin12_column_sources, lin12_paths, lin13_dataset_form, lin13_round_trip, lin14_job_io, lin15_freshness, lin16_normalise,
        lin17_accepted, lin17_reasons, lin18_collisions, lin19_job_parts, lin20_identity, lin21_placeholders,
        lin22_shared_application, lin23_without_views,
    )
}
