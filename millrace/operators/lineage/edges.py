"""Column edges: direct and indirect ones, fan-in, and the form per pair of data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.facts import DIRECT, DIRECT_SUBTYPES, INDIRECT, INDIRECT_SUBTYPES
from millrace.workspace import materialise

#: Edges that one task removes repetitions from.
TASK_EDGES = 500_000
EDGE = ("out_dataset", "out_column", "in_dataset", "in_column", "type", "subtype")


def direct_edges(column_edges: DataFrame) -> DataFrame:
    """Edges that carry a value from an input column to an output column."""
    return column_edges.where((F.col("type") == DIRECT) & F.col("subtype").isin(*DIRECT_SUBTYPES))


def latest_edges(column_edges: DataFrame, versions: DataFrame) -> DataFrame:
    """The edges of the last version of every job, by time and then by version.

    ``versions`` has ``job, version, ts``; run events will do. A job without a version there has no edges.
    The last versions are written first: if the jobs are few, their edges are not shuffled by job.
    """
    last = versions.groupBy("job").agg(F.max(F.struct("ts", "version")).alias("last"))
    last, _ = materialise(last.select("job", F.col("last.version").alias("version")), "last")
    return column_edges.join(last, ["job", "version"])


def different(column_edges: DataFrame, *columns: str, most: int) -> DataFrame:
    """Different rows of the ``columns``, where there are at most ``most`` rows.

    The rows are dealt by all the columns before repetitions are removed, so what a task holds is bounded by
    ``TASK_EDGES`` and not by the size of a file or the number of shuffle partitions.
    """
    return column_edges.select(*columns).repartition(most // TASK_EDGES + 1, *columns).distinct()


def subtype_counts(column_edges: DataFrame) -> DataFrame:
    """Different edges of every job by type and subtype."""
    different = column_edges.select("job", *EDGE).distinct()
    return different.groupBy("job", "type", "subtype").agg(F.count(F.lit(1)).alias("edges"))


def indirect_edges(job_outputs: DataFrame, job_keys: DataFrame) -> DataFrame:
    """Every join, grouping, filter or sort key of a job version affects all its output columns.

    An equi-join on the job version. The result is as large as the answer; facts reported
    repeatedly are removed before the join, and adaptive execution splits the keys and the
    outputs of a job that is much larger than the others.
    """
    outputs = job_outputs.select("job", "version", "out_dataset", "out_column").distinct()
    keys = (
        job_keys.where(F.col("subtype").isin(*INDIRECT_SUBTYPES))
        .select("job", "version", "in_dataset", "in_column", "subtype")
        .distinct()
    )
    ends = ["out_dataset", "out_column", "in_dataset", "in_column"]
    both = outputs.join(keys, ["job", "version"])
    return both.select("job", "version", *ends, F.lit(INDIRECT).alias("type"), "subtype")


def fan_in(column_edges: DataFrame) -> DataFrame:
    """How many different edges enter every output column, by type and by direct subtype."""
    is_type = {kind: F.col("type") == kind for kind in (DIRECT, INDIRECT)}

    def of(condition: Column, name: str) -> Column:
        return F.count(F.when(condition, 1)).alias(name)

    return (
        column_edges.select(*EDGE)
        .distinct()
        .groupBy("out_dataset", "out_column")
        .agg(
            F.count(F.lit(1)).alias("edges"),
            of(is_type[DIRECT], "direct"),
            of(is_type[INDIRECT], "indirect"),
            *[of(is_type[DIRECT] & (F.col("subtype") == kind), kind.lower()) for kind in DIRECT_SUBTYPES],
        )
    )


def to_dataset_form(column_edges: DataFrame) -> DataFrame:
    """``out_dataset, in_dataset, out_column, pairs``: what each output column takes from a data set.

    The array holds ``in_column, type, subtype`` and is as long as the input data set is wide, whatever
    the number of rows; the form is the same for few and for many edges.
    """
    ends = ["out_dataset", "in_dataset", "out_column"]
    pairs = column_edges.select(*EDGE).distinct()
    return pairs.groupBy(*ends).agg(F.array_sort(F.collect_list(F.struct("in_column", "type", "subtype"))).alias("pairs"))


def from_dataset_form(dataset_edges: DataFrame) -> DataFrame:
    """The column edges again, one row each."""
    return dataset_edges.select("out_dataset", "out_column", "in_dataset", F.explode("pairs").alias("pair")).select(
        "out_dataset", "out_column", "in_dataset", "pair.in_column", "pair.type", "pair.subtype"
    )
