"""Schemas of the lineage fact tables that a user supplies, and a reader that holds tables to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DATASETS = "namespace string, name string, updated_at timestamp_ntz"
SCHEMA_FIELDS = "namespace string, name string, version int, pos int, field string, type string"
JOBS = "namespace string, job string, app_id string"
JOB_VERSIONS = "job string, version string, query_text string"
JOB_IO = "job string, version string, role string, dataset string"
JOB_OUTPUTS = "job string, version string, out_dataset string, out_column string"
JOB_KEYS = "job string, version string, in_dataset string, in_column string, subtype string"
RUN_EVENTS = "event_id bigint, run_id bigint, job string, version string, state string, ts timestamp_ntz"
COLUMN_EDGES = (
    "job string, version string, out_dataset string, out_column string, "
    "in_dataset string, in_column string, type string, subtype string"
)
DATASET_EDGES = "out_dataset string, in_dataset string"

TABLES = {
    "datasets": DATASETS,
    "schema_fields": SCHEMA_FIELDS,
    "jobs": JOBS,
    "job_versions": JOB_VERSIONS,
    "job_io": JOB_IO,
    "job_outputs": JOB_OUTPUTS,
    "job_keys": JOB_KEYS,
    "run_events": RUN_EVENTS,
    "column_edges": COLUMN_EDGES,
    "dataset_edges": DATASET_EDGES,
}


def checked(df: DataFrame, name: str) -> DataFrame:
    """The columns of the fact table ``name``, in their order; further columns are left out.

    A column that is missing or has another type is an error that names all of them.
    """
    wanted = StructType.fromDDL(TABLES[name])
    present = dict(df.dtypes)
    wrong = [
        f"{field.name}: {present.get(field.name, 'missing')}, not {field.dataType.simpleString()}"
        for field in wanted
        if present.get(field.name) != field.dataType.simpleString()
    ]
    if wrong:
        raise ValueError(f"fact table {name}: " + "; ".join(wrong))
    return df.select(*wanted.names)


def read_facts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The fact table ``name`` of a folder of parquet tables."""
    return checked(spark.read.parquet(f"{folder}/{name}"), name)

# The kinds of column edge.
DIRECT = "DIRECT"
INDIRECT = "INDIRECT"
DIRECT_SUBTYPES = ("IDENTITY", "TRANSFORMATION", "AGGREGATION")
INDIRECT_SUBTYPES = ("JOIN", "GROUP_BY", "FILTER", "SORT", "WINDOW", "CONDITIONAL")
