"""Where jobs keep intermediate tables.

Everything a job has to write down between two steps goes below the folder that the
cluster names in ``spark.checkpoint.dir``. That folder is shared, so a lost executor
costs a re-read and nothing else. A private temporary folder is used only for a local
master that names no folder, which is the case in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables, as the session names it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    global _local_root
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="millrace-")
    return _local_root


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def fresh_database(spark: SparkSession, label: str) -> str:
    """Create a database of its own for one run; its tables live in the shared folder."""
    name = f"{label}_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{fresh_path(spark, name)}'")
    return name


def write_counted(df: DataFrame, path: str) -> int:
    """Write ``df`` and return its row count, observed during the write: no second job."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return seen.get["rows"]


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder; return it as read back, and its row count."""
    path = fresh_path(df.sparkSession, label)
    rows = write_counted(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), rows
