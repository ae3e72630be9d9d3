"""Writers that add something to the plain DataFrame writer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def write_files(df: DataFrame, path: str, files: int | None = None, mode: str = "overwrite") -> None:
    """Write parquet files: exactly ``files``, rows dealt out evenly whatever their keys, or one per task."""
    (df if files is None else df.repartition(files)).write.mode(mode).parquet(path)


def rewrite_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace exactly the partitions that ``df`` has rows of; the files of the others stay as they are.

    The new files are written beside the old ones and take their place at the end, so ``df`` may read
    the partitions that it replaces, and a rerun of one slice leaves what one run of it leaves. A slice
    that has become empty has no row and keeps its old files.
    """
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).mode("overwrite").parquet(path)


def replace_table(df: DataFrame, name: str) -> None:
    """Create or replace a table with the rows and the schema of ``df``.

    Unlike a plain overwrite this also works when ``df`` reads the table it replaces: the new
    rows are written beside the old table under a name that no other run has. The old table is
    renamed, not dropped, until the new one has its name, and gets it back if that fails.
    """
    spark, run = df.sparkSession, uuid.uuid4().hex
    beside, before = f"{name}__new_{run}", f"{name}__old_{run}"
    replaced = spark.catalog.tableExists(name)
    try:
        df.write.saveAsTable(beside)
        if replaced:
            spark.sql(f"ALTER TABLE {name} RENAME TO {before}")
        try:
            spark.sql(f"ALTER TABLE {beside} RENAME TO {name}")
        except Exception:
            if replaced:
                spark.sql(f"ALTER TABLE {before} RENAME TO {name}")
            raise
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {beside}")
        raise
    if replaced:
        spark.sql(f"DROP TABLE {before}")


def drop_tables(spark: SparkSession, database: str, *names: str) -> None:
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")


def recreate_database(spark: SparkSession, name: str, location: str | None = None) -> None:
    """An empty database of this name, whatever was in it before."""
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE {name}{where}")
