"""Readers: parquet directories, merged schemas, delimited and plain text, file lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a directory of parquet tables."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_merged(spark: SparkSession, path: str, *columns: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet files of several schemas as one table; a column a file does not have is NULL.

    With the merged ``schema``, which a caller that wrote the files knows, no file is opened to plan
    the read; without it every footer is. The order of merged columns follows the order of the files,
    so callers name the columns they want. Columns of one name and two types make the read fail,
    they are not cast.
    """
    read = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    merged = read.parquet(path)
    return merged.select(*columns) if columns else merged


def read_delimited(spark: SparkSession, path: str, schema: str | T.StructType, separator: str = ",") -> DataFrame:
    """Delimited text without header; a cell that does not fit its type is NULL."""
    return spark.read.schema(schema).csv(path, sep=separator)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files, one row per line, column ``value``."""
    return spark.read.text(path)


def data_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """The data files below a path with their sizes; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
    )


def rows_per_file(df: DataFrame) -> DataFrame:
    """How many rows each file of a scanned path holds. A file without rows is not listed."""
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("row_count"))
