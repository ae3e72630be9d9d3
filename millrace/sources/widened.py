"""Parquet files of one data set whose columns changed their types, as one table.

Files that agree are read together: a merged read of a list of files either gives their common schema or
fails on a column of two types, and then the two halves of the list are tried. Spark reads the footers of
a list in parallel, and a data set written in batches has few changes, so this takes few reads. Each
group is read by its own schema and then cast, up and never down, to the common type.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.tables import data_files

# Integral types in the order of their width.
INTEGRAL = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())
DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def common_type(one: T.DataType, other: T.DataType) -> T.DataType:
    """The narrowest type that holds the values of both; text, if nothing else does.

    Whole numbers widen, a whole number and a fraction are a double, a whole number and a decimal a decimal with
    room for both, a date and a time a time. Nested types that differ are text.
    """
    if one == other:
        return one
    if one in INTEGRAL and other in INTEGRAL:
        return max(one, other, key=INTEGRAL.index)
    if all(kind in INTEGRAL or isinstance(kind, (T.FloatType, T.DoubleType)) for kind in (one, other)):
        return T.DoubleType()
    if all(kind in INTEGRAL or isinstance(kind, T.DecimalType) for kind in (one, other)):
        sizes = [
            (kind.precision - kind.scale, kind.scale) if isinstance(kind, T.DecimalType) else (DIGITS[kind.simpleString()], 0)
            for kind in (one, other)
        ]
        whole, scale = (max(column) for column in zip(*sizes, strict=True))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    times = (T.DateType(), T.TimestampNTZType())
    if one in times and other in times:
        return T.TimestampNTZType()
    return T.StringType()


def common_schema(schemas: list[T.StructType]) -> T.StructType:
    """All columns of all schemas, in order of their first appearance, each with its common type."""
    kinds: dict[str, T.DataType] = {}
    for schema in schemas:
        for field in schema:
            kinds[field.name] = common_type(kinds.get(field.name, field.dataType), field.dataType)
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def schema_groups(spark: SparkSession, files: list[str], base: str) -> list[tuple[T.StructType, list[str]]]:
    """The files in groups that a merged read can read, with the merged schema of each; groups are runs of the list."""

    def merged(part: list[str]) -> T.StructType | None:
        try:
            return spark.read.options(mergeSchema=True, basePath=base).parquet(*part).schema
        except (PySparkException, Py4JJavaError) as error:
            if "CANNOT_MERGE" not in str(error):
                raise
            return None

    def grouped(part: list[str]) -> list[tuple[T.StructType, list[str]]]:
        schema = merged(part)
        if schema is not None:
            return [(schema, part)]
        middle = len(part) // 2
        return grouped(part[:middle]) + grouped(part[middle:])

    def agree(one: T.StructType, other: T.StructType) -> bool:
        kinds = {field.name: field.dataType for field in one}
        return all(kinds.get(field.name, field.dataType) == field.dataType for field in other)

    groups: list[tuple[T.StructType, list[str]]] = []
    for schema, part in grouped(files) if files else []:
        # Halves may have cut a run of equal files, and equal files may lie apart.
        for k, (known, held) in enumerate(groups):
            if agree(known, schema):
                extra = [field for field in schema if field.name not in known.names]
                groups[k] = (T.StructType([*known.fields, *extra]), held + part)
                break
        else:
            groups.append((schema, part))
    return groups


def read_widened(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """All parquet files below ``path`` as one table; a column of several types has their common type.

    A column that a file does not have is NULL. Columns are named by the caller, or else come in the order of
    their first appearance by file name. No file, no table: that is an error, as it is for a plain read.
    """
    files = [row.path for row in data_files(spark, path).select("path").orderBy("path").collect()]
    if not files:
        return spark.read.parquet(path)
    groups = schema_groups(spark, files, path)
    wanted = common_schema([schema for schema, _ in groups])
    whole = None
    for schema, part in groups:
        read = spark.read.schema(schema).option("basePath", path).parquet(*part)
        cast = read.select(
            *[
                (F.col(f"`{field.name}`") if field.name in schema.names else F.lit(None)).cast(field.dataType).alias(field.name)
                for field in wanted
            ]
        )
        whole = cast if whole is None else whole.unionByName(cast)
    return whole.select(*columns) if columns else whole
