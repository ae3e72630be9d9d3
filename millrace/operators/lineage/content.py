"""Renamed columns, found by what is in them.

Field lists show that a column went and another came, not that they are the same one. Here the values of
both are compared: one pass over each version makes a theta sketch of every column that went or came, a
sample of the smallest hashes that partial aggregation merges, and the sketches tell how much two
columns have in common. What is compared are columns, so a table of any size is a few kilobytes there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Base-2 logarithm of the hashes that a sketch keeps; columns with fewer different values are compared exactly.
LOG_HASHES = 14


def column_sketches(df: DataFrame, columns: Sequence[str], log_hashes: int = LOG_HASHES) -> DataFrame:
    """``field, sketch, different``: a sketch of the values of each column, as text and without nulls, in one pass."""
    one_row = df.agg(
        *[F.theta_sketch_agg(F.col(f"`{name}`").cast("string"), F.lit(log_hashes)).alias(f"s{k}") for k, name in enumerate(columns)]
    )
    fields = F.array(*[F.struct(F.lit(name).alias("field"), F.col(f"s{k}").alias("sketch")) for k, name in enumerate(columns)])
    return one_row.select(F.inline(fields)).withColumn("different", F.theta_sketch_estimate("sketch"))


def renames_by_content(before: DataFrame, after: DataFrame, least: float = 0.5, log_hashes: int = LOG_HASHES) -> DataFrame:
    """``old_field, new_field``: columns of ``before`` that went on under another name in ``after``.

    The overlap of two columns is the number of values they share over the number that either has. Two are one
    column if the overlap is at least ``least`` and neither overlaps more with another (of equal overlaps the
    first by name counts). Columns without a value match nothing. Types may differ if the texts of the values agree.
    """
    gone = [name for name in before.columns if name not in after.columns]
    new = [name for name in after.columns if name not in before.columns]
    if not gone or not new:
        return before.sparkSession.createDataFrame([], "old_field STRING, new_field STRING")
    old = column_sketches(before, gone, log_hashes).withColumn("went", F.lit(True))
    now = column_sketches(after, new, log_hashes).withColumn("went", F.lit(False))
    column = F.struct("field", "sketch")
    # One row with a struct for every column: what is paired is bounded by the schemas.
    pairs = (
        old.unionByName(now)
        .agg(
            F.collect_list(F.when(F.col("went"), column)).alias("old"),
            F.collect_list(F.when(~F.col("went"), column)).alias("now"),
        )
        .select(F.explode("old").alias("o"), "now")
        .select("o", F.explode("now").alias("n"))
        .select(
            F.col("o.field").alias("old_field"),
            F.col("n.field").alias("new_field"),
            F.theta_sketch_estimate(F.theta_intersection("o.sketch", "n.sketch")).alias("shared"),
            F.theta_sketch_estimate(F.theta_union("o.sketch", "n.sketch", F.lit(log_hashes))).alias("either"),
        )
        .where(F.col("shared") >= F.lit(least) * F.col("either"))
        .where("shared > 0")
        .withColumn("overlap", F.col("shared") / F.col("either"))
    )
    best = F.row_number().over(Window.partitionBy("old_field").orderBy(F.desc("overlap"), "new_field"))
    back = F.row_number().over(Window.partitionBy("new_field").orderBy(F.desc("overlap"), "old_field"))
    ranked = pairs.select("old_field", "new_field", best.alias("best"), back.alias("back"))
    return ranked.where("best = 1 AND back = 1").select("old_field", "new_field")


def history_of_renames(versions: Sequence[DataFrame], least: float = 0.5, log_hashes: int = LOG_HASHES) -> DataFrame:
    """``version, old_field, new_field`` over the versions of a table in their order; the first has number 1."""
    found = None
    for number, (before, after) in enumerate(zip(versions[:-1], versions[1:], strict=True), 2):
        step = renames_by_content(before, after, least, log_hashes).select(F.lit(number).alias("version"), "old_field", "new_field")
        found = step if found is None else found.unionByName(step)
    if found is None:
        raise ValueError("one version alone has no renames")
    return found
