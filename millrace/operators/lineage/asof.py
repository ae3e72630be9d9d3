"""The version that was in force when a run began: an as-of join.

Runs and versions of a data set go into one table in order of time, and every run takes the last version
before it. A data set with very many runs is not one group: all of the time is cut into ranges that hold
about equally many runs, each data set is worked on by range, and what a range takes over from the ranges
before it is the last version of these, one row for a range. Runs that began at one time are one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.workspace import materialise

#: Ranges of time.
RANGES = 256


def _range_of(at: Column, bounds: list) -> Column:
    """Number of the range that a time lies in: how many of the sorted bounds are at or before it.

    Found by halving, eight comparisons for 256 ranges.
    """

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(at < bounds[middle], within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(bounds))


def version_at(
    runs: DataFrame, versions: DataFrame, key: list[str], at: str = "started_at", since: str = "since", version: str = "version", ranges: int = RANGES
) -> DataFrame:
    """``runs`` with the column ``version``: that of the same ``key`` with the latest ``since`` at or before ``at``.

    NULL before the first version, and for a NULL time or key. Of versions with one time the highest counts.
    """
    times, _ = materialise(
        runs.select(*key, F.col(at).alias("at")).where(F.col("at").isNotNull()).distinct(), "times"
    )
    shares = [k / ranges for k in range(1, ranges)]
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    bounds = times.agg(F.percentile_approx(micros, shares, 10_000)).first()[0] or []
    bounds = sorted(set(bounds))

    def ranged(df: DataFrame) -> DataFrame:
        return df.withColumn("range", _range_of(F.unix_micros(F.col("at").cast("timestamp")), bounds))

    changed = ranged(
        versions.select(*key, F.col(since).alias("at"), F.col(version).alias("version")).where(F.col("at").isNotNull())
    )
    changed = changed.groupBy(*key, "range", "at").agg(F.max("version").alias("version"))
    changed, _ = materialise(changed, "changed")
    # The last version of each range, carried on to the next range in which the data set occurs.
    last = changed.groupBy(*key, "range").agg(F.max(F.struct("at", "version")).alias("last"))
    own = ranged(times)
    places = own.select(*key, "range").distinct().join(last, [*key, "range"], "full")
    before = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = places.select(*key, "range", F.last("last.version", ignorenulls=True).over(before).alias("carried"))
    both = own.select(*key, "range", "at", F.lit(None).cast(changed.schema["version"].dataType).alias("version"), F.lit(True).alias("run")).unionByName(
        changed.select(*key, "range", "at", "version", F.lit(False).alias("run"))
    )
    so_far = Window.partitionBy(*key, "range").orderBy("at", "run").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("found", F.last("version", ignorenulls=True).over(so_far)).where("run")
    found = met.join(carried, [*key, "range"], "left").select(
        *key, F.col("at").alias(at), F.coalesce("found", "carried").alias("version")
    )
    found, _ = materialise(found, "found")
    # A plain equi-join on key and time: adaptive execution splits what is hot.
    return runs.join(found, [*key, at], "left").select(*[runs[name] for name in runs.columns], "version")


def schema_of_runs(runs: DataFrame, versions: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``runs`` (``run_id, namespace, name, started_at``) with the schema ``version`` of the data set that each run saw.

    ``versions`` has ``namespace, name, version, since``.
    """
    return version_at(runs, versions, ["namespace", "name"], ranges=ranges)
