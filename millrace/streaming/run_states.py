"""Run states kept up to date from a growing directory of run events.

Spark's state store holds the fold of every run: a streaming aggregation in update mode gives, for
the runs that a micro-batch touches, their whole state so far. These rows replace the older ones in a
table of run states, which is cut by a hash of the run into partitions; only touched partitions are
written again. A micro-batch that is replayed after a failure gives the same rows and so the same table.

An event that arrives late changes its run like any other, and an event delivered again is known by its
id; for that no state is ever given up. The state store is on the workers' disks (RocksDB) if the session
says so; state and table grow with the runs and event ids, not with the number of micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.lineage.runs import different_events, fold_events, run_states
from millrace.sinks.writers import rewrite_partitions
from millrace.workspace import materialise

#: Partitions of the table of run states.
PARTITIONS = 64


def _empty_folds(spark: SparkSession, run_events: DataFrame) -> DataFrame:
    return fold_events(spark.createDataFrame([], run_events.schema)).withColumn("part", F.lit(0))


def follow_run_events(run_events: DataFrame, states: str, checkpoint: str, partitions: int = PARTITIONS) -> StreamingQuery:
    """Start keeping the folds of a stream of run events in the table ``states``; stops when all present files are read."""
    spark = run_events.sparkSession
    schema = _empty_folds(spark, run_events).schema

    def replace(batch: DataFrame, batch_id: int) -> None:
        part = F.pmod(F.xxhash64("run_id"), F.lit(partitions)).cast("int")
        touched, rows = materialise(batch.withColumn("part", part), "touched")
        if rows:
            before = spark.read.schema(schema).parquet(states)
            others = before.join(touched.select("part").distinct(), "part", "left_semi").join(
                touched.select("run_id"), "run_id", "left_anti"
            )
            rewrite_partitions(touched.unionByName(others).repartition("part"), states, "part")

    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("part").parquet(states)
    return (
        fold_events(different_events(run_events))
        .writeStream.outputMode("update")
        .foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_run_states(spark: SparkSession, states: str, run_events_schema: T.StructType) -> DataFrame:
    """State of every run according to all events followed so far."""
    empty = spark.createDataFrame([], run_events_schema)
    return run_states(spark.read.schema(_empty_folds(spark, empty).schema).parquet(states))


def stream_of(
    spark: SparkSession, path: str, events: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000
) -> DataFrame:
    """A growing set of parquet files as a stream, mapped to run events by ``events``.

    ``path`` is a directory or a glob; a single file has to be written as a glob, ``{name.parquet}``.
    """
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return events(raw)
