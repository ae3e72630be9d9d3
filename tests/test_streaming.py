from __future__ import annotations

import os
from datetime import datetime, timedelta
from pathlib import Path

from millrace.operators.lineage import runs
from millrace.sources import facts
from millrace.streaming.run_states import current_run_states, follow_run_events, stream_of

DAY = datetime(2024, 1, 1)


def _write(spark, path, events):
    rows = [(i, run, "job", "v", state, DAY + timedelta(seconds=second)) for i, run, state, second in events]
    spark.createDataFrame(rows, facts.RUN_EVENTS).coalesce(1).write.mode("append").parquet(path)


def _follow(spark, folder):
    stream = stream_of(spark, f"{folder}/events", lambda df: df, files_per_batch=1)
    query = follow_run_events(stream, f"{folder}/states", f"{folder}/progress", partitions=8)
    query.awaitTermination()
    return query


def _streamed(spark, folder):
    return current_run_states(spark, f"{folder}/states", spark.read.parquet(f"{folder}/events").schema)


def _batch(spark, folder):
    return runs.run_states(runs.fold_events(runs.different_events(spark.read.parquet(f"{folder}/events"))))


def _files(folder):
    return {str(p) for p in Path(f"{folder}/states").rglob("*.parquet")}


def test_stream_equals_batch_after_every_arrival(spark, folder, rows):
    """Every arrival restarts the stream from its checkpoint, so the state comes from the store."""
    arrivals = [
        [(1, 1, "START", 0), (2, 2, "START", 5)],
        [(3, 1, "COMPLETE", 9), (4, 3, "START", 9)],
        [(5, 2, "FAIL", 7)],
        # late by far: the start of run 3 and an event before the failure of run 2
        [(6, 3, "START", -86_400), (7, 2, "RUNNING", 6)],
        # delivered again, one of them in the same batch twice
        [(3, 1, "COMPLETE", 9), (8, 4, "START", 1), (8, 4, "START", 1)],
    ]
    for events in arrivals:
        _write(spark, f"{folder}/events", events)
        _follow(spark, folder)
        assert rows(_streamed(spark, folder)) == rows(_batch(spark, folder))
    found = {row.run_id: (row.state, row.events) for row in _streamed(spark, folder).collect()}
    assert found == {1: ("COMPLETE", 2), 2: ("FAIL", 3), 3: ("START", 2), 4: ("START", 1)}


def test_replayed_batch_counts_once(spark, folder, rows):
    """The table was written, the commit of the batch was not: the batch is run again."""
    for events in ([(1, 1, "START", 0), (2, 1, "COMPLETE", 3)], [(3, 2, "START", 1), (4, 1, "FAIL", 5)]):
        _write(spark, f"{folder}/events", events)
        _follow(spark, folder)
    wanted = rows(_streamed(spark, folder))
    commits = f"{folder}/progress/commits"
    os.remove(f"{commits}/1")
    os.remove(f"{commits}/.1.crc")
    _follow(spark, folder)
    assert rows(_streamed(spark, folder)) == wanted == rows(_batch(spark, folder))


def test_small_batches_equal_one_batch(spark, folder, rows):
    for i in range(5):
        _write(spark, f"{folder}/events", [(i, i % 2, "RUNNING", 10 - i), (100 + i, 7 + i, "START", i)])
    _follow(spark, folder)
    assert rows(_streamed(spark, folder)) == rows(_batch(spark, folder))
    assert len(_files(folder)) <= 8  # a file for each partition, not for each batch


def test_only_touched_partitions_are_written_again(spark, folder, rows):
    _write(spark, f"{folder}/events", [(i, i, "START", i) for i in range(40)])
    _follow(spark, folder)
    before = _files(folder)
    _write(spark, f"{folder}/events", [(100, 5, "COMPLETE", 90)])
    _follow(spark, folder)
    now = _files(folder)
    assert len(before) == len(now) == 8 and len(before & now) == 7
    assert rows(_streamed(spark, folder)) == rows(_batch(spark, folder))


def test_nothing_to_follow(spark, folder):
    _write(spark, f"{folder}/events", [])
    _follow(spark, folder)
    assert _streamed(spark, folder).count() == 0


def test_the_state_is_in_sparks_store(spark, folder):
    _write(spark, f"{folder}/events", [(1, 1, "START", 0), (2, 2, "START", 0), (3, 2, "COMPLETE", 1)])
    query = _follow(spark, folder)
    operators = [op for progress in query.recentProgress for op in progress["stateOperators"]]
    assert {op["operatorName"] for op in operators} == {"dedupe", "stateStoreSave"}
    assert max(op["numRowsTotal"] for op in operators if op["operatorName"] == "stateStoreSave") == 2
