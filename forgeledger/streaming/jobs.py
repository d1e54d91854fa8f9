"""Structured Streaming versions of the log reports and of the state snapshot.

Functions named ``stream_*`` take a streaming DataFrame and return one. ``run_available``
drives one to the end of its input into an updatable folder; a long-running job would use
the same sink with a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.changes import latest_state
from ..operators.oplog import success_rate, threshold_alerts, window_start
from ..sources.snapshots import exists, read_snapshot, versions, write_snapshot
from ..sources.state_table import StateTable
from ..sources.updates import UpdateTable


def stream_errors(logs: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Errors per tumbling window. Lines later than ``delay`` are dropped."""
    errors = logs.where("level = 'ERROR'").withWatermark("ts", delay)
    return errors.groupBy(window_start("ts", width).alias("bin")).agg(F.count(F.lit(1)).alias("n_errors"))


def stream_success_rate(
    logs: DataFrame, width: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    return success_rate(logs.withWatermark("ts", delay), width, slide)


def stream_alerts(rows: DataFrame) -> DataFrame:
    return threshold_alerts(rows)


def stream_operation_pairing(
    starts: DataFrame, ends: DataFrame, timeout: str = "1 hour", delay: str = "10 minutes"
) -> DataFrame:
    """Started operations with their end, or without one once ``timeout`` and ``delay`` passed.

    Both sides carry ``operation_id`` and ``ts``; ends also carry ``state``. The time bound
    lets Spark drop the state of operations that can no longer end.
    """
    left = starts.select("operation_id", "url", F.col("ts").alias("started_at")).withWatermark("started_at", delay)
    right = ends.select(
        F.col("operation_id").alias("end_id"), F.col("ts").alias("ended_at"), F.col("state").alias("end_state")
    ).withWatermark("ended_at", delay)
    in_time = F.expr(
        f"operation_id = end_id and ended_at >= started_at and ended_at <= started_at + interval {timeout}"
    )
    return left.join(right, in_time, "left").select("operation_id", "url", "started_at", "ended_at", "end_state")


def close_open_operations(paired: DataFrame, starts: DataFrame) -> DataFrame:
    """The stream's pairs so far, plus the starts it still holds open, with an outcome each."""
    still_open = starts.join(paired.select("operation_id"), "operation_id", "left_anti")
    every = paired.unionByName(still_open, allowMissingColumns=True)
    return every.withColumn("outcome", F.coalesce("end_state", F.lit("unfinished"))).drop("end_state")


_CLOSED = "operation_id bigint, url string, started_at timestamp, ended_at timestamp, outcome string"
_HELD = "url string, started_at timestamp, ended_at timestamp, end_state string, closed boolean"


def _closing(micros: int):
    """Follow one operation from its first notice until its time is over; give its row out once."""

    def row(key: tuple, held: tuple, ended_at, outcome: str) -> pd.DataFrame:
        return pd.DataFrame({"operation_id": [key[0]], "url": [held[0]], "started_at": [held[1]], "ended_at": [ended_at], "outcome": [outcome]})

    def run(key: tuple, notices: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None, None, None, False)
        if state.hasTimedOut:
            state.remove()
            if held[1] is not None and not held[4]:
                yield row(key, held, pd.NaT, "unfinished")
            return
        url, started_at, ended_at, end_state, closed = held
        for batch in notices:
            for note in batch.itertuples(index=False):
                if note.state == "started":
                    if started_at is None or note.ts < started_at:
                        url, started_at = note.url, note.ts.to_pydatetime()
                elif note.state in ("completed", "failed") and (ended_at is None or note.ts < ended_at):
                    ended_at, end_state = note.ts.to_pydatetime(), note.state
        if started_at is None and ended_at is None:
            return
        span = timedelta(microseconds=micros)
        in_time = started_at is not None and ended_at is not None and started_at <= ended_at <= started_at + span
        if in_time and not closed:
            yield row(key, (url, started_at), ended_at, end_state)
            closed = True
        # What is held until then also keeps a notice that comes twice from closing twice.
        state.update((url, started_at, ended_at, end_state, closed))
        over = ((started_at or ended_at) + span).replace(tzinfo=timezone.utc).timestamp() * 1000
        state.setTimeoutTimestamp(max(int(over) + 1, state.getCurrentWatermarkMs() + 1))

    return run


def stream_closed_operations(notices: DataFrame, timeout_seconds: int = 3600, delay: str = "10 minutes") -> DataFrame:
    """Every started operation once: when its end is known, or as unfinished when its time has passed without one.

    ``stream_operation_pairing`` does the same by a join and is faster; an end that comes twice gives two rows there, and a
    start that comes twice two as well, while here state that is kept for each operation lets the first of each count.

    ``notices(operation_id, url, ts, state)`` holds started, completed and failed notices in any order, and others, which
    only move the clock. An operation's state is kept until ``timeout_seconds`` after its start, in event time behind the
    watermark, and then leaves by itself; ends later than that do not count.
    """
    timed = notices.select("operation_id", "url", "ts", "state").withWatermark("ts", delay)
    return timed.groupBy("operation_id").applyInPandasWithState(
        _closing(timeout_seconds * 1_000_000), _CLOSED, _HELD, "append", GroupStateTimeout.EventTimeTimeout
    )


def update_folder(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: each batch's rows in a folder of their own, replaced on replay."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_updates(spark: SparkSession, path: str, schema, keys: Sequence[str]) -> DataFrame:
    """The last update of every key. Keys are reduced before the shuffle."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)  # no batch has had any input yet
    rows = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
    parts = rows.select("*", F.col("_metadata.file_path").alias("__file"))
    batch = F.regexp_extract("__file", r"/batch=(\d+)/", 1).cast("long")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = parts.groupBy(*keys).agg(F.max_by(F.struct(*values), batch).alias("__last"))
    return last.select(*keys, *[F.col("__last")[c].alias(c) for c in values])


def run_available(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"
) -> None:
    """Process everything that is there now, then stop. Restarting continues after it."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def update_table_sink(path: str, schema, keys: Sequence[str], keep: int = 2) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink into an ``UpdateTable``: a reader opens one folder a level, however many batches there were."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table = UpdateTable(batch.sparkSession, path, schema, keys)
        if table.add(batch, batch_id):
            table.expire(keep)

    return write


def state_table_sink(
    path: str, schema, keys: Sequence[str] = ("repo",), order: Sequence[str] = ("ts", "seq"), buckets: int = 64, keep: int = 2
) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink into a ``StateTable``: a batch rewrites the buckets it touches, and the newest versions stay."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table = StateTable(batch.sparkSession, path, schema, keys, order, buckets)
        if table.merge(batch, batch_id):
            table.expire(keep)

    return write


def state_snapshot_sink(path: str, schema, keys: Sequence[str] = ("repo",), order: Sequence[str] = ("ts", "seq")):
    """foreachBatch sink that merges writes into a versioned state snapshot.

    The version number is the batch id, so replaying a batch after a failure changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = [v for v in versions(spark, path) if v < batch_id]
        before = read_snapshot(spark, path, schema, known[-1] if known else None) if known else None
        newest = latest_state(batch, keys, order)
        if before is not None:
            # A write that arrives late must not replace a newer one.
            newest = latest_state(before.unionByName(newest.select(*before.columns)), keys, order)
        write_snapshot(newest, path, batch_id)

    return write
