"""Structured Streaming jobs: scans, the queue, and live results."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType, TimestampType

from corvane.operators.queue import MAX_RETRIES, drain, eligible
from corvane.operators.scan import refresh_permissions, sync_scan
from corvane.operators.store import SnapshotTable

SCAN_INTERVAL = "4 hours"
VALIDATION_INTERVAL = "24 hours"
SWEEP_THROTTLE_S = 600
CORPUS_TTL_S = 300
FIRST_WAIT_MS = 15_000


def trigger(once: bool, interval: str) -> dict:
    """Arguments of writeStream.trigger: all there is and stop, or every interval."""
    return {"availableNow": True} if once else {"processingTime": interval}


def new_uris(discovered: DataFrame) -> DataFrame:
    """A stream of discovered files, each URI once."""
    return discovered.dropDuplicates(["uri"])


def scan_stream(discovered: DataFrame, files: SnapshotTable, checkpoint: str, now_ms: Callable[[], int], once: bool = True, on_change: Callable[[DataFrame], None] | None = None):
    """Sync every micro-batch of discovered files into the index; a batch that is run again finds nothing to do.

    Only new and changed files are written (as one version of the table).
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        if df.isEmpty():
            return
        merged, touched = sync_scan(df, files.read(), now_ms())
        changed = touched.persist()
        if not changed.isEmpty():
            files.merge(merged.join(changed.select("file_id"), "file_id", "left_semi"), ["file_id"])
            if on_change is not None:
                on_change(changed)
        changed.unpersist()

    return discovered.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger(once, SCAN_INTERVAL)).start()


def queue_stream(ticks: DataFrame, queue: SnapshotTable, files: SnapshotTable, stages: dict[int, Callable], checkpoint: str, now_ms: Callable[[], int], once: bool = True):
    """Drain the queue once for every micro-batch of ticks; state is in the tables, so a restart goes on where it was.

    Files are written before the queue: after a crash in between, items run again on files that have their
    results already, which gives the same rows. Only items that were due, and their files, are written.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        now = now_ms()
        before = queue.read()
        due = eligible(before, now).select("queue_id", "file_id").persist()
        if not due.isEmpty():
            items, rows = drain(before, files.read(), stages, now)
            files.merge(rows.join(due.select("file_id").distinct(), "file_id", "left_semi"), ["file_id"])
            queue.merge(items.join(due.select("queue_id"), "queue_id", "left_semi"), ["queue_id"])
        due.unpersist()

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger(once, "1 minute")).start()


def validation_stream(ticks: DataFrame, folders: SnapshotTable, granted: Callable[[], DataFrame], checkpoint: str, now_ms: Callable[[], int], once: bool = True):
    """Check the permissions of all folders once for every micro-batch of ticks, every day."""

    def batch(df: DataFrame, batch_id: int) -> None:
        folders.merge(refresh_permissions(folders.read(), granted(), now_ms()), ["folder_uri"])

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger(once, VALIDATION_INTERVAL)).start()


ITEM_STATE = "status string, retry_count int, next_eligible_at long, seq long"
ITEM_ROWS = "queue_id long, seq long, status string, retry_count int, next_eligible_at long"


def item_states(events: DataFrame, watermark: str = "0 seconds") -> DataFrame:
    """The queue as keyed state: (queue_id, seq, status, retry_count, next_eligible_at) after every change of an item.

    events: a stream (queue_id, kind, at timestamp) of kinds RESET, START, DONE and FAIL. A failed item with
    retries left waits in its state; when event time passes its next time, it is PENDING again. Rows of
    an item are numbered by seq. State is one row an item, in the checkpoint.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        status, retries, until, seq = state.get if state.exists else ("PENDING", 0, 0, 0)
        out = []
        if state.hasTimedOut:
            status, seq = "PENDING", seq + 1
            out.append((key[0], seq, status, retries, until))
        else:
            rows = pd.concat(list(frames)).sort_values(["at", "kind"])
            for kind, at in zip(rows["kind"], rows["at"]):
                if kind == "RESET":
                    status, retries, until = "PENDING", 0, 0
                elif kind == "FAIL":
                    status, until, retries = "FAILED", int(at.value // 1_000_000) + (FIRST_WAIT_MS << min(retries, 4)), retries + 1
                else:
                    status = "IN_PROGRESS" if kind == "START" else "DONE"
                seq += 1
            out.append((key[0], seq, status, retries, until))
        state.update((status, retries, until, seq))
        if status == "FAILED" and retries < MAX_RETRIES:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["queue_id", "seq", "status", "retry_count", "next_eligible_at"])

    timed = events.withWatermark("at", watermark).groupBy("queue_id")
    return timed.applyInPandasWithState(step, ITEM_ROWS, ITEM_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def live_counts(stream: DataFrame, key: str, name: str, checkpoint: str):
    """Counts by key, given anew as a whole after every change."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def spells(requests: DataFrame, key: str, at: str, order: str, seconds: float) -> DataFrame:
    """requests with ``since`` (the request of the same key that was let through last, at or before this one) and ``ready`` (whether it is this one).

    A request is let through if none of its key was in so many seconds before: what a throttle does with
    calls, and a cache with a time to live with reads (``since`` is then when the value was made). at: a
    timestamp; equal times are ordered by ``order``; a request without a time is never ready. The requests of
    a key are read in order, one after the other, as each depends on the one before; a task holds a batch.
    """
    columns, step, schema = requests.columns, int(seconds * 1_000_000), StructType([*requests.schema.fields, StructField("since", TimestampType()), StructField("ready", BooleanType())])
    micros = requests.withColumns({"_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "_none": F.col(key).isNull(), "_at": F.unix_micros(F.col(at).cast("timestamp"))})

    def run(batches):
        last_key, last = None, None
        for batch in batches:
            keys, times, since, ready = list(zip(batch.column("_key").to_pylist(), batch.column("_none").to_pylist())), batch.column("_at").to_pylist(), [], []
            for k, t in zip(keys, times):
                if k != last_key:
                    last_key, last = k, None
                through = t is not None and (last is None or t - last >= step)
                last = t if through else last
                since.append(last if t is not None else None)
                ready.append(through)
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(since, pa.timestamp("us", tz="UTC")), pa.array(ready, pa.bool_())], [*columns, "since", "ready"])

    return micros.repartition("_key", "_none").sortWithinPartitions("_key", "_none", "_at", order).mapInArrow(run, schema)


class Throttle:
    """Lets a call through at most once in so many seconds."""

    def __init__(self, seconds: float = SWEEP_THROTTLE_S, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.last = seconds, clock, None

    def ready(self) -> bool:
        now = self.clock()
        if self.last is not None and now - self.last < self.seconds:
            return False
        self.last = now
        return True


class CachedFrame:
    """A DataFrame that is made anew when it is older than its time to live."""

    def __init__(self, make: Callable[[], DataFrame], seconds: float = CORPUS_TTL_S, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock = make, seconds, clock
        self.frame: DataFrame | None = None
        self.made = 0.0

    def get(self) -> DataFrame:
        if self.frame is None or self.clock() - self.made >= self.seconds:
            if self.frame is not None:
                self.frame.unpersist()
            self.frame, self.made = self.make().persist(), self.clock()
        return self.frame


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
