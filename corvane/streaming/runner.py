"""The queue as one stream: events come in, items wait and run, results come back as events.

Items whose ids are neighbours, 256 at most, share a value state (in RocksDB) with the status, the retries and
the next time of each: a call of Python and its round trips to the state store take milliseconds. Ids far apart
have a state each. A failed item with retries left waits for a timer; the state registers one for the first of
its items. What turns PENDING, by an event or by its timer, is due: the micro-batch runs all due items as one
set and writes their results to a folder that the stream reads as well, so a result is an event of the next
micro-batch. Time is event time: rows of kind TICK carry the clock.

A micro-batch that is run again after a crash finds its results written (they are renamed into place as a
whole) and runs nothing twice; the table of states is written by batch, over what a crash left.

Kinds: ENQUEUE and RESET (PENDING, no retries), START, DONE, FAIL; others, TICK among them, change nothing.
Events of an item are taken in the order of their times, then kinds; a null id has no state. Finished items
leave the state with their last row.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.queue import MAX_RETRIES
from corvane.operators.store import SnapshotTable
from corvane.runtime import ship_package
from corvane.streaming.jobs import FIRST_WAIT_MS, trigger
from corvane.streaming.views import ROCKSDB

EVENTS = "queue_id long, file_id long, kind string, at timestamp"
ROWS = "queue_id long, file_id long, seq long, status string, retry_count int, next_eligible_at long, due boolean"
LATENESS = "1 second"
SHARED_BITS = 8  # of ids, whose items share a state
_ITEMS = "items string, timer long"  # JSON: a list [queue_id, file_id, seq, status, retries, until, wake] an item; the earliest timer that is registered


class Items(StatefulProcessor):
    """The items of neighbouring ids."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("items", _ITEMS)

    def _read(self) -> tuple[dict[int, list], int | None]:
        text, timer = self.kept.get() or ("[]", None)
        return {x[0]: x[1:] for x in json.loads(text)}, timer

    def _write(self, items: dict[int, list], timer: int | None) -> None:
        first = min((x[5] for x in items.values() if x[5] is not None), default=None)
        if first is not None and (timer is None or first < timer):
            self.handle.registerTimer(first)
            timer = first
        if items:
            self.kept.update((json.dumps([[item, *x] for item, x in items.items()]), timer))
        else:
            self.kept.clear()

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        columns = dict(zip(["queue_id", "file_id", "seq", "status", "retry_count", "next_eligible_at", "due"], zip(*rows)))
        return pd.DataFrame(columns | {"file_id": pd.Series(columns["file_id"], dtype=object)})  # else floats beside nulls

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "kind"])
        if not key[0]:
            return
        items, timer = self._read()
        now, touched = timerValues.getCurrentWatermarkInMs(), {}
        for item, kind, at, own in zip(map(int, events["item"]), events["kind"], events["at"], events["file"]):
            file_id, seq, status, retries, until, wake = items.get(item, (None, 0, None, 0, 0, None))
            file_id, due = int(own) if own else file_id, touched.get(item, False)
            if kind in ("ENQUEUE", "RESET"):
                status, retries, until, wake, due = "PENDING", 0, 0, None, True
            elif kind == "START":
                status, wake, due = "IN_PROGRESS", None, False
            elif kind == "DONE":
                status, wake, due = "DONE", None, False
            elif kind == "FAIL":
                status, due = "FAILED", False
                until, retries = int(at.value // 1_000_000) + (FIRST_WAIT_MS << min(retries, 4)), retries + 1
                wake = max(until, now + 1) if retries < MAX_RETRIES else None
            else:
                seq -= 1
            items[item], touched[item] = [file_id, seq + 1, status, retries, until, wake], due
        said = [(item, *items[item][:5], due) for item, due in touched.items() if items[item][2] is not None]
        for item in touched:
            if items[item][2] in (None, "DONE"):
                del items[item]
        if said:
            self._write(items, timer)
            yield self._rows(said)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        items, timer = self._read()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        said = []
        for item, (file_id, seq, _, retries, until, wake) in items.items():
            if wake is not None and wake <= now:
                items[item] = [file_id, seq + 1, "PENDING", retries, until, None]
                said.append((item, *items[item][:5], True))
        if timer is not None and timer <= now:
            self._write(items, None)
        if said:
            yield self._rows(said)

    def close(self) -> None:
        pass


class QueueRunner:
    """Runs the items of a stream of events; folder holds results, states and the checkpoint, and all executors share it."""

    def __init__(self, spark: SparkSession, folder: str, run: Callable[[DataFrame], DataFrame], clock: Callable[[], float] = time.time):
        """run: due items (queue_id, file_id, retry_count) -> (queue_id, ok). clock: seconds, as the ticks of the stream tell them."""
        self.spark, self.folder, self.run, self.clock = spark, folder.rstrip("/"), run, clock
        self.results = SnapshotTable(spark, f"{self.folder}/results")
        if not self.results.version():
            self.results.write(spark.createDataFrame([], EVENTS))

    def start(self, events: DataFrame, once: bool = True, interval: str = "10 seconds"):
        """events: a stream of EVENTS."""
        ship_package(self.spark)
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        if once:  # stores of a stream that has ended stay open, with 4 MB of disk a partition at least, until maintenance
            self.spark.conf.set("spark.sql.streaming.stateStore.maintenanceInterval", "5s")
        back = self.spark.readStream.schema(EVENTS).parquet(f"{self.results.path}/v=*")
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))  # noqa: E731  # pandas would make floats of whole numbers beside nulls
        every = events.select("queue_id", "file_id", "kind", "at").unionByName(back).withColumn("items", F.shiftright("queue_id", SHARED_BITS))
        every = every.select(text("items").alias("items"), text("queue_id").alias("item"), text("file_id").alias("file"), "kind", "at")
        states = every.withWatermark("at", LATENESS).groupBy("items").transformWithStateInPandas(statefulProcessor=Items(), outputStructType=ROWS, outputMode="Append", timeMode="EventTime")
        return states.writeStream.foreachBatch(self._batch).option("checkpointLocation", f"{self.folder}/checkpoint").outputMode("append").trigger(**trigger(once, interval)).start()

    def _batch(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/states/batch={batch}")
        if self.results.version() >= batch + 2:  # run before a crash
            return
        written = self.spark.read.schema(ROWS).parquet(f"{self.folder}/states/batch={batch}")
        due = written.where("due").select("queue_id", "file_id", "retry_count")
        now = F.lit(self.clock()).cast("timestamp")
        said = self.run(due).select("queue_id", F.lit(None).cast("long").alias("file_id"), F.when(F.col("ok"), "DONE").otherwise("FAIL").alias("kind"), now.alias("at"))
        self.results.write(said)

    def states(self) -> DataFrame:
        """The newest row of every item."""
        rows = self.spark.read.schema(f"{ROWS}, batch int").option("basePath", f"{self.folder}/states").parquet(f"{self.folder}/states/batch=*")
        newest = F.max_by(F.struct("file_id", "status", "retry_count", "next_eligible_at"), F.struct("batch", "seq"))
        return rows.groupBy("queue_id").agg(newest.alias("x")).select("queue_id", "x.*")
