"""The processing queue: enqueue, dequeue, transitions and draining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.vector import backoff_ms
from corvane.operators.store import numbered, update_from

MAX_RETRIES = 3
LEVELS = {2: "CONTENT_DONE", 3: "CLASSIFIED", 4: "EMBEDDED"}


def eligible(queue: DataFrame, now_ms: int, reference_mode: bool = False) -> DataFrame:
    """Items that may run: pending ones, and failed ones whose wait is over (reference_mode: pending ones only)."""
    due = F.col("next_eligible_at") <= now_ms
    status = F.col("status") == "PENDING"
    if not reference_mode:
        status = status | ((F.col("status") == "FAILED") & (F.col("retry_count") < MAX_RETRIES))
    return queue.where(status & due)


def dequeue(queue: DataFrame, now_ms: int, n: int, reference_mode: bool = False) -> DataFrame:
    return eligible(queue, now_ms, reference_mode).orderBy(F.desc("priority"), "queue_id").limit(n)


def enqueue(queue: DataFrame, files: DataFrame, level: int, priority: int = 0) -> DataFrame:
    """Queue with items for files that have none pending or running; a file once."""
    busy = queue.where(F.col("status").isin("PENDING", "IN_PROGRESS")).select("file_id")
    fresh = files.select("file_id").distinct().join(busy, "file_id", "left_anti")
    rows = fresh.select("file_id", F.lit(level).cast("int").alias("target_level"), F.lit(priority).cast("int").alias("priority"), F.lit(0).cast("int").alias("retry_count"), F.lit(0).cast("long").alias("next_eligible_at"), F.lit("PENDING").alias("status"))
    return queue.unionByName(numbered(rows, queue, "queue_id", ["file_id"]), allowMissingColumns=True)


def transition(queue: DataFrame, results: DataFrame, now_ms: int) -> DataFrame:
    """Queue after (queue_id, result): DONE, IN_PROGRESS, PENDING, or FAILED with one more retry and a later time."""
    told = queue.join(results.select("queue_id", "result"), "queue_id", "left")
    failed = F.col("result") == "FAILED"
    new = {
        "status": F.coalesce("result", "status"),
        "next_eligible_at": F.when(failed, F.lit(now_ms) + backoff_ms(F.col("retry_count"))).when(F.col("result") == "PENDING", F.lit(0)).otherwise(F.col("next_eligible_at")).cast("long"),
        "retry_count": F.when(failed, F.col("retry_count") + 1).when(F.col("result") == "PENDING", F.lit(0)).otherwise(F.col("retry_count")).cast("int"),
    }
    return told.withColumns(new).select(queue.columns)


def batch_size(charging: bool, idle: bool, user: bool = False) -> int:
    return 50 if user else 20 if charging and idle else 5


def drain(queue: DataFrame, files: DataFrame, stages: dict[int, callable], now_ms: int, only_level: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Queue and files after all eligible items have run their levels 2, 3 and 4, as sets.

    stages: level -> function of the files due, giving (file_id, ok, and columns of files to update). An
    item goes on to the next level as long as it succeeds and its target isn't reached.
    """
    due = eligible(queue, now_ms).select("queue_id", "file_id", "target_level")
    alive = due.withColumn("ok", F.lit(True))
    for level in sorted(stages):
        if only_level is not None and level != only_level:
            continue
        now = files.join(alive.where(F.col("ok") & (F.col("target_level") >= level)).select("file_id").distinct(), "file_id", "left_semi")
        result = stages[level](now)
        change = result.where("ok").drop("ok").withColumn("processing_level", F.lit(level).cast("int"))
        files = update_from(files, change, ["file_id"], {"processing_status": LEVELS[level], "last_error": None})
        alive = alive.join(result.select("file_id", F.col("ok").alias("_ok")), "file_id", "left").withColumn("ok", F.col("ok") & F.coalesce("_ok", F.lit(True))).drop("_ok")
    results = alive.select("queue_id", F.when(F.col("ok"), "DONE").otherwise("FAILED").alias("result"))
    return transition(queue, results, now_ms), files


def purge(files: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """Files without those that were deleted longer than the grace period ago (by their last modification)."""
    return files.where(~(F.col("is_deleted") & (F.col("date_modified_source") < now_ms - grace_ms)))


def retry_left(count: Column) -> Column:
    return count < MAX_RETRIES
