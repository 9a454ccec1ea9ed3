"""The queue as a stream: waits, retries, and a kill in between."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from corvane.streaming.runner import EVENTS, QueueRunner

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_items_wait_and_run_until_done(spark, tmp_path):
    now, ran = [0.0], []

    def run(due):
        ran.append(sorted((r["queue_id"], r["retry_count"]) for r in due.collect()))
        return due.select("queue_id", (F.col("retry_count") >= F.col("queue_id") % 5).alias("ok"))

    runner = QueueRunner(spark, str(tmp_path / "q"), run, lambda: START.timestamp() + now[0])
    inbox = tmp_path / "in"

    def send(rows, seconds):
        now[0] = seconds
        at = START + timedelta(seconds=seconds)
        spark.createDataFrame([(*r, at) for r in rows] + [(None, None, "TICK", at)], EVENTS).coalesce(1).write.mode("append").parquet(str(inbox))

    def go(runner=runner):
        runner.start(spark.readStream.schema(EVENTS).parquet(str(inbox))).awaitTermination()

    send([(i, 100 + i, "ENQUEUE") for i in range(5)], 0)
    go()  # runs all
    assert ran[-1] == [] or [x for r in ran for x in r] == [(i, 0) for i in range(5)]
    send([], 5)
    go()  # takes the results
    states = {r["queue_id"]: (r["status"], r["retry_count"]) for r in runner.states().collect()}
    assert states == {0: ("DONE", 0), **{i: ("FAILED", 1) for i in range(1, 5)}}
    send([], 12)
    go()  # too early
    assert sum(map(len, ran)) == 5
    killed = []

    class Dying(QueueRunner):
        def _batch(self, rows, batch):
            super()._batch(rows, batch)
            if not killed:
                killed.append(batch)
                raise RuntimeError("killed")

    send([], 40)
    with pytest.raises(Exception):
        go(Dying(spark, str(tmp_path / "q"), run, lambda: START.timestamp() + now[0]))
    assert killed
    for seconds in (45, 90, 95, 200, 205, 400, 405):
        send([(3, None, "RESET")] if seconds == 400 else [], seconds)
        go()
    states = {r["queue_id"]: (r["file_id"], r["status"], r["retry_count"]) for r in runner.states().collect()}
    assert states == {0: (100, "DONE", 0), 1: (101, "DONE", 1), 2: (102, "DONE", 2), 3: (103, "FAILED", 1), 4: (104, "FAILED", 3)}
    attempts = sorted(x for r in ran for x in r)
    assert attempts == sorted([(i, k) for i in range(5) for k in range(min(i, 2) + 1)] + [(3, 0)])


def test_neighbours_share_a_state_and_wait_alone(spark, tmp_path):
    """A state an item took milliseconds of each: a query over a GB didn't end."""
    now, ran = [0.0], []

    def run(due):
        ran[-1].extend((r["queue_id"], r["retry_count"]) for r in due.collect())
        return due.select("queue_id", (F.col("retry_count") > 0).alias("ok"))

    runner, inbox = QueueRunner(spark, str(tmp_path / "q"), run, lambda: START.timestamp() + now[0]), tmp_path / "in"
    early, late = [*range(-300, 2500, 2), 2**62], [*range(-299, 2500, 2), 2**62 + 1]  # beyond what floats hold
    file = lambda i: None if i % 3 == 0 else i + 1

    def go(seconds, ids=()):
        now[0] = seconds
        at = START + timedelta(seconds=seconds)
        spark.createDataFrame([(i, file(i), "ENQUEUE", at) for i in ids] + [(None, None, "TICK", at)], EVENTS).coalesce(1).write.mode("append").parquet(str(inbox))
        ran.append([])
        query = runner.start(spark.readStream.schema(EVENTS).parquet(str(inbox)))
        query.awaitTermination()
        return query.lastProgress.stateOperators[0].numRowsTotal

    assert go(0, early) < 20
    assert go(5, late) < 20
    go(10)  # takes the results of the second half
    go(18)  # the first half has waited
    go(23)  # the second half too
    states = go(28)
    assert [sorted(r) for r in ran] == [sorted((i, k) for i in ids) for ids, k in ((early, 0), (late, 0), ([], 0), (early, 1), (late, 1), ([], 0))]
    assert states == 0
    assert sorted(runner.states().select("queue_id", "file_id", "status", "retry_count").collect()) == [(i, file(i), "DONE", 1) for i in sorted(early + late)]


def test_a_wait_that_ends_before_a_neighbours(spark, tmp_path):
    now, ran = [0.0], []

    def run(due):
        ran[-1].extend((r["queue_id"], r["retry_count"]) for r in due.collect())
        return due.select("queue_id", F.lit(False).alias("ok"))

    runner, inbox = QueueRunner(spark, str(tmp_path / "q"), run, lambda: START.timestamp() + now[0]), tmp_path / "in"
    for seconds, item in ((0, 1), (5, None), (18, None), (20, None), (22, 2), (24, None), (40, None), (52, None)):
        now[0], at = seconds, START + timedelta(seconds=seconds)
        spark.createDataFrame([(item, None, "ENQUEUE", at)] * bool(item) + [(None, None, "TICK", at)], EVENTS).coalesce(1).write.mode("append").parquet(str(inbox))
        ran.append([])
        runner.start(spark.readStream.schema(EVENTS).parquet(str(inbox))).awaitTermination()
    assert ran == [[(1, 0)], [], [(1, 1)], [], [(2, 0)], [], [(2, 1)], [(1, 2)]]
