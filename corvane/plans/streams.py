"""Registered streaming queries: each runs its stream over all there is, and returns what a reader finds then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.fixtures import Index
from corvane.operators.store import ChangeTable, SnapshotTable
from corvane.plans.registry import NOW, query
from corvane.runtime import Workspace
from corvane.streaming import jobs as jb
from corvane.streaming import views as vw
from corvane.streaming.runner import EVENTS, QueueRunner


def _streamed(ix: Index, rows: DataFrame, work: Workspace, name: str, files: int = 1) -> DataFrame:
    """Rows as a stream of a few files, one micro-batch each."""
    rows.repartition(files).write.parquet(work.path(name))
    return ix.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(work.path(name))


@query("str01_live_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _live(ix: Index) -> DataFrame:
    """Counts that are given anew after every change: the last ones are those of all rows."""
    work, name = Workspace(ix.spark, "live"), f"live_{uuid.uuid4().hex}"
    jb.live_counts(_streamed(ix, ix.events, work, "in", 3), "event_type", name, work.path("checkpoint")).awaitTermination()
    return work.write(ix.spark.table(name), "out")


def _changed(ix: Index, work: Workspace, name: str, table: DataFrame, keys: list[str], view, changes: list[DataFrame]):
    """A view of a table that is refreshed after its first version and after every change."""
    stored = ChangeTable(ix.spark, work.path(name), keys)
    stored.write(table)
    live = view(ix.spark, stored, work.path(f"{name}-view"), stored.read().schema)
    for rows in [None, *changes]:
        if rows is not None:
            stored.merge(rows)
        live.refresh().awaitTermination()
    return live


@query(
    "str01_live_statuses",
    """SELECT CASE WHEN file_id % 5 = 0 THEN 'INDEXED' ELSE processing_status END AS processing_status, count(*) AS total FROM (
         SELECT file_id, processing_status, is_deleted OR file_id % 10 = 5 AS is_deleted FROM files UNION ALL SELECT file_id + 1000000, processing_status, is_deleted FROM files WHERE file_id % 4 = 1) t WHERE NOT is_deleted GROUP BY 1""",
    "files",
)
def _live_statuses(ix: Index) -> DataFrame:
    """Live files by status, kept up to date while some are added, change their status or are deleted."""
    files = ix.files.select("file_id", "processing_status", "is_deleted")
    added = files.where("file_id % 4 = 1").withColumn("file_id", F.col("file_id") + 1000000)
    fifth = files.unionByName(added).where("file_id % 5 = 0").withColumn("processing_status", F.lit("INDEXED"))
    gone = fifth.where("file_id % 10 = 5 and file_id < 1000000").withColumn("is_deleted", F.lit(True))
    return _changed(ix, Workspace(ix.spark, "statuses"), "files", files, ["file_id"], vw.live_statuses, [added, fifth, gone]).read()


@query(
    "str01_live_albums",
    """WITH l AS (SELECT DISTINCT file_id, CASE WHEN file_id % 3 = 0 THEN 101 ELSE album_id END AS album_id FROM file_album UNION SELECT file_id, album_id FROM file_album)
       SELECT a.album_id, a.name, (SELECT count(*) FROM l WHERE l.album_id = a.album_id) AS file_count FROM albums a""",
    "albums file_album",
)
def _live_albums(ix: Index) -> DataFrame:
    """Albums with the number of their files, kept up to date while files are put into another album too, and again into their own."""
    links = ix.file_album.select("file_id", "album_id", "confidence")
    more = links.where("file_id % 3 = 0").withColumn("album_id", F.lit(101).cast("long"))
    live = _changed(ix, Workspace(ix.spark, "links"), "links", links, ["file_id", "album_id"], vw.live_album_files, [more, links.where("file_id % 2 = 0").withColumn("confidence", F.lit(1.0))])
    return vw.album_counts(ix.albums, live).select("album_id", "name", "file_count")


@query(
    "str02_scan",
    """SELECT uri, display_name, CASE WHEN file_id % 11 <> 0 AND file_id % 10 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, processing_status FROM files
       UNION ALL SELECT uri || '/new', 'new_' || display_name, size_bytes, 'DISCOVERED' FROM files WHERE file_id % 13 = 0""",
    "files",
)
def _scan(ix: Index) -> DataFrame:
    """A scan in two micro-batches, and a second one that finds nothing new."""
    work = Workspace(ix.spark, "scan")
    files = ChangeTable(ix.spark, work.path("files"), ["file_id"])
    files.write(ix.files)
    for again, parts in (("first", 2), ("second", 1)):
        jb.scan_stream(_streamed(ix, ix.discovered, work, again, parts), files, work.path(f"checkpoint-{again}"), lambda: NOW).awaitTermination()
    return files.read().select("uri", "display_name", "size_bytes", "processing_status")


@query("str03_validation", f"SELECT folder_uri, CASE WHEN folder_uri LIKE '%A' THEN 'ACTIVE' ELSE 'NEEDS_REGRANT' END AS permission_state, {NOW} AS last_validated_at FROM folders", "folders")
def _validation(ix: Index) -> DataFrame:
    work = Workspace(ix.spark, "validation")
    folders = SnapshotTable(ix.spark, work.path("folders"))
    folders.write(ix.folders)
    ticks = _streamed(ix, ix.spark.range(1), work, "ticks")
    jb.validation_stream(ticks, folders, lambda: ix.folders.where("folder_uri LIKE '%A'"), work.path("checkpoint"), lambda: NOW).awaitTermination()
    return folders.read().select("folder_uri", "permission_state", "last_validated_at")


@query("str04_queue_runner", "SELECT file_id + 7 AS queue_id, file_id, CASE WHEN (file_id + 7) % 5 < 3 THEN 'DONE' ELSE 'FAILED' END AS status, CAST(least((file_id + 7) % 5, 3) AS INT) AS retry_count FROM files", "files")
def _ran(ix: Index) -> DataFrame:
    """An item for every file, which fails as often as its number says: it waits and runs again until it is done, or has no retries left."""
    work, start, now = Workspace(ix.spark, "runner"), NOW // 1000, [0]
    runner = QueueRunner(ix.spark, work.path("queue"), lambda due: due.select("queue_id", (F.col("retry_count") >= F.col("queue_id") % 5).alias("ok")), lambda: start + now[0])
    stamped = lambda rows: rows.withColumn("at", F.timestamp_seconds(F.lit(start + now[0])))
    tick = ix.spark.range(1).select(F.lit(None).cast("long").alias("queue_id"), F.lit(None).cast("long").alias("file_id"), F.lit("TICK").alias("kind"))
    items = ix.files.select((F.col("file_id") + 7).alias("queue_id"), "file_id", F.lit("ENQUEUE").alias("kind"))
    for seconds in (0, 5, 40, 45, 90, 95):
        now[0] = seconds
        stamped(tick if seconds else items.unionByName(tick)).write.mode("append").parquet(work.path("in"))
        runner.start(ix.spark.readStream.schema(EVENTS).parquet(work.path("in"))).awaitTermination()
    return runner.states().select("queue_id", "file_id", "status", "retry_count")


_KIND = "CASE event_id % 7 WHEN 0 THEN 'RESET' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'FAIL' WHEN 3 THEN 'FAIL' WHEN 4 THEN 'START' ELSE 'DONE' END"


@query(
    "str04_item_states",
    f"""WITH e AS (SELECT event_id * 5 % 61 AS queue_id, {_KIND} AS kind, ts + to_milliseconds(event_id % 1000) AS ts, event_id FROM events WHERE event_id % 3 = 0),
         o AS (SELECT *, row_number() OVER (PARTITION BY queue_id ORDER BY ts, kind) AS seq, sum(CASE WHEN kind = 'RESET' THEN 1 ELSE 0 END) OVER (PARTITION BY queue_id ORDER BY ts, kind ROWS UNBOUNDED PRECEDING) AS era FROM e),
         r AS (SELECT *, sum(CASE WHEN kind = 'FAIL' THEN 1 ELSE 0 END) OVER (PARTITION BY queue_id, era ORDER BY seq ROWS UNBOUNDED PRECEDING) AS retries FROM o),
         l AS (SELECT queue_id, max_by(kind, seq) AS kind, max(seq) AS seq, max_by(retries, seq) AS retries, max_by(era, seq) AS era FROM r GROUP BY 1),
         u AS (SELECT l.queue_id, max_by(epoch_us(r.ts) // 1000 + 15000 * CAST(pow(2, least(r.retries - 1, 4)) AS BIGINT), r.seq) AS until FROM l JOIN r ON r.queue_id = l.queue_id AND r.era = l.era AND r.kind = 'FAIL' GROUP BY 1),
         f AS (SELECT l.*, coalesce(u.until, 0) AS until, l.kind = 'FAIL' AND l.retries < 3 AND u.until <= (SELECT max(epoch_us(ts) // 1000) FROM e) AS back FROM l LEFT JOIN u ON u.queue_id = l.queue_id)
       SELECT queue_id, CASE WHEN back THEN 'PENDING' ELSE CASE kind WHEN 'FAIL' THEN 'FAILED' WHEN 'RESET' THEN 'PENDING' WHEN 'START' THEN 'IN_PROGRESS' ELSE 'DONE' END END AS status, CAST(retries AS INT) AS retry_count, CAST(until AS BIGINT) AS next_eligible_at FROM f""",
)
def _items(ix: Index) -> DataFrame:
    """The newest state of every item, after its last event and after the waits that event time has passed."""
    work = Workspace(ix.spark, "items")
    kind = F.expr(_KIND)
    at = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")) + F.col("event_id") % 1000)
    rows = ix.events.where("event_id % 3 = 0").select((F.col("event_id") * 5 % 61).alias("queue_id"), kind.alias("kind"), at.alias("at"))
    states = jb.item_states(_streamed(ix, rows, work, "in"))
    run = states.writeStream.outputMode("append").format("parquet").option("path", work.path("out")).option("checkpointLocation", work.path("checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    last = ix.spark.read.parquet(work.path("out")).groupBy("queue_id").agg(F.max_by(F.struct("status", "retry_count", "next_eligible_at"), "seq").alias("x"))
    return last.select("queue_id", "x.*")


def _spells(seconds: int, key: str) -> str:
    """SQL of the requests of a key that are let through, one round a request, and the last one at or before each."""
    return f"""WITH RECURSIVE e AS (SELECT event_id, {key} AS k, epoch_us(ts) AS t FROM events),
         g(k, t) AS (SELECT k, min(t) FROM e GROUP BY 1 UNION ALL SELECT g.k, (SELECT min(e.t) FROM e WHERE e.k = g.k AND e.t >= g.t + {seconds}000000) AS n FROM g WHERE g.t IS NOT NULL),
         l AS (SELECT e.*, (SELECT max(g.t) FROM g WHERE g.k = e.k AND g.t <= e.t) AS since FROM e)"""


query("str05_cached_frame", f"{_spells(86400, 'user_id')} SELECT event_id, since AS made_at, since = t AS made FROM l")(
    lambda ix: jb.spells(ix.events, "user_id", "ts", "event_id", 86400).select("event_id", F.unix_micros(F.col("since")).alias("made_at"), F.col("ready").alias("made"))
)
query("str06_throttle", f"{_spells(21600, 'event_type')} SELECT event_id, since = t AS ready FROM l")(lambda ix: jb.spells(ix.events, "event_type", "ts", "event_id", 21600).select("event_id", "ready"))


@query(
    "str07_resume",
    f"""WITH d AS (SELECT *, (status = 'PENDING' OR (status = 'FAILED' AND retry_count < 3)) AND next_eligible_at <= {NOW} AS due FROM queue)
        SELECT queue_id, CASE WHEN due THEN 'DONE' ELSE status END AS status, retry_count FROM d""",
    "queue",
)
def _resumed(ix: Index) -> DataFrame:
    """A worker that dies in its first micro-batch, after files were written; the restarted one does the rest, and nothing twice."""
    work = Workspace(ix.spark, "resume")
    queue, files = ChangeTable(ix.spark, work.path("queue"), ["queue_id"]), ChangeTable(ix.spark, work.path("files"), ["file_id"])
    queue.write(ix.queue)
    files.write(ix.files)
    ok = lambda due: due.select("file_id", F.lit(True).alias("ok"))

    class Dying(ChangeTable):
        def merge(self, rows, keys=None):
            raise RuntimeError("killed")

    for table in (Dying(ix.spark, work.path("queue"), ["queue_id"]), queue, queue):
        ticks = ix.spark.range(1)
        stream = _streamed(ix, ticks, work, "ticks") if table is not queue else ix.spark.readStream.schema(ticks.schema).parquet(work.path("ticks"))
        run = jb.queue_stream(stream, table, files, {2: ok, 3: ok, 4: ok}, work.path("checkpoint"), lambda: NOW)
        try:
            run.awaitTermination()
        except Exception as error:
            if "killed" not in str(error):
                raise
    return queue.read().select("queue_id", "status", "retry_count")


@query("str08_new_uris", "SELECT DISTINCT url AS uri FROM pages")
def _fresh(ix: Index) -> DataFrame:
    """Each URI once, over four micro-batches in which every one comes twice."""
    work = Workspace(ix.spark, "fresh")
    stream = jb.new_uris(_streamed(ix, ix.media.select("uri"), work, "in", 4))
    stream.writeStream.format("parquet").option("path", work.path("out")).option("checkpointLocation", work.path("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return ix.spark.read.parquet(work.path("out"))
