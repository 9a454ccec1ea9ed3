"""Live results kept up to date by changes: inserts and retractions of a ``ChangeTable`` applied to grouped sums.

A view is a sum by some columns over the rows of a table: counts of files by status, of files by album. Its
stream reads the versions of the table as they are written. For every key of the table, a value state (in
RocksDB, so it doesn't have to fit in memory) holds what the key's row gives to the view now. A changed row
gives back what it gave before and gives anew; a row that no longer counts only gives back. The sums of a
micro-batch are added to the rows of the view that they touch, and only these are written. So work follows
the change, not the table, and after every micro-batch the view equals the query from nothing.

Batches are applied once: batch n of the stream is version n + 2 of the view (the first is the empty table),
and a batch whose version is there already, after a crash, isn't applied again. Rows older than what the
state has seen of a key are left out, so the order in which files arrive doesn't matter.

Cases: null view keys are keys like others; rows of a version that repeat a key count once, the last by
their columns; sums of 0 leave the view; an empty table gives an empty view.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.store import ChangeTable
from corvane.runtime import ship_package
from corvane.streaming.jobs import trigger

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_GIVES = "grp string, amount long, version long"


class Gives(StatefulProcessor):
    """What every key of a table gives to a view; tells the differences."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", _GIVES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for part in rows:
            for row in zip(part["version"], part["grp"], part["amount"], part["tie"]):
                if newest is None or (row[0], row[3]) > (newest[0], newest[3]):
                    newest = row
        version, grp, amount = int(newest[0]), newest[1], int(newest[2])
        had = self.now.get()
        if had is not None and had[2] >= version:
            return
        self.now.update((grp, amount, version))
        out = [] if had is None else [(had[0], -had[1])]
        if had is not None and had[0] == grp and had[1] == amount:
            return
        out.append((grp, amount))
        yield pd.DataFrame([o for o in out if o[1]], columns=["grp", "change"])

    def close(self) -> None:
        pass


class LiveSums:
    """Sums over a table by some columns of it, as a table of their own.

    by: the view's columns (name -> column of the table); counts: which rows count (null: not); amount: what
    a row adds, a whole number.
    """

    def __init__(self, spark: SparkSession, table: ChangeTable, path: str, schema: T.StructType, by: dict[str, Column], counts: Column | None = None, amount: Column | None = None):
        self.spark, self.table, self.path, self.schema, self.by = spark, table, path.rstrip("/"), schema, by
        self.counts = F.coalesce(counts, F.lit(False)) if counts is not None else F.lit(True)
        self.amount = amount if amount is not None else F.lit(1)
        self.sums = ChangeTable(spark, f"{self.path}/sums", ["grp"])
        if not self.sums.version():
            self.sums.write(spark.createDataFrame([], "grp string, total long"))

    def _changes(self) -> DataFrame:
        """The table's versions as a stream of (row, version, grp, amount, tie)."""
        read = self.spark.readStream.schema(T.StructType([*self.schema.fields, T.StructField("v", T.LongType())])).option("basePath", self.table.path)
        rows = read.parquet(f"{self.table.path}/v=*")
        grp = F.to_json(F.struct(*[c.alias(n) for n, c in self.by.items()]), {"ignoreNullFields": "false"})
        key = F.to_json(F.struct(*[F.col(k) for k in self.table.keys]), {"ignoreNullFields": "false"})
        tie = F.to_json(F.struct(*[F.col(c) for c in self.schema.names]))
        return rows.select(key.alias("row"), F.col("v").alias("version"), grp.alias("grp"), F.when(self.counts, self.amount).otherwise(0).cast("long").alias("amount"), tie.alias("tie"))

    def refresh(self, once: bool = True, interval: str = "1 minute"):
        """Start the stream: all there is and stop, or every interval."""
        ship_package(self.spark)
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        changes = self._changes().groupBy("row").transformWithStateInPandas(statefulProcessor=Gives(), outputStructType="grp string, change long", outputMode="Append", timeMode="None")
        return changes.writeStream.foreachBatch(self._apply).option("checkpointLocation", f"{self.path}/checkpoint").outputMode("append").trigger(**trigger(once, interval)).start()

    def _apply(self, changes: DataFrame, batch: int) -> None:
        if self.sums.version() >= batch + 2:  # applied before a crash; the state still has to be written
            changes.write.format("noop").mode("overwrite").save()
            return
        told = changes.groupBy("grp").agg(F.sum("change").alias("change"))
        now = self.sums.read().withColumnRenamed("grp", "_grp")
        self.sums.merge(told.join(now, F.col("grp") == F.col("_grp"), "left").select("grp", (F.coalesce("total", F.lit(0)) + F.col("change")).cast("long").alias("total")))

    def read(self) -> DataFrame:
        """The view's columns and ``total``."""
        kinds = {f.name: f.dataType for f in self.table.read().select(*[c.alias(n) for n, c in self.by.items()]).schema}
        parsed = F.from_json("grp", T.StructType([T.StructField(n, kinds[n]) for n in self.by]))
        return self.sums.read().where("total != 0").select(parsed.alias("g"), "total").select("g.*", "total")


def live_statuses(spark: SparkSession, files: ChangeTable, path: str, schema: T.StructType) -> LiveSums:
    """Live files by processing status."""
    return LiveSums(spark, files, path, schema, {"processing_status": F.col("processing_status")}, ~F.col("is_deleted"))


def live_album_files(spark: SparkSession, file_album: ChangeTable, path: str, schema: T.StructType) -> LiveSums:
    """Files by album: what the counts of albums and the album tree are made of."""
    return LiveSums(spark, file_album, path, schema, {"album_id": F.col("album_id")})


def album_counts(albums: DataFrame, files: LiveSums) -> DataFrame:
    """albums with file_count, from the view."""
    return albums.join(files.read().withColumnRenamed("total", "file_count"), "album_id", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0).cast("long")))
