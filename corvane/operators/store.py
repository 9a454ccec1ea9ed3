"""Snapshot tables: merges, inserts, updates and deletes as new versions.

There is no table format with row-level changes here, so a change is a new snapshot: untouched rows (an
anti-join on the key) and changed rows. ``SnapshotTable`` writes one version a change under another name
and renames it; readers see a whole version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.runtime import Workspace
from corvane.schema import KEYS


def upsert(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace base rows of the same key, or are added; of several rows with one key the last column order decides."""
    one = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in rows.columns if c not in keys] or [F.lit(1)])
    new = rows.withColumn("_rank", F.row_number().over(one)).where("_rank = 1").drop("_rank")
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_assignment(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Assignments by (file, album): confidence and source are new, the time of a known assignment stays."""
    keys = KEYS["file_album"]
    both = base.alias("o").join(rows.alias("n"), keys, "full")
    return both.select(*keys, *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("confidence", "assigned_by")], F.coalesce("o.assigned_at", "n.assigned_at").alias("assigned_at"))


def append(base: DataFrame, rows: DataFrame, id: str, order: list[str]) -> DataFrame:
    """Rows are added with the next ids, in the given order."""
    new = numbered(rows, base, id, order)
    return base.unionByName(new.select([c for c in new.columns if c in base.columns]), allowMissingColumns=True)


def append_new(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key base lacks are added (insert or ignore); the first of repeated keys."""
    return base.unionByName(rows.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def numbered(rows: DataFrame, base: DataFrame, id: str, order: list[str]) -> DataFrame:
    """Rows with ids after those of base, in the given order.

    Ranks are prefix sums over range partitions, so no single task gets all rows. The partitions are written
    before they are counted, so both readings see the same ones.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranged = Workspace(rows.sparkSession, "numbered").write(parts, "ranged")
    ranked = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    top = base.agg(F.coalesce(F.max(id), F.lit(0)).alias("_top"))
    return ranked.join(before, "_part").crossJoin(F.broadcast(top)).withColumn(id, F.col("_top") + F.col("_before") + F.col("_at")).drop("_part", "_at", "_n", "_before", "_top")


def update_where(base: DataFrame, condition: Column, **values) -> DataFrame:
    """Columns of the rows that fit get new values."""
    new = {c: F.when(condition, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(base.schema[c].dataType) for c, v in values.items()}
    return base.withColumns(new)


def mark_failed(files: DataFrame, failures: DataFrame) -> DataFrame:
    """Files after failures (file_id, error): FAILED, with the error."""
    return update_from(files, failures.select("file_id", F.col("error").alias("last_error")), ["file_id"], {"processing_status": "FAILED"})


def purge_model(embeddings: DataFrame, model_version: str) -> DataFrame:
    """Embeddings without those of one model version; rows without a version stay."""
    return embeddings.where(~F.col("model_version").eqNullSafe(F.lit(model_version)))


def update_from(base: DataFrame, changes: DataFrame, keys: list[str], extra: dict | None = None) -> DataFrame:
    """Columns of changes replace those of base rows with the same key; extra: values of further columns of these rows."""
    columns = [c for c in changes.columns if c not in keys]
    side = changes.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(side, keys, "left")
    new = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    new |= {c: F.when(F.col("_hit"), F.lit(v)).otherwise(F.col(c)) for c, v in (extra or {}).items()}
    return joined.withColumns(new).select(base.columns)


def delete_keys(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


#: What a delete does to other tables: (table, column, action).
CASCADES = {
    "files": [("file_album", "file_id", "delete"), ("file_tag", "file_id", "delete"), ("embeddings", "file_id", "delete"), ("queue", "file_id", "delete"), ("corrections", "file_id", "delete"), ("duplicate_members", "file_id", "delete"), ("suggestions", "file_id", "delete")],
    "albums": [("albums", "parent_album_id", "null"), ("file_album", "album_id", "delete"), ("suggestions", "suggested_album_id", "delete")],
    "tags": [("file_tag", "tag_id", "delete")],
    "duplicate_groups": [("duplicate_members", "group_id", "delete")],
}


def delete_cascade(tables: dict[str, DataFrame], name: str, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after rows of one are deleted by key."""
    key = KEYS[name][0]
    out = tables | {name: delete_keys(tables[name], gone, [key])}
    for other, column, action in CASCADES.get(name, []):
        if other in out:
            ids = gone.select(F.col(key).alias(column))
            if action == "delete":
                out[other] = out[other].join(ids, column, "left_anti").select(tables[other].columns)
            else:
                hit = ids.distinct().withColumn("_gone", F.lit(True))
                out[other] = out[other].join(hit, column, "left").withColumn(column, F.when(F.col("_gone"), None).otherwise(F.col(column))).select(tables[other].columns)
    return out


class SnapshotTable:
    """A table as versions ``v=<n>`` in a folder; the largest one counts.

    A version is written under another name and renamed when it is whole, so a reader or a rerun never sees
    a part, and of two writers of one version the second fails (where the file system renames at once).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        fs, folder = self._at(".")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()), default=0)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v={self.version()}")

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """A new version; its number."""
        n, part = self.version() + 1, f"writing-{uuid.uuid4().hex}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.path}/{part}")
        fs, source = self._at(part)
        _, target = self._at(f"v={n}")
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
            raise RuntimeError(f"version {n} of {self.path} was written by another")
        return n

    def merge(self, rows: DataFrame, keys: list[str]) -> int:
        """A new version in which rows replace those of the same key, or are added."""
        return self.write(upsert(self.read(), rows, keys))

    def keep(self, versions: int) -> None:
        """Delete all but the newest versions."""
        for old in range(1, self.version() - versions + 1):
            fs, path = self._at(f"v={old}")
            fs.delete(path, True)


def newest_rows(spark: SparkSession, base: str, parts: list[str], keys: list[str]) -> DataFrame:
    """Rows of a base whose key no part has, and the newest row of every key in the parts, which are in order."""
    rows, changes = spark.read.parquet(base), None
    for n, path in enumerate(parts):
        part = spark.read.parquet(path).withColumn("_version", F.lit(n))
        changes = part if changes is None else changes.unionByName(part, allowMissingColumns=True)
    if changes is None:
        return rows
    columns = [c for c in changes.columns if c != "_version"]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_version").alias("_row")).select("_row.*")
    told = changes.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return rows.join(told, same, "left_anti").unionByName(newest, allowMissingColumns=True)


class ChangeTable(SnapshotTable):
    """A table whose changes cost what they hold: versions are changed rows, and reading takes the newest row of each key.

    ``compact`` writes the whole table as one version and forgets those before, when there are many.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        super().__init__(spark, path)
        self.keys = keys

    def _whole(self) -> int:
        """The newest version that is a whole table; 0 without one."""
        fs, folder = self._at(".")
        if not fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return max((int(n[6:]) for n in names if n.startswith("whole-")), default=0)

    def read(self) -> DataFrame:
        """Rows of the newest whole version whose key no change has (an anti-join with the changed keys alone), and the newest change of every key.

        The base isn't grouped; where the changed keys are few enough to be sent to all tasks, which Spark
        decides by the size of their files, it isn't shuffled either.
        """
        first, last = max(self._whole(), 1), self.version()
        return newest_rows(self.spark, f"{self.path}/v={first}", [f"{self.path}/v={n}" for n in range(first + 1, last + 1)], self.keys)

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> int:
        """The whole table, as a new version."""
        n = super().write(df, partition_by)
        fs, mark = self._at(f"whole-{n}")
        fs.create(mark, True).close()
        return n

    def merge(self, rows: DataFrame, keys: list[str] | None = None) -> int:
        """Changed and new rows, as a new version."""
        return super().write(rows)

    def compact(self, most: int = 64) -> None:
        """Write the table anew if it has more than so many versions of changes."""
        if self.version() - self._whole() > most:
            last = self.write(self.read())
            for old in range(1, last):
                fs, path = self._at(f"v={old}")
                fs.delete(path, True)


class Conflict(RuntimeError):
    """Another transaction has changed a table that this one read."""


class TableGroup:
    """Several tables with one log: a commit changes any of them at once, or nothing.

    A commit writes the changed rows of each table to folders of their own, which nobody reads yet, and then
    one small state, ``log/<n>``: for every table its base and the changes on it, in order. Readers take the
    newest state, so they see all tables as of one commit; folders of a writer that died stay unread until
    ``sweep``. A writer whose number another one took looks what that one changed: if it is a table that its
    transaction has read or writes, the transaction runs again on the new state, else the commit
    is written under the next number.

    States are renamed into place as folders, which is one step where the file system renames at once;
    the winner is who finds their own mark inside.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, list[str]]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> int:
        fs, folder = self._at("log")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def state(self, version: int | None = None) -> dict:
        """Of a version (the newest): {"mark", "changed", "tables": {name: {"base", "parts"}}}."""
        n = self.version() if version is None else version
        if not n:
            return {"mark": "", "changed": [], "tables": {}}
        fs, path = self._at(f"log/{n}/state")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        table = (state or self.state())["tables"][name]
        return newest_rows(self.spark, f"{self.folder}/{table['base']}", [f"{self.folder}/{p}" for p in table["parts"]], self.keys[name])

    def _write(self, name: str, rows: DataFrame) -> str:
        part = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{part}")
        return part

    def _publish(self, n: int, state: dict) -> bool:
        """Whether the state became version n."""
        fs, ready = self._at(f"log/writing-{state['mark']}")
        _, target = self._at(f"log/{n}")
        if fs.exists(target):
            return False
        _, file = self._at(f"log/writing-{state['mark']}/state")
        out = fs.create(file, True)
        out.write(json.dumps(state).encode())
        out.close()
        fs.rename(ready, target)
        won = fs.exists(target) and self.state(n)["mark"] == state["mark"]
        if not won:
            for left in (f"log/writing-{state['mark']}", f"log/{n}/writing-{state['mark']}"):
                fs.delete(self._at(left)[1], True)
        return won

    def commit(self, changes: dict[str, DataFrame], whole: tuple[str, ...] = (), seen: int | None = None, reads: tuple[str, ...] = ()) -> int:
        """Write changed rows of some tables (of those in ``whole``, all rows) as one version; its number.

        seen: the version that the changes were made from; reads: the tables they depend on beside those changed.
        """
        seen = self.version() if seen is None else seen
        parts = {name: self._write(name, rows) for name, rows in changes.items()}
        mark, touched = uuid.uuid4().hex, {*changes, *reads}
        while True:
            n = self.version()
            for other in range(seen + 1, n + 1):
                if touched & {*self.state(other)["changed"]}:
                    raise Conflict(f"version {other} changed {sorted(touched & {*self.state(other)['changed']})}")
            tables = dict(self.state(n)["tables"]) if n else {}
            for name, part in parts.items():
                tables[name] = {"base": part, "parts": []} if name in whole or name not in tables else {"base": tables[name]["base"], "parts": [*tables[name]["parts"], part]}
            if self._publish(n + 1, {"mark": mark, "changed": sorted(changes), "tables": tables}):
                return n + 1

    def transaction(self, change: Callable[[Callable[[str], DataFrame]], dict[str, DataFrame]], tries: int = 5) -> int:
        """Commit what ``change`` makes of the tables (it gets a function that reads one); again from the new state if another was first."""
        for turn in range(tries):
            seen, used = self.version(), set()
            state = self.state(seen)

            def read(name: str, state=state, used=used) -> DataFrame:
                used.add(name)
                return self.read(name, state)

            try:
                return self.commit(change(read), seen=seen, reads=tuple(used))
            except Conflict:
                if turn == tries - 1:
                    raise
        raise AssertionError("unreachable")

    def compact(self, most: int = 64) -> None:
        """Write the tables with more than so many changes anew."""
        state, seen = self.state(), self.version()
        many = [n for n, t in state["tables"].items() if len(t["parts"]) > most]
        if many:
            self.commit({n: self.read(n, state) for n in many}, tuple(many), seen)

    def sweep(self, keep: int = 10) -> None:
        """Delete what no state of the newest ``keep`` names, and older states; no writer may be at work."""
        last = self.version()
        named = {p for n in range(max(1, last - keep + 1), last + 1) for t in self.state(n)["tables"].values() for p in (t["base"], *t["parts"])}
        for name in self.keys:
            fs, folder = self._at(name)
            for found in fs.listStatus(folder) if fs.exists(folder) else []:
                if f"{name}/{found.getPath().getName()}" not in named:
                    fs.delete(found.getPath(), True)
        fs, log = self._at("log")
        for found in fs.listStatus(log):
            if found.getPath().getName().startswith("writing-") or int(found.getPath().getName()) <= last - keep:
                fs.delete(found.getPath(), True)


class GroupedTable:
    """One table of a group, with the reads and writes of a ChangeTable, for operators and streams that know one table."""

    def __init__(self, group: TableGroup, name: str):
        self.group, self.name, self.keys = group, name, group.keys[name]

    def read(self) -> DataFrame:
        return self.group.read(self.name)

    def merge(self, rows: DataFrame, keys: list[str] | None = None) -> int:
        """Changed and new rows, as a commit of their own."""
        return self.group.commit({self.name: rows})

    def write(self, df: DataFrame) -> int:
        """The whole table, as a commit of its own."""
        return self.group.commit({self.name: df}, (self.name,))
