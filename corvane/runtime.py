"""Session helpers: shared working tables, package shipping, batch sizes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    Clusters name it in ``spark.checkpoint.dir``. Only where that is unset (tests, local runs) a
    temporary folder of this machine takes its place.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("corvane.local.shared", None)
        if not root:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="corvane-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            root = f"file://{folder}"
            spark.conf.set("corvane.local.shared", root)
    return root.rstrip("/")


class Workspace:
    """Working tables of one operator call: Parquet in the shared folder.

    Writing a table and reading it back cuts lineage, so a lost executor costs at most the stage it
    was running, and tables that have been consumed can be dropped to give their space back.
    """

    _opened: list[Workspace] | None = None  # those made within a scope

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        if Workspace._opened is not None:
            Workspace._opened.append(self)

    @classmethod
    @contextmanager
    def scope(cls):
        """Workspaces made inside are deleted at the end, with all their tables."""
        before, cls._opened = cls._opened, []
        try:
            yield
            for work in cls._opened:
                work.drop("")
        finally:
            cls._opened = before

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        schema = df.schema
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.read(name, schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers (once per context)."""
    context = spark.sparkContext
    if getattr(context, "_corvane_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="corvane-pkg-")) / "corvane_pkg.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(_PACKAGE.rglob("*.py")):
            archive.write(file, Path(_PACKAGE.name) / file.relative_to(_PACKAGE))
    context.addPyFile(str(target))
    context._corvane_shipped = True


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch: documents can be long, so the default of 10,000 is too many."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by its folder."""
    return spread(spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame, least: int = 4 << 20, most: int = 256 << 20) -> DataFrame:
    """Rows of a single file of a few megabytes dealt to all cores, because a file with one row group would be one task.

    Larger inputs, and those of several files, are read as they are.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = df.sparkSession.sparkContext.defaultParallelism
    if least <= size <= most and cores > 1 and len(df.inputFiles()) == 1:
        return df.repartition(cores)
    return df
