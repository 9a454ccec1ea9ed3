"""Discovery of files: directory trees, media catalogs, and what they have in common."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import islice

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.runtime import Workspace, ship_package

MAX_BYTES = 512 * 1024 * 1024
ENTRIES = 10_000  # of a folder that are a batch
#: Fixed value: the folder that galleries keep small images in.
THUMBNAILS = ".thumbnails"
DISCOVERED = ["uri", "display_name", "mime_type", "size_bytes", "date_modified_source"]

# MIME types by file ending.
_MIME = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "txt": "text/plain", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}


def mime_of(name: Column) -> Column:
    ending = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in _MIME.items() for x in pair])[ending], F.lit("application/octet-stream"))


def list_folder(uri: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, whether it is a folder, bytes, milliseconds of its last change) of all that is in a folder; nothing if it has gone.

    Local folders are read entry by entry, those of other stores through pyarrow's file systems. Anything
    that is neither a file nor a folder, and links that lead nowhere, are left out. A folder that can't be
    read is an error: without it, its files would count as missing.
    """
    system, path = file_system(uri)
    if isinstance(system, LocalFileSystem):
        try:
            entries = os.scandir(path)
        except FileNotFoundError:
            return
        with entries:
            for entry in entries:
                try:
                    folder, told = entry.is_dir(), entry.stat()
                except FileNotFoundError:
                    continue
                if folder or entry.is_file():
                    yield os.fsencode(entry.name).decode("utf-8", "replace"), folder, 0 if folder else told.st_size, told.st_mtime_ns // 1_000_000
        return
    for told in system.get_file_info(FileSelector(path, allow_not_found=True)):
        if told.type in (FileType.Directory, FileType.File):
            yield told.base_name, told.type == FileType.Directory, told.size or 0, (told.mtime_ns or 0) // 1_000_000


def file_system(uri: str) -> tuple[FileSystem, str]:
    """pyarrow's file system of a URI, and the path in it; characters of the path stand for themselves."""
    scheme, host, path = re.fullmatch(r"(?:([a-z][a-z0-9+.-]*):)?(?://([^/]*))?(.*)", uri, re.S).groups()
    if scheme in (None, "file"):
        return LocalFileSystem(), path or "/"
    system, base = FileSystem.from_uri(f"{scheme}://{host or ''}/")
    return system, base.rstrip("/") + path


def _resolved(spark: SparkSession, uri: str) -> str:
    """A URI with its scheme, mount points of the cluster's own schemes resolved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri.rstrip("/") or "/")
    try:
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).resolvePath(path).toString()
    except Py4JJavaError:
        return uri.rstrip("/")


def walk_tree(spark: SparkSession, root: str, max_depth: int = 8, lister: Callable[[str], Iterable[tuple[str, bool, int, int]]] = list_folder) -> DataFrame:
    """All files below a folder: metadata only, with the depth of their folder (the root's is 0), at most max_depth.

    Folders whose name starts with a dot, and thumbnail folders, are never entered; files of any name are
    listed. Each round lists the folders of one depth, dealt to all tasks, and keeps what it finds in a
    working table; the next round's folders are rows of it. Nothing but the number of folders of a round
    comes to the driver. lister: how a folder is listed, for stores that list_folder doesn't know.
    """
    ship_package(spark)
    work, root, rounds = Workspace(spark, "walk"), _resolved(spark, root), []
    if root.rsplit("/", 1)[-1].startswith("."):
        max_depth = -1

    def run(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = iter(lister(folder))
                while entries := list(islice(found, ENTRIES)):
                    names, folders, sizes, times = zip(*entries)
                    uris = [f"{folder.rstrip('/')}/{name}" for name in names]
                    yield pa.RecordBatch.from_arrays([pa.array(uris), pa.array(names), pa.array(folders), pa.array(sizes, pa.int64()), pa.array(times, pa.int64())], ["uri", "name", "is_folder", "size_bytes", "changed"])

    schema = "uri string, name string, is_folder boolean, size_bytes long, changed long"
    folders, n, most = spark.createDataFrame([(root,)], "uri string"), 1, 4 * spark.sparkContext.defaultParallelism
    while n and len(rounds) <= max_depth:
        listed = folders.repartition(min(n, most), "uri").mapInArrow(run, schema)  # a stated number, so that few small rows aren't put into one task
        rounds.append(work.write(listed, f"depth-{len(rounds)}").withColumn("depth", F.lit(len(rounds))))
        shown = ~F.startswith("name", F.lit(".")) & (F.col("name") != THUMBNAILS)
        folders = rounds[-1].where(F.col("is_folder") & shown).select("uri")
        n = folders.count() if len(rounds) <= max_depth else 0
    found = reduce(DataFrame.unionByName, rounds) if rounds else spark.createDataFrame([], f"{schema}, depth int")
    return found.where(~F.col("is_folder")).select("uri", F.when(F.col("name") == "", "unnamed").otherwise(F.col("name")).alias("display_name"), mime_of(F.col("name")).alias("mime_type"), "size_bytes", F.col("changed").alias("date_modified_source"), "depth")


def media_catalog(media: DataFrame) -> DataFrame:
    """Catalog rows (media_id, source_ord, uri, ..., date_modified_s): the first of each URI, defaults for nulls, milliseconds."""
    first = Window.partitionBy("uri").orderBy("source_ord", "media_id")
    return (
        media.where(F.col("uri").isNotNull())
        .withColumn("rank", F.row_number().over(first))
        .where("rank = 1")
        .select("uri", F.coalesce("display_name", F.lit("unnamed")).alias("display_name"), F.coalesce("mime_type", F.lit("application/octet-stream")).alias("mime_type"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"), (F.coalesce("date_modified_s", F.lit(0)) * 1000).alias("date_modified_source"))
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """All discovered rows, repeated ones too."""
    out = sources[0].select(DISCOVERED)
    for s in sources[1:]:
        out = out.unionByName(s.select(DISCOVERED))
    return out


def size_capped(discovered: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    return discovered.where(F.col("size_bytes") <= most)


def accessible(folders: DataFrame, grants: DataFrame) -> DataFrame:
    """Folders with whether they are granted: (folder_uri, granted, display_name)."""
    name = F.element_at(F.split("folder_uri", "/"), -1)
    return folders.join(grants.select("folder_uri", F.lit(True).alias("g")).distinct(), "folder_uri", "left").select("folder_uri", F.coalesce("g", F.lit(False)).alias("granted"), name.alias("display_name"))


def subsample(width: Column, height: Column, most: int = 1024) -> Column:
    """Smallest power of two by which an image's longer side, divided in whole numbers, fits; null for an image without a side."""
    longer = F.greatest(width, height)
    power = F.pow(F.lit(2), F.ceil(F.log2((longer + 1) / (most + 1))))
    return F.when((width > 0) & (height > 0), F.when(longer <= most, 1).otherwise(power)).cast("int")


def read_images(spark: SparkSession, root: str, bounds, pixels, most: int = 1024) -> DataFrame:
    """(uri, width, height, sample, rgb) of the images below a folder.

    bounds: content -> (width, height) or None; pixels: (content, sample) -> list of (r, g, b) or None. They
    are the seam for an image library, and run on executors over one Arrow batch of contents at a time.
    """
    ship_package(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")

    def measure(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bounds(bytes(c)) or (None, None) for c in contents], columns=["width", "height"])

    def decode(contents: pd.Series, samples: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or s != s else pixels(bytes(c), int(s)) for c, s in zip(contents, samples)])

    sized = found.withColumn("b", F.pandas_udf(measure, "width int, height int")("content")).select("path", "content", "b.width", "b.height")
    sampled = sized.withColumn("sample", subsample(F.col("width"), F.col("height"), most))
    return sampled.select(F.col("path").alias("uri"), "width", "height", "sample", F.pandas_udf(decode, "array<struct<r:int,g:int,b:int>>")("content", "sample").alias("rgb"))
