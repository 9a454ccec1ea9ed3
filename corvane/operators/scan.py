"""Change detection between discovered files and the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import doc_type
from corvane.operators.store import numbered


def changes(discovered: DataFrame, files: DataFrame) -> DataFrame:
    """(uri, file_id, change_type): NEW, CHANGED (size or time differs), UNCHANGED or MISSING."""
    d = discovered.dropDuplicates(["uri"]).select("uri", F.col("size_bytes").alias("new_size"), F.col("date_modified_source").alias("new_time"))
    f = files.groupBy("uri").agg(F.min_by(F.struct("file_id", "size_bytes", "date_modified_source"), "file_id").alias("f"))
    both = d.join(f, "uri", "full")
    same = (F.col("new_size") == F.col("f.size_bytes")) & (F.col("new_time") == F.col("f.date_modified_source"))
    kind = F.when(F.col("f").isNull(), "NEW").when(F.col("new_time").isNull(), "MISSING").when(same, "UNCHANGED").otherwise("CHANGED")
    return both.select("uri", F.col("f.file_id").alias("file_id"), kind.alias("change_type"))


def sync_scan(discovered: DataFrame, files: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Files after a scan, and (file_id, change_type) of the new and changed ones.

    A known file's name, type, size and time are taken over and all else stays; a new one gets the next
    id in order of its URI.
    """
    found = discovered.dropDuplicates(["uri"])
    told = changes(found, files)
    fresh = found.join(told.where("change_type = 'NEW'").select("uri"), "uri", "left_semi")
    new = numbered(fresh, files, "file_id", ["uri"]).withColumns({"date_first_indexed": F.lit(now_ms).cast("long"), "doc_type": doc_type(F.col("mime_type")), "processing_status": F.lit("DISCOVERED"), "processing_level": F.lit(0), "is_deleted": F.lit(False)})
    side = found.select("uri", *[F.col(c).alias(f"_{c}") for c in ("display_name", "mime_type", "size_bytes", "date_modified_source")])
    kept = files.join(side, "uri", "left")
    for c in ("display_name", "mime_type", "size_bytes", "date_modified_source"):
        kept = kept.withColumn(c, F.coalesce(f"_{c}", c))
    merged = kept.select(files.columns).unionByName(new.select([c for c in new.columns if c in files.columns]), allowMissingColumns=True)
    touched = new.select("file_id", F.lit("NEW").alias("change_type")).unionByName(told.where("change_type = 'CHANGED'").select("file_id", "change_type"))
    return merged, touched


def mark_missing(files: DataFrame, discovered: DataFrame) -> DataFrame:
    """Files whose URI isn't there any more are marked as deleted; an empty scan marks none."""
    if discovered.isEmpty():
        return files
    present = discovered.select("uri").distinct().withColumn("_there", F.lit(True))
    return files.join(present, "uri", "left").withColumn("is_deleted", F.col("is_deleted") | F.col("_there").isNull()).select(files.columns)


def restore_present(files: DataFrame, discovered: DataFrame) -> DataFrame:
    """Deleted files whose URI is there again come back."""
    present = discovered.select("uri").distinct().withColumn("_there", F.lit(True))
    return files.join(present, "uri", "left").withColumn("is_deleted", F.col("is_deleted") & F.col("_there").isNull()).select(files.columns)


def remove_folders(folders: DataFrame, gone: DataFrame) -> DataFrame:
    """Folders without those of gone (folder_uri)."""
    return folders.join(gone.select("folder_uri"), "folder_uri", "left_anti")


def refresh_permissions(folders: DataFrame, granted: DataFrame, now_ms: int) -> DataFrame:
    """Folders after a check of grants: ACTIVE or NEEDS_REGRANT; nothing is removed."""
    told = folders.join(granted.select("folder_uri").distinct().withColumn("_g", F.lit(True)), "folder_uri", "left")
    return told.withColumns({"permission_state": F.when(F.col("_g"), "ACTIVE").otherwise("NEEDS_REGRANT"), "last_validated_at": F.lit(now_ms).cast("long")}).select(folders.columns)
