"""Reads of the file index: lookups, filters, joins, counts and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(files: DataFrame) -> DataFrame:
    return files.where(~F.col("is_deleted"))


def by_id(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value)


def live_by_name(files: DataFrame) -> DataFrame:
    return live(files).orderBy("display_name", "file_id")


def change_signature(files: DataFrame, uri: str) -> DataFrame:
    return files.where(F.col("uri") == uri).select("file_id", "size_bytes", "date_modified_source")


def other_with_uri(files: DataFrame, uri: str, file_id: int) -> DataFrame:
    return files.where((F.col("uri") == uri) & (F.col("file_id") != file_id)).select("file_id")


def unprocessed(files: DataFrame, n: int) -> DataFrame:
    return live(files).where("processing_status != 'INDEXED'").orderBy("date_first_indexed", "file_id").limit(n)


def hashed(files: DataFrame, doc_type: str | None) -> DataFrame:
    """Ids with a content hash of a document type; a null type fits nothing."""
    return files.where((F.col("doc_type") == F.lit(doc_type)) & F.col("sha256_hash").isNotNull()).select("file_id", "sha256_hash")


def classification_candidates(files: DataFrame, n: int, statuses=("CONTENT_DONE", "CLASSIFIED")) -> DataFrame:
    fit = live(files).where(F.col("processing_status").isin(*statuses) & F.col("primary_album_id").isNull())
    return fit.orderBy(F.desc("date_first_indexed"), "file_id").limit(n).select("file_id", "display_name", "extracted_text")


def classified_profiles(files: DataFrame, n: int) -> DataFrame:
    fit = files.where(F.col("primary_album_id").isNotNull() & (F.length("extracted_text") > 0))
    return fit.orderBy(F.desc("date_first_indexed"), "file_id").limit(n).select("file_id", "primary_album_id", "extracted_text")


def albums_with_centroid(albums: DataFrame) -> DataFrame:
    return albums.where(F.col("centroid").isNotNull())


def page(rows: DataFrame, key: str, size: int, number: int) -> DataFrame:
    """A page of rows by their key, numbered from 0."""
    return rows.orderBy(key).offset(size * number).limit(size)


def text_sample(files: DataFrame, n: int) -> DataFrame:
    return files.where(F.length("extracted_text") > 0).orderBy(F.desc("date_first_indexed"), "file_id").limit(n).select("file_id", "extracted_text")


def newest(files: DataFrame, n: int = 500) -> DataFrame:
    return live(files).orderBy(F.desc("date_first_indexed"), "file_id").limit(n)


def children(albums: DataFrame, parent: int | None) -> DataFrame:
    """Albums below a parent; a null parent gives those at the top."""
    return albums.where(F.col("parent_album_id").eqNullSafe(F.lit(parent))).orderBy("name")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_name_nocase(df: DataFrame, name: str, id: str) -> DataFrame:
    """The row of a name whatever the case of A-Z; the lowest id of several."""
    return df.where(ascii_lower(F.col("name")) == ascii_lower(F.lit(name))).orderBy(id).limit(1)


def assignments(file_album: DataFrame, file_id: int) -> DataFrame:
    return file_album.where(F.col("file_id") == file_id).orderBy(F.desc("confidence"), "album_id")


def folders(df: DataFrame, active: bool | None = None) -> DataFrame:
    if active is None:
        return df
    return df.where("permission_state = 'ACTIVE'" if active else "permission_state != 'ACTIVE'")


def list_items(files: DataFrame, preview: int = 512) -> DataFrame:
    return files.select("file_id", "uri", "display_name", "doc_type", "processing_status", F.substring("extracted_text", 1, preview).alias("preview"))


def filename_search(files: DataFrame, term: str, n: int = 50) -> DataFrame:
    """Names that contain the term whatever the case of A-Z; % and _ in the term are wildcards."""
    fit = live(files).where(ascii_lower(F.col("display_name")).like("%" + term.lower() + "%"))
    return fit.orderBy("display_name", "file_id").limit(n).select("file_id", "display_name")


def files_of_album(files: DataFrame, file_album: DataFrame, album_id: int) -> DataFrame:
    return live(files).join(file_album.where(F.col("album_id") == album_id).select("file_id"), "file_id").orderBy("display_name", "file_id")


def filed(files: DataFrame, file_album: DataFrame) -> DataFrame:
    """Files that are in any album, each once."""
    return live(files).join(file_album, "file_id", "left_semi")


def files_by_tag(files: DataFrame, file_tag: DataFrame, tags: DataFrame, tag: str, n: int) -> DataFrame:
    named = tags.where(ascii_lower(F.col("name")) == tag.lower()).select("tag_id")
    return live(files).join(file_tag.join(named, "tag_id").select("file_id"), "file_id", "left_semi").orderBy("display_name", "file_id").limit(n)


def pending_suggestions(suggestions: DataFrame, files: DataFrame) -> DataFrame:
    joined = suggestions.where("status = 'PENDING'").join(files.select("file_id", "display_name"), "file_id")
    return joined.orderBy(F.desc("created_at"), "suggestion_id")


def album_vectors(embeddings: DataFrame, file_album: DataFrame, album_id: int, model: str) -> DataFrame:
    return embeddings.where(F.col("model_version") == model).join(file_album.where(F.col("album_id") == album_id).select("file_id"), "file_id")


def tags_of_file(file_tag: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags by file, the surest first: (file_id, rank, name, confidence)."""
    order = Window.partitionBy("file_id").orderBy(F.desc("confidence"), "tag_id")
    return file_tag.join(tags, "tag_id").withColumn("rank", F.row_number().over(order)).select("file_id", "rank", "name", "confidence")


def not_queued(files: DataFrame, queue: DataFrame, n: int | None = None) -> DataFrame:
    """Files that no pending or running queue item names."""
    busy = queue.where(F.col("status").isin("PENDING", "IN_PROGRESS")).select("file_id")
    out = live(files).join(busy, "file_id", "left_anti").select("file_id")
    return out if n is None else out.orderBy("file_id").limit(n)


def album_counts(albums: DataFrame, file_album: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Albums with the number of files assigned to them, 0 where there are none."""
    links = file_album if files is None else file_album.join(live(files), "file_id", "left_semi")
    counts = links.groupBy("album_id").agg(F.count(F.lit(1)).alias("n"))
    return albums.join(counts, "album_id", "left").withColumn("file_count", F.coalesce("n", F.lit(0))).drop("n")


def status_counts(files: DataFrame, queue: DataFrame) -> DataFrame:
    """One row of totals: live, indexed and uncategorised files; pending and running items (running is reported as 0 by the snapshot)."""
    f = files.agg(F.count_if(~F.col("is_deleted")).alias("live"), F.count_if(~F.col("is_deleted") & (F.col("processing_status") == "INDEXED")).alias("indexed"), F.count_if(~F.col("is_deleted") & F.col("primary_album_id").isNull()).alias("uncategorised"))
    q = queue.agg(F.count_if(F.col("status").isin("PENDING", "IN_PROGRESS")).alias("pending"))
    return f.crossJoin(q).withColumn("in_progress", F.lit(0).cast("long"))  # two one-row tables


def suggestion_counts(suggestions: DataFrame) -> DataFrame:
    """Pending suggestions by file, rejected ones by (file, album)."""
    return suggestions.groupBy("file_id", "suggested_album_id").agg(F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "REJECTED").alias("rejected"))


def embedding_counts(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("model_version").agg(F.count(F.lit(1)).alias("n"))


def queue_counts(queue: DataFrame, now_ms: int) -> DataFrame:
    eligible = (F.col("status") == "PENDING") & (F.col("next_eligible_at") <= now_ms)
    return queue.agg(F.count_if(F.col("status").isin("PENDING", "IN_PROGRESS")).alias("pending"), F.count_if(eligible).alias("eligible"))


def tags_concat(files: DataFrame, file_tag: DataFrame, tags: DataFrame) -> DataFrame:
    """(file_id, tags_concat): a file's tag names in order, null without tags."""
    joined = file_tag.join(tags, "tag_id").groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list("name")), " ").alias("tags_concat"))
    return files.select("file_id").join(joined, "file_id", "left")
