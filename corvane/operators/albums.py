"""Albums: tree, seeding, assignment, suggestions and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.lexicon import CATEGORIES
from corvane.operators.store import append_new, numbered, update_from, update_where, upsert_assignment


def tree(albums: DataFrame, counts: DataFrame) -> DataFrame:
    """(album_id, name, depth, path, file_count), parents before children and children by name; own files only.

    Levels are joined one after the other until none is left; the number of rounds is the depth.
    """
    rows = albums.join(counts.select("album_id", "file_count"), "album_id", "left").select("album_id", "name", "parent_album_id", F.coalesce("file_count", F.lit(0)).alias("file_count"))
    level = rows.where("parent_album_id IS NULL").select("album_id", "name", "file_count", F.lit(0).alias("depth"), F.col("name").alias("path"))
    out, depth = level, 0
    while True:
        depth += 1
        above = level.select(F.col("album_id").alias("parent_album_id"), F.col("path").alias("above"))
        level = rows.join(above, "parent_album_id").select("album_id", "name", "file_count", F.lit(depth).alias("depth"), F.concat("above", F.lit(" / "), "name").alias("path"))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def by_parent(albums: DataFrame) -> DataFrame:
    """(parent_album_id, children, names): the albums of each parent, names in order; null for those on top."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("name", "album_id"))), lambda x: x["name"])
    return albums.groupBy("parent_album_id").agg(F.count(F.lit(1)).alias("children"), names.alias("names"))


def seed(albums: DataFrame, now_ms: int) -> DataFrame:
    """Albums with those of all categories; known names stay as they are."""
    spark = albums.sparkSession
    wanted = spark.createDataFrame([(i, c) for i, c in enumerate(CATEGORIES)], "o int, name string").join(albums.select("name"), "name", "left_anti")
    new = numbered(wanted, albums, "album_id", ["o"]).select("album_id", "name", F.lit("PREDEFINED").alias("type"), F.lit(False).alias("created_automatically"), F.lit(now_ms).cast("long").alias("created_at"))
    return albums.unionByName(new.select([c for c in new.columns if c in albums.columns]), allowMissingColumns=True)


def create(albums: DataFrame, name: str, parent: int | None, now_ms: int) -> DataFrame:
    """Albums with a new one of the user's; a known name changes nothing."""
    row = albums.sparkSession.createDataFrame([(name, parent, "USER_CREATED", False, now_ms)], "name string, parent_album_id long, type string, created_automatically boolean, created_at long")
    new = numbered(row.join(albums.select("name"), "name", "left_anti"), albums, "album_id", ["name"])
    return albums.unionByName(new.select([c for c in new.columns if c in albums.columns]), allowMissingColumns=True)


def assign(files: DataFrame, file_album: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and assignments after (file_id, album_id, confidence, assigned_by, assigned_at): the latest one is a file's primary album."""
    latest = Window.partitionBy("file_id").orderBy(F.desc("assigned_at"), F.desc("album_id"))
    last = rows.withColumn("r", F.row_number().over(latest)).where("r = 1").select("file_id", F.col("album_id").alias("primary_album_id"), F.col("confidence").alias("classification_confidence"))
    return update_from(files, last, ["file_id"]), upsert_assignment(file_album, rows)


def offer(suggestions: DataFrame, offers: DataFrame) -> DataFrame:
    """Suggestions with new pending ones: one a file at most, and none that was rejected for that album."""
    waiting = suggestions.where("status = 'PENDING'").select("file_id")
    refused = suggestions.where("status = 'REJECTED'").select("file_id", "suggested_album_id")
    fit = offers.join(waiting, "file_id", "left_anti").join(refused, ["file_id", "suggested_album_id"], "left_anti")
    best = Window.partitionBy("file_id").orderBy(F.desc("confidence"), "suggested_album_id")
    one = fit.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r").withColumn("status", F.lit("PENDING"))
    return suggestions.unionByName(numbered(one, suggestions, "suggestion_id", ["file_id"]), allowMissingColumns=True)


def answer(suggestions: DataFrame, answers: DataFrame) -> DataFrame:
    """Suggestions after (file_id, suggested_album_id, answer); only pending ones change."""
    told = suggestions.join(answers.select("file_id", "suggested_album_id", "answer").distinct(), ["file_id", "suggested_album_id"], "left")
    new = F.when(F.col("answer").isNotNull() & (F.col("status") == "PENDING"), F.col("answer")).otherwise(F.col("status"))
    return told.withColumn("status", new).select(suggestions.columns)


def accept(files: DataFrame, file_album: DataFrame, suggestions: DataFrame, keys: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, assignments and suggestions after pending suggestions (file_id, suggested_album_id) are accepted."""
    hit = suggestions.where("status = 'PENDING'").join(keys, ["file_id", "suggested_album_id"], "left_semi")
    rows = hit.select("file_id", F.col("suggested_album_id").alias("album_id"), "confidence", F.lit("SUGGESTED_ACCEPTED").alias("assigned_by"), F.lit(now_ms).cast("long").alias("assigned_at"))
    new_files, links = assign(files, file_album, rows)
    return new_files, links, answer(suggestions, keys.withColumn("answer", F.lit("ACCEPTED")))


def correct(files: DataFrame, file_album: DataFrame, corrections: DataFrame, rows: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A user's corrections (file_id, album_id): recorded with the former album, and assigned with confidence 1."""
    told = rows.join(files.select("file_id", "primary_album_id"), "file_id").select("file_id", F.col("primary_album_id").alias("previous_album_id"), F.col("album_id").alias("corrected_album_id"), F.lit("RECLASSIFY").alias("correction_type"), F.lit(now_ms).cast("long").alias("timestamp"))
    new_files, links = assign(files, file_album, rows.select("file_id", "album_id", F.lit(1.0).alias("confidence"), F.lit("USER").alias("assigned_by"), F.lit(now_ms).cast("long").alias("assigned_at")))
    return new_files, links, corrections.unionByName(numbered(told, corrections, "correction_id", ["file_id"]), allowMissingColumns=True)


def nudge(centroid, vector, rate: float, away: bool = False):
    """A centroid moved towards a vector (or away from it) by a share of their difference."""
    sign = -rate if away else rate
    return F.zip_with(centroid, vector, lambda c, v: c.cast("double") + sign * (v.cast("double") - c.cast("double")))


def boost_terms(lexicon: DataFrame, corrected: DataFrame, rate: float) -> DataFrame:
    """Lexicon weights after corrections (category, term): each adds a share of the weight."""
    n = corrected.groupBy("category", "term").agg(F.count(F.lit(1)).alias("n"))
    return lexicon.join(n, ["category", "term"], "left").withColumn("weight", F.col("weight") * (1 + rate * F.coalesce("n", F.lit(0)))).drop("n")


def set_centroids(albums: DataFrame, centroids: DataFrame) -> DataFrame:
    """Albums with new centroids; those without vectors keep theirs."""
    return update_from(albums, centroids.where(F.col("centroid").isNotNull()).select("album_id", "centroid"), ["album_id"])


def set_confidence(albums: DataFrame, album_id: int, confidence: float) -> DataFrame:
    return update_where(albums, F.col("album_id") == album_id, confidence=confidence)


__all__ = ["accept", "answer", "append_new", "assign", "boost_terms", "correct", "create", "nudge", "offer", "seed", "set_centroids", "set_confidence", "tree"]
