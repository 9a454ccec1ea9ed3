"""Clusters of uncategorised files and the albums they suggest."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.vector import clamp, normalize
from corvane.operators.classify import MIN_CATEGORY, best_category, category_scores, profiles
from corvane.operators.products import TILE, _matrix, best_product
from corvane.runtime import Workspace, arrow_rows, ship_package
from corvane.schema import Settings

CANDIDATES = 400
GROUPS = 4096  # sums that a task holds
JOIN_ABOVE = 0.5
SUGGEST_SIZE = 3
SUGGEST_COHESION = 0.65


def greedy_clusters(members: pd.DataFrame, above: float = JOIN_ABOVE) -> pd.DataFrame:
    """Members (ord, file_id, terms, counts) in order: each joins the cluster with the most similar mean profile, if above the floor."""
    sums: list[dict[str, float]] = []
    sizes: list[int] = []
    norms: list[float] = []
    out = []
    for row in members.sort_values("ord").itertuples():
        profile = dict(zip(row.terms, row.counts))
        own = math.sqrt(sum(v * v for v in profile.values()))
        best, where = above, -1
        for c, total in enumerate(sums):
            shared = sum(v * total.get(k, 0.0) for k, v in profile.items())
            near = shared / (own * norms[c]) if shared > 0 else 0.0
            if near > best:
                best, where = near, c
        if where < 0:
            where = len(sums)
            sums.append({})
            sizes.append(0)
            norms.append(0.0)
        for k, v in profile.items():
            sums[where][k] = sums[where].get(k, 0.0) + v
        sizes[where] += 1
        norms[where] = math.sqrt(sum(v * v for v in sums[where].values()))
        out.append((where, row.file_id))
    return pd.DataFrame(out, columns=["cluster", "file_id"])


def cluster_candidates(candidates: DataFrame, text: Column) -> DataFrame:
    """(cluster, file_id) of at most CANDIDATES files with text, newest first; the order decides, so one task does it."""
    ship_package(candidates.sparkSession)
    fit = candidates.where(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0).orderBy(F.desc("date_first_indexed"), "file_id").limit(CANDIDATES)
    ranked = fit.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("date_first_indexed"), "file_id")))
    terms = profiles(fit, text).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("p"))
    rows = ranked.select("file_id", "ord").join(terms, "file_id", "left").select("file_id", "ord", F.coalesce(F.col("p.term"), F.array().cast("array<string>")).alias("terms"), F.coalesce(F.col("p.tf"), F.array().cast("array<double>")).alias("counts"), F.lit(0).alias("all"))
    return rows.groupBy("all").applyInPandas(lambda pdf: greedy_clusters(pdf), "cluster long, file_id long")


def mean_profile(member_profiles: DataFrame) -> DataFrame:
    """(cluster, term, tf): mean term counts of (cluster, file_id, term, tf)."""
    sizes = member_profiles.groupBy("cluster").agg(F.count_distinct("file_id").alias("n"))
    return member_profiles.groupBy("cluster", "term").agg(F.sum("tf").alias("total")).join(sizes, "cluster").select("cluster", "term", (F.col("total") / F.col("n")).alias("tf"))


def partial_sums(vectors: DataFrame, group: str) -> DataFrame:
    """(group, n, low, high, sums, squares): what the vectors of a group sum to, one row a task and group, or a few.

    low, high: the shortest and the longest length; squares: the sum of all squared numbers. Arrow batches are
    summed as matrices, so that no number of a vector becomes a row; a task holds ``GROUPS`` sums.
    """
    ship_package(vectors.sparkSession)
    arrow_rows(vectors.sparkSession, TILE)
    kind = dict(vectors.dtypes)[group]

    def rows_of(held, key_type):
        keys, told = zip(*held.items())
        n, low, high, sums, squares = zip(*told)
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(n, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array([s.tolist() for s in sums], pa.list_(pa.float64())), pa.array(squares, pa.float64())], [group, "n", "low", "high", "sums", "squares"])

    def run(batches):
        held: dict = {}
        for batch in batches:
            column, key_type = batch.column(1), batch.column(0).type
            x, lengths = _matrix(column), pc.list_value_length(column).to_pylist()
            coded = pc.dictionary_encode(batch.column(0), null_encoding="encode")
            codes, keys = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            sums, squares = np.zeros((len(keys), x.shape[1])), np.zeros(len(keys))
            np.add.at(sums, codes, x)
            np.add.at(squares, codes, (x * x).sum(axis=1))
            for code, key in enumerate(keys):
                own = [lengths[i] for i in np.flatnonzero(codes == code)]
                known = [length for length in own if length is not None]
                had = held.get(key)
                now = (len(own), min(known, default=None), max(known, default=None), sums[code], squares[code])
                if had is not None:
                    wide = max(len(had[3]), len(now[3]))
                    both = lambda f, i: f((v for v in (had[i], now[i]) if v is not None), default=None)
                    now = (had[0] + now[0], both(min, 1), both(max, 2), np.pad(had[3], (0, wide - len(had[3]))) + np.pad(now[3], (0, wide - len(now[3]))), had[4] + now[4])
                held[key] = now
            if len(held) >= GROUPS:
                yield rows_of(held, key_type)
                held = {}
        if held:
            yield rows_of(held, key_type)

    return vectors.select(group, "vector").mapInArrow(run, f"{group} {kind}, n long, low int, high int, sums array<double>, squares double")


def _totals(vectors: DataFrame, group: str) -> DataFrame:
    """(group, n, low, high, squares, sums): the partial sums of each group together, position by position."""
    parts = Workspace(vectors.sparkSession, "sums").write(partial_sums(vectors, group), "parts")
    sizes = parts.groupBy(group).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("squares").alias("squares"))
    each = parts.select(F.col(group).alias("_group"), F.posexplode("sums").alias("pos", "x")).groupBy("_group", "pos").agg(F.sum("x").alias("s"))
    summed = each.groupBy("_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda v: v["s"]).alias("sums"))
    return sizes.join(summed, F.col(group).eqNullSafe(F.col("_group")), "left").drop("_group")


def mean_vectors(vectors: DataFrame, group: str) -> DataFrame:
    """(group, n, centroid): normalised mean of the vectors of each group, null where their lengths differ."""
    summed = F.when((F.col("low") == F.col("high")) & (F.col("high") > 0), normalize(F.slice("sums", F.lit(1), F.col("high"))))
    return _totals(vectors, group).select(group, "n", summed.alias("centroid"))


def cohesion(vectors: DataFrame, group: str) -> DataFrame:
    """(group, n, cohesion): mean cosine of all pairs of unit vectors, from the length of their sum; 0 for one vector. Groups without numbers are left out."""
    whole = F.aggregate("sums", F.lit(0.0), lambda total, s: total + s * s)
    pairs = F.col("n") * (F.col("n") - 1)
    told = _totals(vectors, group).where(F.col("high") > 0)
    return told.select(group, "n", F.when(F.col("n") < 2, 0.0).otherwise(F.round((whole - F.col("squares")) / pairs, 6)).alias("cohesion"))


def verdict(size: Column, cohesive: Column, nearest: Column, settings: Settings = Settings()) -> Column:
    """AUTO_CREATE, SUGGEST_TO_USER or KEEP_UNCATEGORIZED; an unknown nearest album counts as no distinctness."""
    distinct = F.coalesce(1 - nearest, F.lit(0.0))
    auto = (size >= settings.new_album_min_cluster_size) & (cohesive >= settings.new_album_cohesion_threshold) & (distinct >= settings.new_album_distinctiveness_threshold)
    return F.when(auto, "AUTO_CREATE").when((size >= SUGGEST_SIZE) & (cohesive >= SUGGEST_COHESION), "SUGGEST_TO_USER").otherwise("KEEP_UNCATEGORIZED")


def cluster_names(member_terms: DataFrame, group: str = "cluster", categories=("education", "career", "finance", "identity", "photos", "uncategorized")) -> DataFrame:
    """(group, name): the term of four letters and more in most members, none that names a category; the first in order on ties."""
    fit = member_terms.where((F.length("term") >= 4) & ~F.lower("term").isin(*categories))
    counts = fit.groupBy(group, "term").agg(F.count_distinct("file_id").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), "term")
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").select(group, F.concat(F.upper(F.substring("term", 1, 1)), F.expr("substring(term, 2)")).alias("name"))


def nearest_album(centroids: DataFrame, albums: DataFrame, group: str) -> DataFrame:
    """(group, nearest): the largest similarity to an album's centroid."""
    best = best_product(centroids.where(F.col("centroid").isNotNull()), group, "centroid", albums, "centroid")
    return best.select(group, clamp(F.col("best")).alias("nearest"))


def parent_albums(members: DataFrame, albums: DataFrame, group: str = "cluster") -> DataFrame:
    """(group, parent_album_id): the seed album of the category of all file names together, in the order of their files.

    A cluster's names are one text, but need not be one row: its terms are those of each name, and of the
    last token of a name with the first one of the next.
    """
    ends = members.select(group, "file_id", tx.tokens(F.col("display_name")).alias("t")).where(F.size("t") > 0).select(group, "file_id", F.element_at("t", 1).alias("first"), F.element_at("t", -1).alias("last"))
    seams = ends.select(group, F.concat_ws(" ", F.lag("last").over(Window.partitionBy(group).orderBy("file_id", "first", "last")), "first").alias("text"))
    scores = category_scores(members.select(group, F.col("display_name").alias("text")).unionByName(seams), F.col("text"), group)
    said = best_category(scores, group).where(F.col("score") >= MIN_CATEGORY).select(group, "category")
    seeds = F.broadcast(albums.where("parent_album_id IS NULL").select(F.col("name").alias("category"), F.col("album_id").alias("parent_album_id")))  # the seeds
    return members.select(group).distinct().join(said.join(seeds, "category"), group, "left").select(group, "parent_album_id")


def reconcile(files: DataFrame, embeddings: DataFrame, albums: DataFrame, album_centroids: DataFrame, settings: Settings = Settings(), candidates: DataFrame | None = None) -> DataFrame:
    """(cluster, n, cohesion, name, parent_album_id, verdict, confidence, file_ids) of clusters worth an album.

    Nothing if fewer files wait than a new album needs. Members are at most CANDIDATES files.
    """
    from corvane.operators.reads import live

    waiting = live(files).where(F.col("primary_album_id").isNull() & F.col("processing_status").isin("CONTENT_DONE", "CLASSIFIED")) if candidates is None else candidates
    enough = live(files).where(F.col("primary_album_id").isNull()).limit(settings.new_album_min_cluster_size).count() >= settings.new_album_min_cluster_size
    members = cluster_candidates(waiting if enough else waiting.limit(0), F.col("extracted_text"))
    sized = members.join(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= SUGGEST_SIZE), "cluster")
    with_vectors = sized.join(embeddings.select("file_id", "vector"), "file_id", "left")
    whole = with_vectors.groupBy("cluster").agg(F.count_if(F.col("vector").isNull()).alias("missing"))
    by_vector = cohesion(with_vectors.where(F.col("vector").isNotNull()), "cluster").select("cluster", F.col("cohesion").alias("by_vector"))
    own = profiles(sized.join(files.select("file_id", "extracted_text"), "file_id"), F.col("extracted_text"))
    length = own.groupBy("file_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("length"))
    unit = own.join(length, "file_id").join(sized, "file_id").withColumn("x", F.col("tf") / F.col("length"))
    sums = unit.groupBy("cluster", "term").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    by_terms = sums.groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("whole"), F.sum("q").alias("own"))
    centre = mean_vectors(with_vectors.where(F.col("vector").isNotNull()), "cluster")
    facts = sized.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("file_id")).alias("file_ids")).join(whole, "cluster").join(by_vector, "cluster", "left").join(by_terms, "cluster", "left")
    pairs = F.col("n") * (F.col("n") - 1)
    facts = facts.withColumn("cohesion", F.round(F.when(F.col("missing") == 0, F.col("by_vector")).otherwise((F.col("whole") - F.col("own")) / pairs), 6))
    facts = facts.join(nearest_album(centre, album_centroids, "cluster"), "cluster", "left").join(cluster_names(own.join(sized, "file_id")), "cluster", "left")
    facts = facts.join(parent_albums(sized.join(files.select("file_id", "display_name"), "file_id"), albums), "cluster", "left")
    facts = facts.withColumn("verdict", verdict(F.col("n"), F.col("cohesion"), F.col("nearest"), settings))
    sure = F.when(F.col("verdict") == "SUGGEST_TO_USER", F.least(F.greatest("cohesion", F.lit(0.60)), F.lit(0.84))).otherwise(F.col("cohesion"))
    return facts.where("verdict != 'KEEP_UNCATEGORIZED' AND name IS NOT NULL").select("cluster", "n", "cohesion", "name", "parent_album_id", "verdict", sure.alias("confidence"), "file_ids")


def apply_reconcile(found: DataFrame, albums: DataFrame, file_album: DataFrame, suggestions: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Albums, assignments and suggestions after a sweep: new albums are created with their files, the rest is suggested."""
    from corvane.operators.albums import offer
    from corvane.operators.store import numbered, upsert_assignment

    known = albums.select("name", F.col("album_id").alias("known_id"))
    told = found.join(known, "name", "left").where("verdict = 'SUGGEST_TO_USER' OR known_id IS NULL")
    fresh = told.where("known_id IS NULL").groupBy("name").agg(F.first("parent_album_id").alias("parent_album_id"))
    new = numbered(fresh, albums, "album_id", ["name"]).select("album_id", "name", "parent_album_id", F.lit("AUTO_CREATED").alias("type"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("created_automatically"))
    all_albums = albums.unionByName(new, allowMissingColumns=True)
    rows = told.join(all_albums.select("name", "album_id"), "name").select("album_id", "verdict", "confidence", "n", F.explode("file_ids").alias("file_id"))
    auto = rows.where("verdict = 'AUTO_CREATE'").select("file_id", "album_id", "confidence", F.lit("AUTO").alias("assigned_by"), F.lit(now_ms).cast("long").alias("assigned_at"))
    offers = rows.where("verdict = 'SUGGEST_TO_USER'").select("file_id", F.col("album_id").alias("suggested_album_id"), "confidence", F.lit(now_ms).cast("long").alias("created_at"))
    return all_albums, upsert_assignment(file_album, auto), offer(suggestions, offers)
