"""Classification of files against the lexicon: scores, evidence, confidence and the decision."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.lexicon import LEXICON, TermMatcher
from corvane.functions.vector import clamp
from corvane.operators.products import best_product
from corvane.runtime import arrow_rows, ship_package
from corvane.schema import Settings

SATURATION = 2.5
MIN_CATEGORY = 0.35
MIN_SIMILARITY = 0.4
AGREEMENT_SAMPLE = 40
PHOTOS_CONFIDENCE = 0.9
#: Weights of the kinds of evidence, and the prior without a history.
WEIGHTS = {"keyword": 0.45, "centroid": 0.35, "agreement": 0.15, "history": 0.05}
NEUTRAL_HISTORY = 0.5


def term_hits(files: DataFrame, text: Column, id: str = "file_id") -> DataFrame:
    """(id, cat_ord, category, term_ord, term, weight): every lexicon term that a text matches, once.

    The lexicon is a constant of the library, so texts meet it in a map over Arrow batches: a text is parted
    once, and only its matches leave the map. As columns, every token would be an element of an interpreted
    filter, or a row of a shuffle.
    """
    ship_package(files.sparkSession)
    arrow_rows(files.sparkSession)
    kind = dict(files.dtypes)[id]
    fields = list(zip(*LEXICON))
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64()]

    def run(batches):
        matcher, columns = TermMatcher(), [pa.array(f, k) for f, k in zip(fields, kinds)]
        for batch in batches:
            found = [matcher.hits(t) if t else [] for t in batch.column(1).to_pylist()]
            own = pa.array([i for i, hits in enumerate(found) for _ in hits], pa.int64())
            at = pa.array([n for hits in found for n in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), *(c.take(at) for c in columns)], [id, "cat_ord", "category", "term_ord", "term", "weight"])

    rows = files.select(id, F.lower(text).alias("lowered"))
    return rows.mapInArrow(run, f"{id} {kind}, cat_ord int, category string, term_ord int, term string, weight double").distinct()


def category_scores(files: DataFrame, text: Column, id: str = "file_id") -> DataFrame:
    """(id, cat_ord, category, score, terms) for every category with a match."""
    terms = F.transform(F.array_sort(F.collect_list(F.struct("term_ord", "term"))), lambda x: x["term"])
    summed = term_hits(files, text, id).groupBy(id, "cat_ord", "category").agg(F.sum("weight").alias("total"), terms.alias("terms"))
    return summed.select(id, "cat_ord", "category", F.least(F.round(F.col("total") / SATURATION, 6), F.lit(1.0)).alias("score"), "terms")


def best_category(scores: DataFrame, id: str = "file_id") -> DataFrame:
    """(id, category, score, terms): the best score of each, the earliest category on ties."""
    best = F.max_by(F.struct("category", "score", "terms"), F.struct("score", (-F.col("cat_ord")).alias("o")))
    return scores.groupBy(id).agg(best.alias("b")).select(id, "b.category", "b.score", "b.terms")


def predict_category(files: DataFrame, text: Column, id: str = "file_id") -> DataFrame:
    """files with category, keyword_score and matched_terms; the best score wins, the earliest category on ties, null below MIN_CATEGORY."""
    best = best_category(category_scores(files, text, id), id).where(F.col("score") >= MIN_CATEGORY)
    sure = best.select(id, "category", F.col("score").alias("keyword_score"), F.col("terms").alias("matched_terms"))
    return files.join(sure, id, "left").withColumn("keyword_score", F.coalesce("keyword_score", F.lit(0.0)))


def confidence(keyword: Column, centroid: Column, agreement: Column, history: Column | None = None) -> tuple[Column, Column]:
    """Weighted mean of the evidence there is, and the weight of it; the history has a neutral prior."""
    parts = {"keyword": keyword, "centroid": centroid, "agreement": agreement, "history": F.coalesce(history if history is not None else F.lit(None).cast("double"), F.lit(NEUTRAL_HISTORY))}
    weight = sum((F.when(c.isNotNull(), WEIGHTS[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    total = sum((F.coalesce(c * WEIGHTS[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    return clamp(F.round(total / weight, 6)), clamp(F.round(weight, 6))


def gate(score: Column, settings: Settings = Settings()) -> Column:
    """ASSIGN, SUGGEST or NONE."""
    return F.when(score >= settings.auto_classify_threshold, "ASSIGN").when(score >= settings.suggest_threshold, "SUGGEST").otherwise("NONE")


def profiles(files: DataFrame, text: Column, id: str = "file_id", most: int = 4000) -> DataFrame:
    """(id, term, tf): term counts over the first characters of a text."""
    toks = files.select(id, F.explode(tx.tokens(F.substring(text, 1, most))).alias("term"))
    return toks.groupBy(id, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def profile_cosines(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file_id, other_id, cosine) of term profiles that share a term; b is the smaller set."""
    na = a.groupBy("file_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("na"))
    nb = b.groupBy("file_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("nb")).withColumnRenamed("file_id", "other_id")
    other = b.select(F.col("file_id").alias("other_id"), "term", F.col("tf").alias("tf_b"))
    dots = a.join(other, "term").groupBy("file_id", "other_id").agg(F.sum(F.col("tf") * F.col("tf_b")).alias("dot"))
    return dots.join(na, "file_id").join(nb, "other_id").select("file_id", "other_id", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6).alias("cosine"))


def sparse_cosines(pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """(file_id, other_id, cosine) of given pairs of term profiles; 0 where they share no term."""
    keys = ["file_id", "other_id"]
    shared = pairs.join(terms, "file_id").join(terms.select(F.col("file_id").alias("other_id"), "term", F.col("tf").alias("other_tf")), ["other_id", "term"])
    dots = shared.groupBy(keys).agg(F.sum(F.col("tf") * F.col("other_tf")).alias("dot"))
    length = terms.groupBy("file_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("length"))
    told = pairs.join(dots, keys, "left").join(length, "file_id", "left").join(length.select(F.col("file_id").alias("other_id"), F.col("length").alias("other_length")), "other_id", "left")
    return told.select(*keys, F.round(F.when(F.col("dot") > 0, F.col("dot") / (F.col("length") * F.col("other_length"))).otherwise(0.0), 6).alias("cosine"))


def cluster_agreement(targets: DataFrame, text: Column, album: str, sample: DataFrame) -> DataFrame:
    """(file_id, similar, agree, agreement) of files with an album in question, against the newest classified files.

    sample: (file_id, primary_album_id, extracted_text), at most AGREEMENT_SAMPLE rows, so the join that
    follows is with a bounded side.
    """
    own = profiles(targets, text)
    cos = profile_cosines(own, profiles(sample, F.col("extracted_text"))).where(F.col("cosine") >= MIN_SIMILARITY)
    told = cos.join(F.broadcast(sample.select(F.col("file_id").alias("other_id"), "primary_album_id")), "other_id").join(targets.select("file_id", F.col(album).alias("wanted")), "file_id")
    n = told.groupBy("file_id").agg(F.count(F.lit(1)).alias("similar"), F.count_if(F.col("primary_album_id") == F.col("wanted")).alias("agree"))
    return n.withColumn("agreement", F.round(F.col("agree") / F.col("similar"), 6))


def centroid_evidence(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(file_id, centroid_score): similarity to the nearest centroid of any album, in 0..1; no rows without centroids."""
    best = best_product(vectors, "file_id", "vector", centroids, "centroid")
    return best.select("file_id", F.round(clamp(F.col("best")), 6).alias("centroid_score"))


def decide(files: DataFrame, albums: DataFrame, text: Column, agreement: DataFrame | None = None, centroid: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """(file_id, album_id, confidence, coverage, reasons, decision) for every file.

    No category: images go to Photos, all others nowhere. A category whose album is missing goes nowhere.
    """
    said = predict_category(files, text)
    named = F.broadcast(albums.where("parent_album_id IS NULL").select(F.col("name").alias("category"), F.col("album_id")))  # the seeds
    joined = said.join(named, "category", "left")
    joined = joined.join(agreement.select("file_id", "agreement"), "file_id", "left") if agreement is not None else joined.withColumn("agreement", F.lit(None).cast("double"))
    joined = joined.join(centroid.select("file_id", "centroid_score"), "file_id", "left") if centroid is not None else joined.withColumn("centroid_score", F.lit(None).cast("double"))
    score, coverage = confidence(F.col("keyword_score"), F.col("centroid_score"), F.col("agreement"))
    photo = F.col("category").isNull() & (F.col("doc_type") == "IMAGE")
    photos = albums.where("name = 'Photos'").agg(F.min("album_id").alias("photos"))
    scored = joined.crossJoin(F.broadcast(photos)).withColumn("_score", score).withColumn("_coverage", coverage)
    known = F.col("album_id").isNotNull()
    evidence = F.array(F.concat(F.lit("keyword: "), tx.percent(F.col("keyword_score"))))
    for label, column in (("centroid", "centroid_score"), ("cluster agreement", "agreement")):
        evidence = F.concat(evidence, F.when(F.col(column).isNotNull(), F.array(F.concat(F.lit(f"{label}: "), tx.percent(F.col(column))))).otherwise(F.array().cast("array<string>")))
    evidence = F.concat(evidence, F.array(F.lit("history prior: 50%")))
    out = scored.select(
        "file_id",
        F.when(photo, F.col("photos")).when(known, F.col("album_id")).alias("album_id"),
        F.when(photo & F.col("photos").isNotNull(), PHOTOS_CONFIDENCE).when(known, F.col("_score")).otherwise(0.0).alias("confidence"),
        F.when(photo, F.lit(None)).when(known, F.col("_coverage")).alias("coverage"),
        F.when(photo, F.array(F.lit("Media type: image with no extractable text"))).when(known, tx.reasons(F.col("category"), F.col("matched_terms"), evidence, F.col("_coverage"))).alias("reasons"),
    )
    return out.withColumn("decision", F.when(F.col("album_id").isNotNull(), gate(F.col("confidence"), settings)).otherwise("NONE"))


def as_result(predicted: DataFrame) -> DataFrame:
    """The plain result of a prediction: no album, its score as confidence, five terms as tags."""
    return predicted.select("file_id", F.col("keyword_score").alias("confidence"), F.when(F.col("category").isNotNull(), F.concat(F.lit("Matched category "), "category")).alias("reason"), F.slice(F.coalesce("matched_terms", F.array().cast("array<string>")), 1, 5).alias("tags"))


