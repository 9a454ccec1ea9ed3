"""Tags of texts: lexicon terms, corpus-relative terms and dates."""

from __future__ import annotations

import math
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.functions.lexicon import LEXICON, TermMatcher, match_terms, may_match
from corvane.functions.vector import smoothed_idf
from corvane.runtime import Workspace, arrow_rows, ship_package

MOST_TAGS = 10
MIN_IDF = 1.8
DATE_SCORE = 0.9
FEW_TERMS = 1 << 20  # of a sample, that are sent to all tasks


def term_frequencies(files: DataFrame, text: Column, id: str = "file_id", keep=None) -> DataFrame:
    """(id, term, tf, first): counts of tokens and where each comes first; keep: a condition for a token, before places are counted."""
    toks = tx.tokens(text) if keep is None else F.filter(tx.tokens(text), keep)
    toks = files.select(id, F.posexplode(toks).alias("pos", "term"))
    return toks.groupBy(id, "term").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first"))


def document_frequencies(sample: DataFrame, text: Column, most: int = 10000, least_length: int = 3) -> DataFrame:
    """(term, df) over the first characters of the sample's texts."""
    toks = sample.select(F.explode(F.array_distinct(tx.tokens(F.substring(text, 1, most)))).alias("term"))
    return toks.where(F.length("term") >= least_length).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lexicon_tags(tf: DataFrame, id: str = "file_id") -> DataFrame:
    """(id, tag, score, rank): matched terms, stronger for up to three further matches; single tokens only."""
    hits = match_terms(tf.withColumnRenamed("term", "gram")).groupBy(id, "gram", "tf", "cat_ord", "term_ord", "term", "weight").agg(F.count(F.lit(1)).alias("_"))
    counted = hits.groupBy(id, "cat_ord", "term_ord", "term", "weight").agg(F.sum("tf").alias("n"))
    score = F.col("weight") * (1 + 0.2 * F.least(F.col("n") - 1, F.lit(3)))
    return counted.select(id, tx.title_case(F.col("term")).alias("tag"), score.alias("score"), (F.col("cat_ord") * 1000 + F.col("term_ord")).cast("long").alias("rank"))


def corpus_tags(tf: DataFrame, df: DataFrame, documents: Column | int, id: str = "file_id") -> DataFrame:
    """(id, tag, score, rank): rare terms of four characters and more; none for an empty corpus."""
    n = documents if isinstance(documents, Column) else F.lit(documents)
    joined = tf.where(F.length("term") >= 4).join(df, "term", "left").withColumn("idf", smoothed_idf(n, F.coalesce("df", F.lit(0))))
    return joined.where((n > 0) & (F.col("idf") >= MIN_IDF)).select(id, F.col("term").alias("tag"), (F.log1p("tf") * F.col("idf")).alias("score"), (F.col("first") + len(LEXICON) * 1000).cast("long").alias("rank"))


def best_tags(tags: DataFrame, most: int = MOST_TAGS, id: str = "file_id") -> DataFrame:
    """(id, rank, tag, score) of (id, tag, score, rank): equal tags once with their best score, the best first, then in order of appearance."""
    merged = tags.groupBy(id, "tag").agg(F.max("score").alias("score"), F.min("rank").alias("first"))
    order = Window.partitionBy(id).orderBy(F.desc("score"), "first", "tag")
    return merged.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(id, "rank", "tag", "score")


def extract_tags(files: DataFrame, text: Column, sample: DataFrame, sample_text: Column, most: int = MOST_TAGS, id: str = "file_id", few: int = FEW_TERMS, spans: bool = True) -> DataFrame:
    """(id, rank, tag, score): the best tags of each text; equal tags count once with their best score. id is a key of files.

    spans: whether dates and years are tags too, besides lexicon and corpus terms.

    The terms of a sample of texts are few (the reference takes 300 texts of 10,000 characters): up to
    ``few`` they are sent to all tasks, and each text is parted once, in a map over Arrow batches that gives
    its best tags alone. Above, terms and texts are joined.
    """
    df = Workspace(files.sparkSession, "tags").write(document_frequencies(sample, sample_text), "df")
    dates = tx.date_tags(text) if spans else F.array().cast("array<string>")
    if df.count() > few:
        return _joined_tags(files, text, sample, df, most, id, dates)
    spark, kind = files.sparkSession, dict(files.dtypes)[id]
    ship_package(spark)
    arrow_rows(spark)
    known = spark.sparkContext.broadcast(({r["term"]: r["df"] for r in df.collect()}, sample.count()))  # at most FEW_TERMS terms

    def run(batches):
        counts, n = known.value
        matcher = TermMatcher()
        for batch in batches:
            rows = [(i, r, *t) for i, (lowered, dates) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) for r, t in enumerate(_tags_of(matcher, lowered, dates, counts, n, most), 1)]
            at, rank, tag, score = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.array(tag, pa.string()), pa.array(score, pa.float64())], [id, "rank", "tag", "score"])

    return files.select(id, F.lower(text).alias("lowered"), dates.alias("dates")).mapInArrow(run, f"{id} {kind}, rank int, tag string, score double")


def _tags_of(matcher: TermMatcher, lowered: str | None, dates: list[str] | None, counts: dict[str, int], n: int, most: int) -> list[tuple[str, float]]:
    """The best tags of one text with their scores: those of lexicon_tags, corpus_tags and dates."""
    toks = matcher.tokens(lowered or "")
    tags: dict[str, tuple[float, int]] = {}

    def add(tag: str, score: float, rank: int) -> None:
        had = tags.get(tag)
        tags[tag] = (score, rank) if had is None else (max(score, had[0]), min(rank, had[1]))

    tf, first = Counter(toks), dict(zip(reversed(toks), range(len(toks) - 1, -1, -1)))
    matched: dict[int, int] = {}
    for token, times in tf.items():
        for entry in matcher[token]:
            matched[entry] = matched.get(entry, 0) + times
    for entry, times in matched.items():
        cat_ord, _, term_ord, term, weight = LEXICON[entry]
        add(" ".join(w.capitalize() for w in term.split(" ")), weight * (1 + 0.2 * min(times - 1, 3)), cat_ord * 1000 + term_ord)
    if n > 0:
        for token, times in tf.items():
            idf = math.log((n + 1) / (counts.get(token, 0) + 1)) + 1 if len(token) >= 4 else 0.0
            if idf >= MIN_IDF:
                add(token, math.log1p(times) * idf, first[token] + len(LEXICON) * 1000)
    if toks:
        for at, tag in enumerate(dates or ()):
            if tag is not None:
                add(tag, DATE_SCORE, at + (1 << 40))
    scores = sorted((s for s, _ in tags.values()), reverse=True)
    floor = scores[most - 1] - 2e-6 if len(scores) > most else -math.inf
    rounded = [(float(Decimal(repr(s)).quantize(Decimal("0.000001"), ROUND_HALF_UP)), r, t) for t, (s, r) in tags.items() if s >= floor]
    return [(t, s) for s, _, t in sorted(rounded, key=lambda x: (-x[0], x[1], x[2]))[:most]]


def _joined_tags(files: DataFrame, text: Column, sample: DataFrame, df: DataFrame, most: int, id: str, spans: Column) -> DataFrame:
    """extract_tags by joins, for samples of any size."""
    tf = term_frequencies(files, text, id)
    size = sample.agg(F.count(F.lit(1)).alias("corpus"))
    by_corpus = corpus_tags(tf.crossJoin(F.broadcast(size)), df, F.col("corpus"), id)  # one row
    worded = files.where(F.size(tx.tokens(text)) > 0)  # a text without tokens has no tags
    dates = worded.select(id, F.posexplode(spans).alias("pos", "tag")).select(id, "tag", F.lit(DATE_SCORE).alias("score"), (F.col("pos") + (1 << 40)).alias("rank"))
    lexical = lexicon_tags(term_frequencies(files, text, id, may_match), id)
    return best_tags(lexical.unionByName(by_corpus).unionByName(dates), most, id)


def persist_tags(tags: DataFrame, file_tag: DataFrame, extracted: DataFrame, confidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New tags and links: a file's links are replaced, each with the file's confidence; names are matched whatever their case, lowest id first."""
    from corvane.operators.store import numbered

    key = F.lower("name")
    have = tags.groupBy(key.alias("k")).agg(F.min("tag_id").alias("tag_id"))
    fresh = extracted.select(F.col("tag").alias("name")).dropDuplicates(["name"]).join(have, F.lower("name") == F.col("k"), "left_anti")
    fresh = fresh.groupBy(key.alias("k")).agg(F.min("name").alias("name")).drop("k")
    new = numbered(fresh, tags, "tag_id", ["name"]).select("tag_id", "name", F.lit(None).cast("string").alias("category"))
    all_tags = tags.unionByName(new)
    ids = all_tags.groupBy(key.alias("k")).agg(F.min("tag_id").alias("tag_id"))
    links = extracted.join(ids, F.lower("tag") == F.col("k")).join(confidence, "file_id").select("file_id", "tag_id", "confidence").dropDuplicates(["file_id", "tag_id"])
    return all_tags, file_tag.join(extracted.select("file_id").distinct(), "file_id", "left_anti").unionByName(links)
