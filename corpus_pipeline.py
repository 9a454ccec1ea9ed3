"""A training-corpus pipeline: language ID, near-duplicates, decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the
last return the columns of documents. Their results are written as Parquet and read again in between.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.decontaminate import contaminated
from corvane.llm.frames import id_crc
from corvane.llm.language import identify, train_profiles
from corvane.llm.mixing import mix
from corvane.llm.neardup import near_duplicates
from corvane.llm.tokenstore import token_output
from corvane.runtime import Workspace, table

SMALL = 1_000_000  # rows of ids that may be broadcast; beyond that they are shuffled
LEAST_SCORE = 0.05  # a text that shares next to no n-gram ranks with its language is none


def _sized(rows: DataFrame, work: Workspace, name: str) -> DataFrame:
    """rows, written; for a broadcast where their number is within the bound."""
    written = work.write(rows, name)
    return F.broadcast(written) if written.count() <= SMALL else written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language; those without letters, or like no profile, go."""
    profiles = train_profiles(docs.where(id_crc() % 5 != 0))
    said = identify(docs.withColumns({f"_kept_{c}": F.col(c) for c in docs.columns if c in ("lang_pred", "score")}), profiles)
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*[F.col(f"_kept_{c}").alias(c) if c in ("lang_pred", "score") else F.col(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, once."""
    work = Workspace(spark, "stage-neardup")
    found = work.write(near_duplicates(docs), "found")
    gone = _sized(found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct(), work, "gone")
    repeated = _sized(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), work, "repeated")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    once = kept.join(repeated, "doc_id", "left_anti").select(docs.columns)
    return once.unionByName(kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    work = Workspace(spark, "stage-decontaminate")
    hit = contaminated(docs, table(spark, sf_dir, "benchmark")).where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(_sized(hit, work, "hit"), "doc_id", "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole times, and once more with the chance of the rest (keyed by the id).

    Documents without an id share what the mix takes of the one that it takes most often.
    """
    work = Workspace(spark, "stage-mix")
    share = F.col("taken") / F.greatest("size", F.lit(1))
    chance = F.pmod(F.xxhash64(F.lit(29), F.col("doc_id")), F.lit(1 << 20)) / float(1 << 20)
    times = (F.floor(share) + (chance < share - F.floor(share)).cast("int")).cast("int")
    taken = work.write(mix(docs).groupBy("doc_id").agg(F.max(times).alias("n")).where("n > 0"), "taken")
    fresh = lambda name: name if name not in docs.columns else fresh(f"{name}_")
    key, n = fresh("mixed_id"), fresh("mixed_times")
    wanted = taken.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key), F.col("n").alias(n))
    nameless = taken.where(F.col("doc_id").isNull()).first()
    joined = docs.join(_sized(wanted, work, "times"), F.col("doc_id") == F.col(key)).drop(key)
    if nameless is not None:
        joined = joined.unionByName(docs.where(F.col("doc_id").isNull()).withColumn(n, F.lit(nameless["n"])))
    return joined.withColumn(key, F.explode(F.array_repeat(F.lit(1), F.col(n)))).select(docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all that is left, in the content-addressed store; what a reader finds there."""
    return token_output(docs)


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
    ("token output", token_stage),
]

#: SQL can't express the stages; tests/llm/test_whole_pipeline.py holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again.

    A stage's working tables go once its result is written, but for those of the last stage: its store stays.
    """
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with Workspace.scope() if i + 1 < len(STAGES) else nullcontext():
            docs = work.write(stage(spark, docs, sf_dir), f"stage-{i}")
        if i:
            work.drop(f"stage-{i - 1}")
    return docs
