"""Mixing sources to target weights with packed blocks; DataFrame functions only.

Every source is one stream of words: its documents in pseudorandom order, cut into blocks of
``block_words``. The mix has ``total_share`` times the words of all sources, split by weight; a target
stops at ``max_repeat`` times its source and the excess is shared again by weight until none is above.

A target is a number of slots of the output. Output shards hold ``shard_slots`` slots each; the counts
of sources in a shard are a multinomial draw given the totals (a multivariate hypergeometric draw): all
slots, laid out source after source, are dealt to output positions by a pseudorandom permutation, and
what a shard gets of a source is its count. A free multinomial draw would leave every source off its
target by about one over the root of its slots, and could take more than ``max_repeat`` times what a
source has.

The counts decide what is taken: the n slots that a shard has of a source are the source's draws b ..
b + n - 1, where b is what the shards before it have drawn. Draw ``j`` of a source is its block
``permute_source(j mod blocks)``, with another permutation for each pass over the source, so no block is
taken more often than the passes begun. Blocks join documents by (source, block index).

Permutations are Feistel networks over the grid ``ceil(sqrt n) x ceil(n / ceil(sqrt n))`` with keyed
xxhash64 rounds; an index that falls outside walks on along its cycle. They need no sort and no state:
any task computes its own slots, and reruns agree.

Cases: null text has size 0; a document without words takes 0; null source is a source of its own, the
last one; repeated rows and null ids count as separate documents; an empty table gives an empty result.
Other columns of the input play no part.

Scale: one pass over the texts gives (id, source, size); offsets are prefix sums in two levels, over
hash buckets of about ``BUCKET_ROWS`` documents and ranges of ``RANGE_SHARDS`` shards each, so a source
with a third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.runtime import Workspace, table

BLOCK_WORDS = 128
SHARD_SLOTS = 1024
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2
BUCKET_ROWS = 4096
CHUNK_SLOTS = 8192
TASK_SLOTS = 65536
RANGE_SHARDS = 1024
_WALK = 16  # longest walk on a small grid; on a large one the chance of a longer walk is below 1e-15


def _round(x: Column, rows: Column, cols: Column, seed: Column) -> Column:
    """One pass of a four-step Feistel network on the grid rows x cols: a bijection of its cells."""
    left, right = F.floor(x / cols).cast("long"), F.pmod(x, cols)
    left = F.pmod(left + F.pmod(F.xxhash64(seed, F.lit(1), right), rows), rows)
    right = F.pmod(right + F.pmod(F.xxhash64(seed, F.lit(2), left), cols), cols)
    left = F.pmod(left + F.pmod(F.xxhash64(seed, F.lit(3), right), rows), rows)
    right = F.pmod(right + F.pmod(F.xxhash64(seed, F.lit(4), left), cols), cols)
    return left * cols + right


def permuted(df: DataFrame, name: str, x: Column, n: Column, seed: Column) -> DataFrame:
    """df with the pseudorandom permutation of 0..n-1 at x, keyed by seed; all are columns of longs."""
    rows = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    cols = F.ceil(n / rows).cast("long")
    walked = F.aggregate(F.sequence(F.lit(2), F.lit(_WALK)), F.col(name), lambda at, _: F.when(at < n, at).otherwise(_round(at, rows, cols, seed)))
    return df.withColumn(name, _round(x, rows, cols, seed)).withColumn(name, F.when(F.col(name) < n, F.col(name)).otherwise(walked))


def sizes(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, print): words of each document, and a hash of its text that orders documents of one id."""
    words = F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(F.col(id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text)).alias("print"))


def targets(sized: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a source: its index, words, documents, target, blocks, slots, and the slots before it.

    The windows without partitions run over sources, one row each.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    listed = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    listed = listed.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    everything = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * total_share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ratio = F.col("cap") / F.col("weight")
    first_open = F.min(F.when(F.col("level") <= ratio, F.struct(ratio.alias("ratio"), "sid", "level"))).over(everything)  # all before it stop at their cap
    filled = listed.withColumn("level", level).withColumn("level", first_open["level"])
    filled = filled.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.when(F.col("source_size") > 0, F.round((F.col("target") - F.col("passes") * F.col("source_size")) * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    slotted = filled.withColumn("blocks", blocks).withColumn("passes", passes).withColumn("slots", F.least(F.col("passes") * F.col("blocks") + rest, F.col("blocks") * max_repeat))
    ahead = Window.partitionBy(F.lit(0)).orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    return slotted.select("sid", "source", "weight", "source_size", "source_docs", "target", "blocks", "slots", F.coalesce(F.sum("slots").over(ahead), F.lit(0)).cast("long").alias("slots_before"), F.sum("slots").over(everything).alias("all_slots"))


def shard_counts(sources: DataFrame, seed: int = 17, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, sid, blocks, n): the drawn source counts of every output shard, and the blocks of the source."""
    chunks = sources.where("slots > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(CHUNK_SLOTS).cast("long"))))
    tasks = int((sources.agg(F.max("all_slots")).first()[0] or 0) // TASK_SLOTS) + 1  # by number: bytes say little about rows that are yet to be made
    each = chunks.repartition(tasks, "sid", "first").withColumn("j", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + CHUNK_SLOTS, F.col("slots")) - 1)))
    placed = permuted(each, "place", F.col("slots_before") + F.col("j"), F.col("all_slots"), F.xxhash64(F.lit(seed).cast("long")))
    return placed.groupBy(F.floor(F.col("place") / shard_slots).cast("long").alias("shard"), "sid", "blocks").agg(F.count(F.lit(1)).alias("n"))


def slots(counts: DataFrame, seed: int = 17) -> DataFrame:
    """One row an output slot: (shard, sid, draw, block), by the drawn counts of shard_counts."""
    ranged = counts.withColumn("range", F.floor(F.col("shard") / RANGE_SHARDS).cast("long"))
    ahead = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("sid", "range").agg(F.sum("n").alias("m")).select("sid", "range", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("range_at"))
    inside = Window.partitionBy("sid", "range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begun = ranged.join(ranges, ["sid", "range"]).withColumn("first", F.col("range_at") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    drawn = begun.select("shard", "sid", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("draw"))
    pass_no = F.floor(F.col("draw") / F.col("blocks")).cast("long")
    placed = permuted(drawn, "block", F.pmod(F.col("draw"), F.col("blocks")), F.col("blocks"), F.xxhash64(F.lit(seed).cast("long"), F.col("sid"), pass_no))
    return placed.select("shard", "sid", "draw", "block")


def pieces(sized: DataFrame, sources: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents with words, cut at block borders: (sid, doc_id, size, at, block, words); at: words before it in its source's stream."""
    known = sized.where("size > 0").join(sources.select("sid", F.col("source").alias("named"), "source_docs"), F.col("source").eqNullSafe(F.col("named")))
    buckets = F.ceil(F.col("source_docs") / BUCKET_ROWS).cast("long")
    known = known.select("sid", "doc_id", "size", "print", F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("print")), buckets).alias("bucket"))
    totals = known.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("sid", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("bucket_at"))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "print").rowsBetween(Window.unboundedPreceding, -1)
    laid = known.join(totals, ["sid", "bucket"]).withColumn("at", F.col("bucket_at") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    cut = laid.select("sid", "doc_id", "size", "at", F.explode(F.sequence(first, last)).alias("block"))
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest(F.col("at"), F.col("block") * block_words)
    return cut.withColumn("words", words)


def mix(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", weights=WEIGHTS, total_share: float = TOTAL_SHARE, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS, seed: int = 17, label: str = "mix") -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    work = Workspace(docs.sparkSession, label)
    sized = work.write(sizes(docs, text, source, id), "sizes")
    sources = work.write(targets(sized, weights, total_share, max_repeat, block_words), "sources")
    counts = work.write(shard_counts(sources, seed), "counts")
    drawn = slots(counts, seed).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")  # its size can't be told from the few rows it is made of
    cut = pieces(sized, sources, seed, block_words).join(drawn, ["sid", "block"], "left")
    taken = cut.groupBy("sid", "at", "doc_id", "size").agg(F.sum(F.col("words") * F.coalesce(F.col("times"), F.lit(0))).alias("taken"))
    none = sized.where("size = 0").join(sources.select("sid", F.col("source").alias("named")), F.col("source").eqNullSafe(F.col("named"))).select("sid", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    both = taken.select("sid", "doc_id", "size", "taken").unionByName(none)
    return both.join(sources, "sid").select("doc_id", "source", "size", "source_size", "target", "taken")


def op8_mix_sources(spark, sf_dir):
    """Contract query over all documents."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
