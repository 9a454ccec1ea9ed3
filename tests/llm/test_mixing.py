"""Drawn shard counts decide what the mix takes; sources and ids that hold many rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.common import texts, words


DOCS = "doc_id long, text string, source string, size string, sid int"


def rows(n=300, seed=3):
    rng = random.Random(seed)
    out = [(i, "w " * rng.choice([1, 5, 40, 300]), rng.choice("aaab") if i % 10 else None, "clash", 1) for i in range(n)]
    return out + [(None, f"null id {i} " * 3, "a", "clash", 2) for i in range(60)] + [(5, None, "b", "", 0), (6, "", None, "", 0), (7, "x " * 50_000, "b", "", 0)]


def test_counts_are_drawn_and_used(spark):
    """Every shard is full, totals are exact, no source is dealt out evenly, and blocks are those of the drawn counts."""
    from corvane.llm import mixing
    from corvane.runtime import Workspace

    docs = spark.createDataFrame(rows(), DOCS)
    work = Workspace(spark, "test-mix")
    sized = work.write(mixing.sizes(docs), "sizes")
    sources = work.write(mixing.targets(sized, block_words=8), "sources")
    listed = {r["sid"]: r for r in sources.collect()}
    counts = work.write(mixing.shard_counts(sources, shard_slots=64), "counts")
    drawn = [(r["shard"], r["sid"], r["n"]) for r in counts.collect()]
    shards = Counter()
    for shard, _, n in drawn:
        shards[shard] += n
    total = sum(r["slots"] for r in listed.values())
    assert all(n == 64 for s, n in shards.items() if s < total // 64) and sum(shards.values()) == total
    by_source = {sid: [n for _, s, n in drawn if s == sid] for sid in listed}
    assert all(sum(n) == listed[sid]["slots"] for sid, n in by_source.items()) and len(set(by_source[1])) > 3
    taken = [(r["shard"], r["sid"], r["draw"], r["block"]) for r in mixing.slots(counts).collect()]
    assert Counter((shard, sid) for shard, sid, _, _ in taken) == Counter({(shard, sid): n for shard, sid, n in drawn})
    for sid, r in listed.items():
        draws = sorted((shard, draw) for shard, s, draw, _ in taken if s == sid)
        assert [d for _, d in draws] == list(range(r["slots"]))
        times = Counter(block for _, s, _, block in taken if s == sid)
        assert set(times) <= set(range(r["blocks"])) and max(times.values()) - min(times[b] for b in range(r["blocks"])) <= 1


def test_other_counts_take_other_blocks(spark):
    """What is taken follows from the counts: without half the shards, half is taken."""
    from corvane.llm import mixing
    from corvane.runtime import Workspace

    work = Workspace(spark, "test-mix")
    sources = work.write(mixing.targets(work.write(mixing.sizes(spark.createDataFrame(rows(), DOCS)), "sizes"), block_words=8), "sources")
    counts = work.write(mixing.shard_counts(sources, shard_slots=64), "counts")
    less = counts.where(F.col("shard") % 2 == 0)
    assert mixing.slots(less).count() == less.agg(F.sum("n")).first()[0] < counts.agg(F.sum("n")).first()[0]


def test_null_ids_long_texts_and_reruns(spark):
    from corvane.llm.mixing import mix

    docs = spark.createDataFrame(rows(), DOCS)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["size"], r["taken"])
    one, two = (sorted(map(key, mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert one == two and len(one) == len(rows())
    assert all(0 <= taken <= 2 * size for *_, size, taken in one) and max(size for *_, size, _ in one) == 50_000


def test_mixing(docs, empty, spark):
    from corvane.llm.mixing import mix, permuted

    for n in (1, 2, 7, 100, 1001):
        p = permuted(spark.range(n), "p", F.col("id"), F.lit(n).cast("long"), F.lit(3).cast("long"))
        assert sorted(r["p"] for r in p.collect()) == list(range(n))
    out = mix(docs.select("doc_id", "text", "source"), block_words=4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, len(words(x))) for i, x in texts(docs))
    sizes = Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
    left, weights, target = dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}, {}
    total = 1.5 * sum(sizes.values())
    while left:
        level = (total - sum(target.values())) / sum(weights[s] for s in left)
        over = [s for s in left if level * weights[s] > 2 * sizes[s]]
        for s in over or list(left):
            target[s] = 2 * sizes[s] if over else level * weights[s]
            del left[s]
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 8 for s, t in target.items())
    again = mix(docs.select("doc_id", "text", "source"), block_words=4).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"])
    assert sorted(map(key, out)) == sorted(map(key, again)) and mix(empty).count() == 0
