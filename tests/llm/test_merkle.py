"""The manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle
from tests.llm.common import DOCS


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def plain_tree(digests):
    """Root, and for each leaf its steps (left, right)."""
    steps, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for leaf_at, i in enumerate(at):
            low = i - i % 3
            steps[leaf_at].append(("".join(level[low:i]), "".join(level[i + 1 : low + 3])))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at = [i // 3 for i in at]
    return level[0], steps


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    root, upper = plain_tree([trees[s][0] for s in sources])
    out = []
    for s, up in zip(sources, upper):
        for (_, _, digest, r), own in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            text, steps = r["text"], own + up
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for left, right in steps:
                folded = h(left, folded, right)
            out.append((r["doc_id"], digest, trees[s][0], root, h(*(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r)[:6] + (r["verified"],) for r in merkle.document_manifest(frame).collect()), key=str)


def test_corpus(docs):
    lines = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nline"))).otherwise(F.col("text")))
    got = found(lines)
    assert got == plain(lines.collect())
    assert {x[6] for x in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 82, 244])
def test_sizes_around_blocks(spark, n, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(i, f"t{i}\n", "en", "hot", 3) for i in range(n)] + [(1000 + i, "x", "en", f"s{i}", 1) for i in range(0, n, 5)] + [(2000, "x", None, None, None), (2001, None, "fr", "-", 4), (2002, "é\n", "fr", "", 4)]
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    assert found(frame) == plain(frame.collect())


def test_ties_repeats_and_nulls(spark):
    rows = [(1, "a", "en", "s", 1)] * 4 + [(1, "b", "en", "s", 1), (None, "c\n", "en", "s", 2), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "w\n" * 900_000, "en", "s", 5)]
    frame = spark.createDataFrame(rows, DOCS)
    got = found(frame)
    assert got == plain(frame.collect()) and len(got) == len(rows)


def test_one_row_and_none(spark, empty):
    frame = spark.createDataFrame([(7, "one", "en", None, 3)], DOCS).withColumns({"leaf": F.lit("clash"), "path": F.lit(1), "grp": F.lit(2)})
    (row,) = merkle.document_manifest(frame).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == h() and row["path"] == "" and row["verified"]
    assert merkle.document_manifest(empty).count() == 0


def test_changes_are_noticed(spark, docs):
    digest = merkle.leaf_digest(F.col("text"))
    other = F.when(F.col("doc_id") == 12, merkle.leaf_digest(F.concat("text", F.lit("!"))))
    out = merkle.manifest(docs, digest, other, F.col("source"), F.col("doc_id"))
    assert [r["doc_id"] for r in out.where("not verified").collect()] == [12]
