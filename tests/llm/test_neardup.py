"""Graphs with hubs, buckets that are dealt to blocks, repeated ids, and texts of any length."""

import random
from collections import Counter

import pytest

from tests.llm.common import shingles, texts


def components(links, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("hub", [1 << 20, 5])
def test_components_with_hubs(spark, monkeypatch, hub):
    from corvane.llm import components as cc
    from corvane.runtime import Workspace

    monkeypatch.setattr(cc, "HUB", hub)
    rng = random.Random(hub)
    edges = [(1000, i) for i in range(60)] + [(rng.randrange(60, 120), rng.randrange(60, 120)) for _ in range(40)] + [(7, 2000), (2000, 2001)]
    want = components(edges, {x for e in edges for x in e})
    got = {r["id"]: r["component"] for r in cc.connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test-cc")).collect()}
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}


def test_buckets_dealt_to_blocks(spark, monkeypatch):
    """A chain of near copies and many copies of one text, whatever the size of a block; other columns clash, and one text has a megabyte."""
    from corvane.llm import neardup

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for i in range(70):
        w = list(base)
        for k in range(rng.choice([0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    drift = [word() for _ in range(150)]
    for i in range(30):
        drift = [*drift[6:], *(word() for _ in range(6))]
        texts.append(" ".join(drift))
    texts += [" ".join(word() for _ in range(150_000)), "", None, "a b", "A  b", "  \n"]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()) for w in ((t or "").lower().split() for t in texts)]
    links = [(i, j) for i, s in enumerate(sets) for j in range(i) if s and sets[j] and 100 * len(s & sets[j]) >= 75 * len(s | sets[j])]
    want = components(links, range(len(texts)))
    frame = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, rep string, n int, kept int")
    for dealt in (2048, 8):
        monkeypatch.setattr(neardup, "DEALT", dealt)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame).collect()}
        assert got == {i: (len(s), want[i], want[i] == i) for i, s in enumerate(sets)}


def test_ids_that_repeat_with_other_texts(spark):
    """Rows that share an id share a component; each row is reported."""
    from corvane.llm.neardup import near_duplicates

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (2, "quite another text that nothing else here looks like"), (None, text)]
    got = Counter((r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[(1, 1)] == 2 and sum(got.values()) == 5


def test_near_duplicates(docs, empty):
    from corvane.llm.neardup import near_duplicates

    rows = [(i, shingles(x)) for i, x in texts(docs)]
    named = [(i, s) for i, s in rows if i is not None]
    links = [(a, b) for n, (a, s) in enumerate(named) for b, t in named[:n] if s and t and a != b and 100 * len(s & t) >= 75 * len(s | t)]
    root = components(links, {i for i, _ in named})
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect() if r["doc_id"] is not None)
    assert got == Counter((i, len(s), root[i], root[i] == i) for i, s in named)
    assert near_duplicates(empty).count() == 0


def test_connected_components_of_a_path(spark):
    from corvane.llm.components import connected_components
    from corvane.runtime import Workspace

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(50, 51), (51, 50), (60, 60), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges, Workspace(spark, "test-cc")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50}
