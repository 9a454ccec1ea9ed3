"""Repeated passages against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np

from tests.llm.common import texts


def test_suffix_dedup(docs, empty):
    from corvane.llm.suffixdup import remove_repeats

    first = {}
    rows = [(i, (x or "").encode()) for i, x in texts(docs)]
    for i, b in rows:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], math.inf), math.inf if i is None else i)
    want = Counter()
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (math.inf if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        runs = sum(bool(g) and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        want[(i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())] += 1
    out = remove_repeats(docs)
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out.collect()) == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in out.collect())
    assert remove_repeats(empty).count() == 0


def test_deep_shallow_sort():
    from corvane.llm.suffixdup import deep_shallow

    rng = np.random.default_rng(0)
    for letters in (1, 2, 200):
        rows = rng.integers(0, letters, (300, 50)).astype(np.uint8)
        rows[150:] = rows[:150]
        rows[150:, 33:] = rng.integers(0, letters, (150, 17))
        order, lcp = deep_shallow(rows)
        listed = [rows[i].tobytes() for i in order]
        assert listed == sorted(listed)
        for i in range(1, 300):
            same = [a == b for a, b in zip(listed[i], listed[i - 1])]
            assert lcp[i] == (same.index(False) if False in same else 50)


def test_very_long_texts(spark):
    """A text of over a megabyte again inside another one, in blocks that each text overfills; equal ids; columns that clash."""
    import random

    from corvane.llm.suffixdup import remove_repeats

    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij é") for _ in range(1_200_000))
    rows = [(9, "start " + long + " end"), (2, long), (2, long[:100]), (4, "z" * 3000), (5, "z" * 49 + "y"), (None, long[500:600])]
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"]) for r in remove_repeats(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, n_bytes int")).collect()}
    size = lambda t: len(t.encode())
    assert got[9, size(rows[0][1])] == (size(long), 1) and got[2, size(long)] == (0, 0) and got[2, size(long[:100])] == (0, 0)
    assert got[4, 3000] == (0, 0) and got[5, 50] == (0, 0) and got[None, size(long[500:600])] == (size(long[500:600]), 1)
