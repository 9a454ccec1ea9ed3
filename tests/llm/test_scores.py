"""Language-model scores."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tests.llm.common import texts, words


LABELLED = "doc_id long, text string, lang string, score string, n_known int"


def labelled(n=120, seed=2):
    rng = random.Random(seed)
    words = {"en": "the of and was with that hand stone other thing under".split(), "fr": "le la des une \u00eatre \u00e9aux pour ment entre ouvre".split(), "de": "der die das und nicht \u00fcber stra\u00dfe haus wird mit".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(words))
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "er", "ing", "."]) for _ in range(rng.choice([2, 20, 60, 150])))
        rows.append((i, text, lang, "clash", 1))
    return rows + [(500, None, None, "clash", 1), (501, "", "en", None, 1), (502, " \n\t ", "fr", None, 1), (None, rows[3][1], "en", None, 1), (3, rows[3][1], "en", None, 1), (503, "word " * 60_000, "en", None, 1)]


def test_trained_scores(spark, monkeypatch):
    """Every score from the trained model's own vectors: class after two contexts, times the word within its class."""
    from corvane.llm import lmscore as lm

    models = []
    plain_train = lm.LogBilinear.train
    monkeypatch.setattr(lm.LogBilinear, "train", lambda self, *a, **k: (models.append(self), plain_train(self, *a, **k))[1])
    rows = labelled()
    got = [(r["doc_id"], r["score"], r["base_score"], r["held_out"]) for r in lm.score_texts(spark.createDataFrame(rows, LABELLED)).collect()]
    model = models[0]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in split(t))
    from corvane.llm.kernel import hash_word

    top = sorted(counts, key=lambda w: (-counts[w], hash_word(w) - (1 << 64) if hash_word(w) >> 63 else hash_word(w)))
    order = {w: k for k, w in enumerate(sorted(top[: lm.HEAD], key=lambda w: (-counts[w], hash_word(w)))[: lm.OWN])}

    def classes(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        cls, ctx = (int(x[0]) for x in lm._letters(raw, np.array([0]), np.array([len(raw)])))
        own = order.get(word)
        return (own if own is not None else cls), (own + 1 if own is not None and own < lm.CONTEXT_OWN else ctx)

    mass = Counter({c: 0.1 for c in range(lm.CLASSES)})
    for w, n in counts.items():
        if w not in order:
            mass[classes(w)[0]] += n + 0.1

    def log_p(one, two, cls):
        r = model.context[one] @ model.first + model.context[two] @ model.second
        s = model.target @ r + model.bias
        return (s[cls] - np.log(np.exp(s - s.max()).sum()) - s.max()) / np.log(10)

    memo = {}

    def score(text):
        one, two, total = 0, 0, 0.0
        for w in [*split(text), None]:
            cls, ctx = classes(w) if w is not None else (lm.END, 0)
            if (one, two, cls) not in memo:
                memo[one, two, cls] = log_p(one, two, cls)
            total += memo[one, two, cls]
            if lm.OWN <= cls < lm.END:
                total += math.log10(counts[w] + 0.1) - math.log10(mass[cls])
            one, two = ctx, one
        return total

    want = Counter((i, round(score(t), 4)) for i, t, *_ in rows)
    assert Counter((i, round(s, 4)) for i, s, _, _ in got) == want
    assert sum(s for i, s, b, h in got if h) > sum(b for i, s, b, h in got if h)


def test_steps_grow_with_the_corpus():
    from corvane.llm.lmscore import STEPS, UNIT, training_steps

    assert training_steps(1000) == STEPS and training_steps(8 * UNIT) == 2 * STEPS and training_steps(1000 * UNIT) == 10 * STEPS


def test_lm_scores(docs, empty):
    from corvane.llm.lmscore import LogBilinear, score_texts

    counts = Counter()
    rows = texts(docs)
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    for i, x in rows:
        if not held(i):
            counts.update([*words(x), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, x in rows:
        t = [*words(x), None]
        want[(i, held(i), len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6))] += 1
    out = score_texts(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert score_texts(empty).count() == 0
    a, b, z = LogBilinear().tables()
    assert np.allclose((10 ** (a[None, :, :] + b[:, None, :] - z[:, :, None])).sum(axis=2), 1)
