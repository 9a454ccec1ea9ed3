"""Language identification."""

import random
from collections import Counter

import numpy as np


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


def test_languages_against_plain_profiles(spark):
    """The same languages and scores as profiles and out-of-place distances counted one by one."""
    from corvane.llm.language import identify, train_profiles

    def grams(text):
        letters = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "")
        runs, c = letters, Counter()
        out, last = [], " "
        for x in runs:
            if x != " " or last != " ":
                out.append(x)
            last = x
        if out and runs[0] == " " and out[0] != " ":
            pass
        s = "".join(out)
        for i, x in enumerate(s):
            if x != " ":
                c[x] += 1
            if i + 1 < len(s):
                c[s[i : i + 2]] += 1
            if i + 2 < len(s) and s[i + 1] != " ":
                c[s[i : i + 3]] += 1
        return c

    rows = labelled()
    k = 40
    by_lang = {}
    for _, t, lang, *_ in rows:
        if lang is not None and t is not None:
            by_lang.setdefault(lang, Counter()).update(grams(t))
    profiles = {lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k])} for lang, c in by_lang.items()}
    frame = spark.createDataFrame(rows, LABELLED)
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in identify(frame, train_profiles(frame, k=k), k=k).collect()}
    agree = 0
    for i, t, *_ in rows:
        c = grams(t)
        ranked = [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].replace(" ", "\0")))[:k]]
        if not ranked:
            assert got[i, t] == ("und", 0.0)
            continue
        distance = {lang: sum(abs(p[g] - n) if g in p else k for n, g in enumerate(ranked)) for lang, p in profiles.items()}
        best = min(sorted(distance), key=lambda x: distance[x])
        agree += got[i, t][0] == best and abs(got[i, t][1] - (1 - distance[best] / (k * len(ranked)))) < 0.02
    assert agree >= 0.97 * sum(bool(grams(t)) for _, t, *_ in rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    """The same profiles and predictions whether texts are counted whole or in pieces of a few bytes."""
    from corvane.llm import language

    rows = labelled(40) + [(600, " 12 \u00e9t\u00e9 " * 30 + "x", "fr", None, 1), (601, "\u4e2d\u6587" * 50, "zh", None, 1), (602, " . , ; 1234 " * 20, "en", None, 1), (603, "a b " * 40 + "\u00df", "de", None, 1)]
    frame = spark.createDataFrame(rows, LABELLED)
    both = []
    for long, piece in ((1 << 30, 1 << 20), (3, 7)):
        batch = [np.frombuffer((t or "").encode(), np.uint8) for _, t, *_ in rows]
        monkeypatch.setattr(language, "LONG", long)
        monkeypatch.setattr(language, "PIECE", piece)
        counts = []
        for data in batch:
            if long == 3:
                counts.append(language._long_counts(data))
            else:
                symbols, owner, alphabet = language._symbols(data, np.array([0, len(data)]))
                keys, n = np.unique(language._grams(symbols, owner, len(alphabet))[0], return_counts=True)
                counts.append({language._text_of(k, alphabet): c for k, c in zip(keys.tolist(), n.tolist())})
        both.append(counts)
    assert both[0] == both[1]
    profiles = [(r["lang"], r["gram"], r["rank"]) for r in language.train_profiles(frame, k=60).collect()]
    union = sorted({g for _, g, _ in profiles})
    names = sorted({x for x, _, _ in profiles})
    ranks = np.full((len(union) + 1, len(names)), -1)
    for lang, gram, rank in profiles:
        ranks[union.index(gram), names.index(lang)] = rank
    monkeypatch.setattr(language, "PIECE", 7)
    for data in batch:
        best, score = language._nearest(data, np.array([0, len(data)]), union, ranks, 60) if len(data) else (np.array([-1]), np.array([0.0]))
        assert language._nearest_of_long(data, union, ranks, 60) == (best[0], score[0])


def test_language(docs, empty):
    from corvane.llm.language import identify, train_profiles

    got = identify(docs, train_profiles(docs)).collect()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    told = [r for r in got if r["lang"] and len(r["text"] or "") > 60]
    assert sum(r["lang"] == r["lang_pred"] for r in told) >= 0.9 * len(told)
    assert {r["lang_pred"] for r in identify(docs, train_profiles(empty)).collect()} == {"und"} and identify(empty, train_profiles(empty)).count() == 0
