"""A small corpus with nulls, empty texts, ties, repeated rows and clashing ids, and plain helpers."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=60, seed=1):
    rng = random.Random(seed)
    words = {"en": "the of and was with that hand stone other thing under".split(), "fr": "le la des une être éaux pour ment entre ouvre".split()}
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr"])
        text = " ".join(rng.choice(words[lang]) + rng.choice(["", "s", "er", "ing"]) for _ in range(rng.choice([3, 20, 60, 120])))
        if i % 7 == 3 and rows:
            text, lang = rows[-1][1], rows[-1][2]
        if i % 11 == 5 and rows:
            text, lang = rows[-1][1] + " changed end", rows[-1][2]
        rows.append((i, text, lang, f"s{i % 3}" if i % 13 else None, len(text)))
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (102, "   \n\t", "fr", "s2", 5), (103, "12 34 !!", None, "s0", 8), (104, "é" * 40 + "word " * 900, "fr", "s0", 4540), (7, rows[7][1], rows[7][2], rows[7][3], rows[7][4]), (None, rows[9][1], "en", "s1", 3)]
    return rows


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def words(text):
    return (text or "").encode().lower().split()


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


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
