"""WordPiece against the plain longest match."""

import random
import unicodedata

from corvane.functions import wordpiece as wp


def plain(word, vocabulary, unknown):
    found, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = vocabulary.get(("##" if at else "") + word[at:end])
            if piece is not None:
                found.append(piece)
                at = end
                break
        else:
            return [unknown]
    return found


def test_pieces_like_the_longest_match():
    rng = random.Random(2)
    for turn in range(60):
        letters = rng.choice(["ab", "abc", "a#", "abcdefgh"])
        pieces = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(12)} | {"##" + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 6))) for _ in range(16)} | (set(letters) if turn % 2 else set())
        vocabulary = {p: i for i, p in enumerate(["[UNK]", *sorted(pieces)])}
        matcher = wp.WordPieces(vocabulary)
        for _ in range(150):
            word = "".join(rng.choice(letters + "z" * (turn % 7 == 0)) for _ in range(rng.randrange(1, 14)))
            assert matcher[word] == plain(word, vocabulary, 0), (word, vocabulary)


def test_words_without_marks():
    for text in ("", " a  B\tḉ É̀x ", "İstanbul ÀÉÎ", "ﬁ ½ हिन्दी", "x y z"):
        marks = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) not in ("Mn", "Mc"))
        assert wp.words(text) == marks.split()


def test_long_words_and_many_of_them(monkeypatch):
    monkeypatch.setattr(wp, "REMEMBERED", 10)
    vocabulary = {"[UNK]": 0, "a": 1, "##a": 2, "##aa": 3}
    matcher = wp.WordPieces(vocabulary)
    assert matcher["a" * 200_001] == [1] + [3] * 100_000 and matcher["a" * 200_000 + "b"] == [0]
    assert [matcher["a" * n] for n in range(1, 40)] == [plain("a" * n, vocabulary, 0) for n in range(1, 40)] and len(matcher) <= 11


def test_intents_like_the_plain_rules(spark):
    from corvane.operators.search import parse_intent, parse_intents

    rng = random.Random(4)
    names = ["Finance", "Career", "Identity", "Photos", "Education", "Tax", "Pan Card", "École", "Finances", "Trip 2023"]
    queries = ["", "find my Finanse documents related to tax 2023", "show FINANCES", "tax txa", "ecole école 1999-1-1 2001", "find show me search for", None]
    for _ in range(150):
        word = rng.choice(names).lower()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word = word[:at] + rng.choice(["", "x", "q"]) + word[at + rng.randrange(2) :]
        queries.append(f"{rng.choice(['Show me', 'find', '', 'my'])} {word} {rng.choice(['2023', '1999-12-1', '', '20234'])} {rng.choice(names)}")
    frame = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    albums = spark.createDataFrame([(n,) for n in [*names, "Finance", None]], "name string")
    got = {r["query_id"]: (r["album"], r["dates"], r["text"]) for r in parse_intents(frame, albums).collect()}
    for i, q in enumerate(queries):
        if q is not None:
            want = parse_intent(q, names)
            assert got[i] == (want["album"], want["dates"], want["text"]), q
    assert len(got) == len(queries)


def test_spells(spark):
    from datetime import datetime, timedelta

    from corvane.streaming.jobs import spells

    rng, start = random.Random(6), datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "b", "", None]), start + timedelta(seconds=rng.randrange(5000))) for i in range(400)] + [(900, "a", None), (901, "c", start), (902, "c", start)]
    got = {r["id"]: (r["since"], r["ready"]) for r in spells(spark.createDataFrame(rows, "id long, k string, at timestamp"), "k", "at", "id", 600).collect()}
    for key in {r[1] for r in rows}:
        last = None
        for i, _, at in sorted((r for r in rows if r[1] == key and r[2]), key=lambda r: (r[2], r[0])):
            ready = last is None or (at - last).total_seconds() >= 600
            last = at if ready else last
            assert got[i] == (last, ready)
    assert got[900] == (None, False)
