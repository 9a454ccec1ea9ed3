"""The pair transducers against the tokenizers library, and their lookahead against longer texts."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe
from tests.llm.common import texts

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Merges(file.read())


def ids(raw):
    return list(memoryview(raw).cast("I")) if raw else []


def in_pieces(merges, text, piece):
    machine, words = bpe.Encoder(merges), bpe._Words(merges)
    machine.words = words
    return [i for at in range(0, max(len(text), 1), piece) for i in ids(machine.feed(text[at : at + piece], at + piece >= len(text)))]


def test_every_character(merges, library):
    words = bpe._Words(merges)
    for low in range(0, 0x110000, 4096):
        said = "".join(f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)}  {chr(c)} ." for c in range(low, low + 4096) if not 0xD800 <= c < 0xE000)
        found = ids(b"".join(bpe.encoded_parts(said, merges, words)))
        assert found == library.encode(said, add_special_tokens=False).ids
        assert bpe.Decoder(merges).feed(struct.pack(f"<{len(found)}I", *found), True) == said


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_pieces_of_texts(merges, library, piece):
    rng = random.Random(piece)
    for _ in range(120):
        letters = rng.choice(["ab '", "a  \n\t", "' srevtlmd", "-=_*", "1 2a", "<|endoftext|>x ", "é日本\xa0 a"])
        text = "".join(rng.choice(letters) if rng.random() < 0.97 else "<|endoftext|>" for _ in range(rng.choice([0, 5, 50, 300])))
        assert in_pieces(merges, text, piece) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 150_000 + "x", "-" * 100_000 + " " + "1" * 90_000, "ab" * 90_000 + "'s", "é" * 90_000, " " * 70_000 + "\n" + " " * 70_000, "<|endoftext|>" * 6000, "x " * 65_536 + "<|endof"])
def test_words_longer_than_a_piece(merges, library, text):
    assert ids(b"".join(bpe.encoded_parts(text, merges, bpe._Words(merges)))) == library.encode(text, add_special_tokens=False).ids


def test_memory_does_not_grow_with_a_word(merges):
    machine = bpe.Encoder(merges)
    held = []
    for _ in range(20):
        machine.feed("abcd" * 20_000)
        held.append(len(machine.held) + len(machine.window.held))
    assert max(held) <= bpe.PIECE + bpe.WINDOW + merges.lookahead + 80_000 and held[-1] <= max(held[:5])


def test_tokens_before_the_lookahead_are_final(merges):
    rng = random.Random(4)
    for _ in range(300):
        letters = rng.choice(["ab", "-", "=-", "andoresti", "0", "the ", "_."])
        whole = "".join(rng.choice(letters) for _ in range(900)).encode()
        part = whole[: rng.randrange(merges.lookahead, 900)]

        def ends(raw):
            at, out = 0, []
            for i in merges.merge(raw):
                at += len(merges.bytes[i])
                out.append((at, i))
            return out

        final = len(part) - merges.lookahead
        assert [e for e in ends(part) if e[0] <= final] == [e for e in ends(whole) if e[0] <= final]


def test_lookahead_of_a_small_list():
    # (b, c), (a, b), (x, ab): "xab" alone is one token, with "c" after it x, a, bc: c reaches back three bytes
    size = {0: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3}
    assert bpe.sufficient_lookahead([(1, 2, 4), (0, 1, 5), (3, 5, 6)], size) == 3
    assert bpe.sufficient_lookahead([(0, 1, 5), (3, 5, 6)], size) == 2
    assert bpe.sufficient_lookahead([], size) == 0


def test_other_kinds_are_an_error():
    for path in ("word_bpe_49k.json",):
        with open(public_tokenizers.path(path), encoding="utf-8") as file, pytest.raises(ValueError):
            bpe.Merges(file.read())


def test_cases(spark, docs, empty, library):
    rows = [(1, None), (2, ""), (3, "a <|endoftext|> b"), (3, "a <|endoftext|> b"), (None, "null id"), (5, "word " * 60_000), (6, "q" * 1_200_000), (7, "\x00￿\U0001f600")]
    extra = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit(9), "ids": F.lit("x"), "decoded": F.lit("y")})
    for frame in (docs, extra):
        found = sorted(map(tuple, bpe.round_trips(frame).collect()), key=str)
        expected = []
        for doc_id, text in texts(frame):
            i = library.encode(text or "", add_special_tokens=False).ids
            back = library.decode(i, skip_special_tokens=False)
            assert back == (text or "")
            expected.append((doc_id, len(i), hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert found == sorted(expected, key=str)
    assert bpe.round_trips(empty).count() == 0 and bpe.encode(empty).count() == 0


def test_ids_in_parts_and_back(spark, library):
    frame = spark.createDataFrame([(1, "one two"), (2, None), (3, "a b " * 50_000)], "doc_id long, text string")
    parts = bpe.encode(frame)
    got = {}
    for r in sorted(parts.collect(), key=lambda r: (r["doc_id"], r["part"])):
        got.setdefault(r["doc_id"], []).append(r["ids"])
    for doc_id, text in texts(frame):
        assert sum(got[doc_id], []) == library.encode(text or "", add_special_tokens=False).ids
        assert all(len(p) <= bpe.PART for p in got[doc_id])
    assert len(got[3]) > 1 and got[2] == [[]]
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(parts.where("doc_id < 3")).collect()}
    assert back == {1: "one two", 2: ""}
    odd = spark.createDataFrame([([50_256, 999_999, -1, 447],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(odd).collect()] == ["<|endoftext|>" + library.decode([447]), None]
