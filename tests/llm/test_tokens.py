"""Token ids where less than the whole job once passed unnoticed."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.common import texts


def test_encoder_parts_are_exact_around_wide_spaces():
    """A space beside white space of any script is no place to cut."""
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from corvane.llm.kernel import text_buffer
    from corvane.llm.tokenstore import Encoder, load_tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    rng = random.Random(5)
    wide = "\u0085\u00a0\u1680\u180e\u2028\u2029\u202f\u205f\u3000\u200b\ufeff\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    samples = ["\u0020\u00a0\u0020\u00a0", "price:\u00a0 \u00a0 \u00a0 \u00a010"]
    alphabets = ("ab " + "\u00a0", "aé.,1" + wide + " " * 12, "a  " + wide)
    samples += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for letters in alphabets for _ in range(4000)]
    data, offsets = text_buffer(pa.array(samples))
    ids, bounds = Encoder(load_tokenizer(path)).encode(data, offsets)
    whole = Tokenizer.from_file(path)
    wrong = [s for i, s in enumerate(samples) if ids[bounds[i] : bounds[i + 1]].tolist() != whole.encode(s, add_special_tokens=False).ids + [2]]
    assert not wrong, wrong[:5]


def test_lost_recipe_is_noticed(spark):
    """Reading fails where a shard's recipes are not those of its manifest."""
    import public_tokenizers
    import pytest

    from corvane.llm.tokenstore import check_manifests, token_output, write_store
    from corvane.runtime import Workspace

    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    assert token_output(docs).count() == 20
    for name, change in (("lost", lambda r: r.where("doc_id != 7")), ("doubled", lambda r: r.unionByName(r.where("doc_id = 7"))), ("none", lambda r: r.limit(0))):
        work = Workspace(spark, f"manifest-{name}")
        write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), work)
        check_manifests(work)
        rows = spark.read.parquet(work.path("index"))
        work.write(change(rows.where("kind = 'recipe'")).unionByName(rows.where("kind = 'manifest'")), "changed")
        work.drop("index")
        work.read("changed").write.partitionBy("kind").parquet(work.path("index"))
        with pytest.raises(ValueError):
            check_manifests(work)


def test_tokens_round_trip(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from corvane.llm.tokenstore import read_ids, token_output, verify_manifests, write_store
    from corvane.runtime import Workspace

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    work = Workspace(spark, "test-tokens")
    write_store(docs, path, work)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in read_ids(work, False).collect())
    assert got == Counter((i, (*t.encode(x or "", add_special_tokens=False).ids, 2)) for i, x in texts(docs))
    assert all(r["ok"] for r in verify_manifests(work).collect())
    at = 0
    for r in token_output(docs).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect():
        assert r["start"] == at
        at += r["n_tokens"]
    crcs = Counter((r["doc_id"], r["ids_crc32"]) for r in token_output(docs).collect())
    assert crcs == Counter((i, zlib.crc32(np.array(ids, "<u4").tobytes())) for (i, ids), n in got.items() for _ in range(n))
    assert token_output(empty).count() == 0


def test_encoder_parts_are_exact():
    import public_tokenizers
    from tokenizers import Tokenizer

    from corvane.llm.tokenstore import Encoder, load_tokenizer
    from corvane.llm.kernel import text_buffer
    import pyarrow as pa

    path = public_tokenizers.path("byte_bpe_50k.json")
    samples = ["it's  a test., of: x  y\n\n z", " lead", "tail ", "a  b", "été. fin, ok", "<|endoftext|> in text", "12.5,000 x.y", "\t tab \x7f del ", "a　 b 　c", "don't.Stop, 's"]
    data, offsets = text_buffer(pa.array(samples))
    ids, bounds = Encoder(load_tokenizer(path)).encode(data, offsets)
    t = Tokenizer.from_file(path)
    for i, s in enumerate(samples):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == t.encode(s, add_special_tokens=False).ids + [2], s


def test_damaged_chunk_is_noticed(spark):
    from corvane.llm.tokenstore import _address, merkle_root

    assert merkle_root([b"a", b"b"]) != merkle_root([b"b", b"a"]) and _address(b"x") != _address(b"y")


def test_very_long_and_clashing(spark):
    """Texts of over a megabyte, one of them a single word, beside columns named like results."""
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from corvane.llm.tokenstore import token_output

    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeé.,") for _ in range(rng.randint(1, 9))) for _ in range(200_000)), "q" * 30_000, None, "", "tail "]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, start string, n int")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in token_output(frame).collect():
        ids = [*t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_other_tokenizers_are_read_whole():
    """Only byte-level files whose parts encode like the whole are cut."""
    import json

    from corvane.llm.tokenstore import _cuts_alike

    plain = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "normalizer": None, "added_tokens": [{"content": "<|end|>"}]}
    assert _cuts_alike(json.dumps(plain))
    for change in ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "NFC"}}, {"added_tokens": [{"content": "a b"}]}, {"added_tokens": [{"content": "x", "lstrip": True}]}, {"pre_tokenizer": None}):
        assert not _cuts_alike(json.dumps(plain | change))
