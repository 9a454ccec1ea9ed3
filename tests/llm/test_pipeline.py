"""Every stage of the pipeline against a plain version of what it decides; nulls, ties, clashing columns, empty tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.common import DOCS, components, corpus, shingles
from tests.llm.test_decontamination import leaked


STAGED = "doc_id long, text string, lang string, source string, n_chars long, mixed_id string, score int"


def rows():
    rng = random.Random(12)
    words = {"en": [f"the{i}" for i in range(80)] + ["of", "and", "was"], "fr": [f"être{i}" for i in range(80)] + ["le", "la", "des"]}
    out = []
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        text = " ".join(rng.choice(words[lang]) for _ in range(rng.choice([12, 60, 150])))
        if i % 8 == 3:
            text = out[-1][1]  # an exact copy
        if i % 8 == 6 and len(out[-1][1].split()) > 100:
            text = out[-1][1] + " changed end"
        out.append((i, text, lang, "abc"[i % 3] if i % 7 else None, len(text), "x", 5))
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30))
    out += [(200, "the1 the2 of " + item + " and the3", "en", "a", 1, "x", 5), (201, None, None, None, None, None, None), (202, "", "en", "a", 0, "x", 5), (203, "12 34 !!", "en", "b", 8, "x", 5), (4, out[4][1], "en", "a", 1, "x", 5)]
    return out, item


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What each stage got and gave."""
    import corpus_pipeline

    folder = str(tmp_path_factory.mktemp("stages"))
    listed, item = rows()
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(listed, STAGED)
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs.write.parquet(f"{folder}/{k}")
        docs = stage(spark, spark.read.parquet(f"{folder}/{k}"), folder)
        seen.append([tuple(r) for r in spark.read.parquet(f"{folder}/{k}").collect()])
    seen.append([r.asDict() for r in docs.collect()])
    return seen, item


def test_language_stage(staged):
    """Texts without letters go, all others have letters of a learned language and stay as they are."""
    before, after = staged[0][0], staged[0][1]
    assert Counter(after) == Counter(r for r in before if any(c.isalpha() for c in r[1] or ""))


def test_near_duplicate_stage(staged):
    before, after = staged[0][1], staged[0][2]
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(len(t.split()) - 4, 1))}
    sets = {r[0]: shingles(r[1].lower()) for r in before}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = components(links, sets)
    assert len(links) > 5 and Counter(r[0] for r in after) == Counter({i: 1 for i in sets if root[i] == i}) and set(after) <= set(before)


def test_decontamination_stage(staged):
    before, after = staged[0][2], staged[0][3]
    hit = {d for d, _ in leaked([(r[0], r[1]) for r in before], [(1, staged[1])])[0]}
    assert hit == {200} and Counter(after) == Counter(r for r in before if r[0] not in hit)


def test_mixing_stage(spark, staged):
    """Each document as often as the whole times that the mix takes it, or once more; sources come near their targets."""
    from corvane.llm.mixing import mix

    before, after = staged[0][3], staged[0][4]
    frame = spark.createDataFrame(before, STAGED)
    taken = {r["doc_id"]: r for r in mix(frame).collect()}
    times = Counter(r[0] for r in after)
    assert {r for r in after} <= {r for r in before} and len(taken) == len(before)
    for i, r in taken.items():
        least = r["taken"] // max(r["size"], 1)
        assert least <= times[i] <= least + (r["taken"] > least * r["size"])


def test_token_stage(staged):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = staged[0][4], staged[0][5]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(r[0], [*t.encode(r[1], add_special_tokens=False).ids, 2]) for r in before]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after) == Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    at = 0
    for r in sorted(after, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_stages_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], STAGED)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split(" ")[0] for c in STAGED.split(", ")] and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_null_ids_through_the_stages(spark, tmp_path):
    """Rows without an id are neither linked nor found, share one multiple in the mix, and are written like others."""
    import corpus_pipeline

    text = " ".join(f"word{'abcdefghij'[i % 10]}{'klmno'[i % 5]}" for i in range(40))
    docs = spark.createDataFrame([(None, text, "en", "a", 1, "x", 5), (None, text, "en", "a", 1, "x", 5), (1, text, "en", "a", 1, "x", 5), (2, text + " more", "en", None, 1, "x", 5)], STAGED)
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "None", "None"]
    clean = corpus_pipeline.decontamination_stage(spark, near, str(tmp_path))
    assert [r["doc_id"] for r in clean.collect()] == [None, None]
    mixed = corpus_pipeline.mixing_stage(spark, clean, str(tmp_path))
    assert mixed.count() in (2, 4) and mixed.columns == docs.columns
    assert corpus_pipeline.token_stage(spark, mixed, str(tmp_path)).count() == mixed.count()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(corpus(), DOCS)
    rng = random.Random(4)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30))
    docs = docs.unionByName(spark.createDataFrame([(500, "the of and " + item, "en", "s0", 9)], DOCS))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = Counter(r["doc_id"] for r in docs.collect())
    lang, near, clean, mixed, last = seen.values()
    assert not {100, 101, 102, 103} & set(lang) and max(near.values()) == 1 and 500 in near and 500 not in clean and mixed == last and set(mixed) <= set(clean)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sum(last.values())
