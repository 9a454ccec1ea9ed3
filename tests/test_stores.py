"""The directory walk and the stored indexes against plain versions."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import postings as po
from corvane.operators import search as se
from corvane.operators import vectorindex as vi
from corvane.sources import discovery as di

# --- the walk ------------------------------------------------------------------------------------


def tree(root, names):
    for name in names:
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"12345")


def found(df, root):
    return {r["uri"].split(str(root) + "/", 1)[1]: r["depth"] for r in df.collect()}


def test_walk_shows_files_of_any_name_and_enters_no_hidden_folder(spark, tmp_path):
    names = ["docs/a.txt", "docs/_draft.txt", "docs/.env", "_archive/d.txt", ".git/x", "docs/.cache/y", "docs/.thumbnails/z", "a b%20ü/c=d/?e.txt", "top", "_SUCCESS", "deep/1/2/3/4/f"]
    root = tmp_path / "tree"
    tree(root, names)
    os.symlink(root / "nowhere", root / "docs/broken")
    (root / "empty").mkdir()
    expected = {n: n.count("/") for n in names if not n.startswith((".git", "docs/.cache", "docs/.thumbnails"))}
    assert found(di.walk_tree(spark, str(root)), root) == expected
    assert found(di.walk_tree(spark, f"file://{root}/", 2), root) == {n: d for n, d in expected.items() if d <= 2}
    assert set(found(di.walk_tree(spark, str(root), 0), root)) == {"top", "_SUCCESS"}
    assert di.walk_tree(spark, str(root / ".git")).count() == 0 and di.walk_tree(spark, str(tmp_path / "none")).count() == 0


def test_hidden_trees_are_never_listed(spark, tmp_path):
    root = tmp_path / "tree"
    tree(root, ["a/x", ".hidden/b/y", "c/.thumbnails/d/z"])

    def guarded(folder):
        assert ".hidden" not in folder and ".thumbnails" not in folder, folder
        return di.list_folder(folder)

    assert set(found(di.walk_tree(spark, str(root), lister=guarded), root)) == {"a/x"}


def test_walk_of_many_folders(spark, tmp_path):
    root = tmp_path / "tree"
    names = [f"d{i % 40}/e{i % 7}/f{i}" for i in range(600)]
    tree(root, names)
    rows = di.walk_tree(spark, str(root))
    assert found(rows, root) == {n: 2 for n in names}
    (one,) = rows.where("display_name = 'f5'").collect()
    assert one["size_bytes"] == 5 and abs(one["date_modified_source"] - os.stat(root / names[5]).st_mtime * 1000) < 2


# --- words ---------------------------------------------------------------------------------------

WORDS = ["alpha", "alps", "beta", "été", "x1", "the", "of", "Beta"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = [(i * 37 - 500, rng.choice(["The-Alpha_of.txt", "beta.PDF", None, ""]) and f"{rng.choice(WORDS)}_{i}.{rng.choice(WORDS)}", " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 2, 9, 40])))) for i in range(n)]
    return [*rows, (9_000_000_000, "far Away", None), (None, "no id alpha", "alpha"), (rows[0][0], rows[0][1], rows[0][2]), (7, None, "the " * 9000 + "end of")]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(corpus(300, 3), "file_id long, display_name string, extracted_text string").repartition(4).cache()


@pytest.fixture(scope="module")
def text_index(spark, files, tmp_path_factory):
    return po.TextIndex(spark, str(tmp_path_factory.mktemp("words") / "i")).write(files)


@pytest.mark.parametrize(
    "query",
    ["alpha", "alpha beta", "ALPHA OR été", '"the of"', '"of the alpha"', "al*", "name:al*", "text:beta name:x1", '"the al*"', 'text:"beta beta"', "alpha nothing", "zzz", "", "tags:alpha", '"end of" OR far', "name:the OR name:pdf text:of*", '"the the the the"'],
)
def test_match_like_the_plain_index(files, text_index, query):
    plain = se.match(se.inverted_index(files.where("file_id is not null")), query)
    got = sorted(r["file_id"] for r in text_index.match(query).collect())
    assert got == sorted(r["file_id"] for r in plain.collect())


def test_keyword_scores_like_the_plain_index(spark, files, text_index):
    queries = spark.createDataFrame([(1, "alpha the Alpha zzz"), (2, ""), (3, "far of"), (4, None)], "query_id long, query string")
    plain = se.keyword_scores(se.inverted_index(files.where("file_id is not null")), queries)
    assert sorted(map(tuple, text_index.keyword_scores(queries).collect())) == sorted(map(tuple, plain.collect()))
    best = plain.where("query_id = 1").orderBy(F.desc("keyword"), "file_id").limit(9).select("file_id", "keyword").collect()
    assert text_index.search("alpha the Alpha zzz", 9).collect() == best
    assert text_index.search("", 5).count() == 0


def test_empty_index(spark, files, tmp_path):
    none = files.where("false")
    index = po.TextIndex(spark, str(tmp_path / "w")).write(none)
    assert index.match("alpha").count() == 0 and index.search("alpha").count() == 0
    names = po.NameIndex(spark, str(tmp_path / "n")).write(none)
    assert names.search("a").count() == 0 and names.search("").count() == 0


def test_index_is_smaller_than_half_the_text(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("file_id"), F.lit("n").alias("display_name"), F.col("text").alias("extracted_text"))
    po.TextIndex(spark, str(tmp_path / "i")).write(docs)
    size = sum(p.stat().st_size for p in (tmp_path / "i").rglob("*.parquet"))
    assert size < 0.5 * docs.agg(F.sum(F.octet_length("extracted_text"))).first()[0]


# --- names ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def name_index(spark, files, tmp_path_factory):
    return po.NameIndex(spark, str(tmp_path_factory.mktemp("names") / "i")).write(files)


@pytest.mark.parametrize("term", ["alp", "ALPHA_1", "a", "_1", "1.b", "%", "", "_", "lph%5", "é", "ÉT", "té_", ".x1", "nothing here", "alpha_12.beta", "a%a%a", "__________________", "ar aw", "\\", "%é%", "abcd"])
def test_substrings_like_a_scan(files, name_index, term):
    plain = files.where("file_id is not null and display_name is not null").where(F.translate("display_name", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").like("%" + po._lower(term).replace("\\", "\\\\") + "%"))
    assert sorted(map(tuple, name_index.search(term).collect())) == sorted(map(tuple, plain.select("file_id", "display_name").collect()))


def test_many_substrings_at_once(spark, files, name_index):
    terms = ["alp", "ALPHA_1", "été", "abcd", "beta_", "1.the", "lphalph", "far", "far away", "a.a"]
    asked = spark.createDataFrame(list(enumerate(terms)), "term_id int, term string")
    names = {r["file_id"]: r["display_name"] for r in files.where("file_id is not null and display_name is not null").collect()}
    expected = sorted((t, i) for t, term in enumerate(terms) for i, name in names.items() if po._lower(term) in po._lower(name))
    assert sorted(map(tuple, name_index.search_all(asked).collect())) == expected


# --- vectors -------------------------------------------------------------------------------------


def brute(rows, queries, k, exclude_self, floor):
    out = []
    d = max(len(v or []) for _, v in rows)
    pad = lambda v: np.pad(np.array(v or [], np.float64).astype(np.float32).astype(np.float64), (0, d))[:d]
    for q, vector in queries:
        scores = [(round(float(np.pad(np.array(vector, float), (0, d))[:d] @ pad(v)), 6), i) for i, v in rows if not (exclude_self and i == q)]
        scores = [s for s in scores if floor is None or s[0] >= floor]
        out += [(q, r, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["grouped", "spread", "ties"])
def test_nearest_like_brute_force(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(vi, "CELL", 40)
    monkeypatch.setattr(vi, "ROW_GROUP", 1 << 10)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    x = {"grouped": centres[rng.integers(0, 12, 900)] + 0.15 * rng.standard_normal((900, 16)), "spread": rng.standard_normal((600, 16)), "ties": np.repeat(rng.standard_normal((6, 16)), 60, axis=0)}[kind]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, []), (5002, x[3][:5].tolist())]
    index = vi.VectorIndex(spark, str(tmp_path / "i")).write(spark.createDataFrame(rows, "file_id long, vector array<float>"))
    queries = [(i, x[i].tolist()) for i in (0, 7, 300)] + [(-1, [0.0] * 16), (-2, (5 * rng.standard_normal(16)).tolist())]
    for k, own, floor in ((5, True, None), (1, False, None), (40, True, 0.2), (3000, True, None)):
        got = sorted((r["query_id"], r["rank"], r["file_id"], round(r["score"], 6)) for r in index.search(queries, k, own, floor).collect())
        want = brute(rows, queries, k, own, floor)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want))
        assert sum(g[2] != w[2] for g, w in zip(got, want)) <= 0.01 * len(want)  # products a rounding apart


def test_one_search_reads_a_part_of_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vi, "CELL", 40)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 24)) * 3
    x = centres[rng.integers(0, 30, 3000)] + 0.2 * rng.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = vi.VectorIndex(spark, str(tmp_path / "i")).write(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "file_id long, vector array<float>"))
    numbers, centroids, radii, sizes = index.cells()
    read = []
    products = index._products

    def counted(cells, *rest):
        read.append(int(sizes[np.isin(numbers, cells)].sum()))
        return products(cells, *rest)

    monkeypatch.setattr(index, "_products", counted)
    assert index.search([(4, x[4].tolist())], 10).count() == 10
    assert sum(read) < 600


def test_empty_vector_index(spark, tmp_path):
    index = vi.VectorIndex(spark, str(tmp_path / "i")).write(spark.createDataFrame([], "file_id long, vector array<float>"))
    assert index.search([(1, [1.0, 2.0])], 3).count() == 0
    one = vi.VectorIndex(spark, str(tmp_path / "j")).write(spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 1.0])], "file_id long, vector array<float>"))
    assert [tuple(r) for r in one.search([(1, [2.0, 0.0]), (2, [2.0, 0.0])], 3).collect()] == [(2, 1, 1, 2.0)] and one.search([], 3).count() == 0


# --- hashes --------------------------------------------------------------------------------------


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def close(hashes, distance):
    """Pairs of class representatives by brute force."""
    first = {}
    for i, h in sorted(hashes, key=lambda x: x[0]):
        if h is not None:
            first.setdefault(h, i)
    items = sorted((i, h) for h, i in first.items())
    return sorted((i, j, (g ^ h).bit_count()) for n, (i, g) in enumerate(items) for j, h in items[n + 1 :] if (g ^ h).bit_count() <= distance)


@pytest.mark.parametrize("kind", ["spread", "flat", "skewed"])
@pytest.mark.parametrize(("distance", "parts", "hot"), [(10, None, 4096), (10, 3, 20), (4, 4, 5), (0, None, 4096)])
def test_hashes_within_a_distance(spark, kind, distance, parts, hot):
    from corvane.operators.dedup import hamming_links, hamming_pairs

    rng = random.Random(f"{kind}{distance}")
    near = lambda h, k: h ^ sum(1 << b for b in rng.sample(range(64), k))
    if kind == "spread":
        base = [rng.getrandbits(64) for _ in range(60)]
        rows = base + [near(rng.choice(base), rng.randrange(14)) for _ in range(120)]
    elif kind == "flat":  # flat images: no bit set, or few
        rows = [near(0, rng.randrange(8)) for _ in range(60)] + [0, 0, (1 << 64) - 1, near((1 << 64) - 1, 3)]
    else:  # half of the bits never change
        rows = [(rng.getrandbits(32) << 32) | 0xF0F0F0F0 for _ in range(80)]
        rows += [near(h, 5) for h in rows[:40]]
    hashes = [*enumerate(rows), (500, None), (501, rows[0]), (502, rows[0])]
    frame = spark.createDataFrame([(i, None if h is None else signed(h)) for i, h in hashes], "file_id long, phash long")
    got = hamming_pairs(frame, distance, 5, parts, hot).collect()
    assert sorted((r["file_a"], r["file_b"], r["distance"]) for r in got) == close(hashes, distance)
    assert all(r["kind"] == ("NEAR" if r["distance"] <= 5 else "SIMILAR") for r in got)
    if parts is None and hot == 4096:
        links = {r["file_id"]: (r["class_id"], r["n_links"]) for r in hamming_links(frame, distance).collect()}
        known = [(i, h) for i, h in hashes if h is not None]
        assert links == {i: (min(j for j, g in known if g == h), sum((g ^ h).bit_count() <= distance for _, g in known) - 1) for i, h in known}


def test_more_hashes_make_longer_keys():
    from corvane.operators.dedup import cheapest_parts

    parts = [cheapest_parts(10**k, 10) for k in range(2, 13)]
    assert parts == sorted(parts, reverse=True) and parts[0] > parts[-1]
