"""Matches and tags made in maps against the same by joins."""

import random

from pyspark.sql import functions as F

from corvane.functions import lexicon as lx
from corvane.functions import text as tx
from corvane.operators import tags as tg

SF = "/root/testdata/sf0.001"


def texts(spark, n=150):
    rng = random.Random(11)
    terms = [t for *_, t, _ in lx.LEXICON] + ["pan", "card", "bank", "offers", "letters", "performance", "reviews", "the", "tax.ab", "c++", "x", "été", "2023-1-5", "1/2/1999", "in 2024", "İnvoice", "INVOICE", "statementss", "socia"]
    rows = []
    for i in range(n):
        words = [rng.choice(terms) for _ in range(rng.choice([0, 1, 2, 12, 60]))]
        words = [w[: len(w) - rng.randrange(4)] if rng.random() < 0.3 else w + rng.choice(["", "s", "ing", "ings", "xyzz"]) for w in words]
        rows.append((i, rng.choice([" ", "  ", "-", " the "]).join(words)))
    return spark.createDataFrame([*rows, (900, None), (901, ""), (902, "tax " * 50_000)], "file_id long, body string")


def test_hits_like_the_join(spark):
    from corvane.operators.classify import term_hits

    files = texts(spark)
    toks = files.select("file_id", tx.tokens(F.col("body")).alias("toks"))
    every = toks.select("file_id", F.explode(F.concat("toks", tx.bigrams(F.col("toks")))).alias("gram")).distinct()
    slow = every.crossJoin(lx.lexicon_frame(spark)).where(lx.term_matches(F.col("term"), F.col("gram"))).select("file_id", "cat_ord", "category", "term_ord", "term", "weight").distinct()
    assert sorted(map(tuple, term_hits(files, F.col("body")).collect())) == sorted(map(tuple, slow.collect()))


def test_tags_like_the_joins(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.col("text").alias("body"))
    for files, sample in ((texts(spark), docs), (docs, docs.where("file_id % 3 = 0")), (docs, docs.where("false"))):
        fast = tg.extract_tags(files, F.col("body"), sample, F.col("body"))
        slow = tg.extract_tags(files, F.col("body"), sample, F.col("body"), few=-1)
        assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))


def test_tag_query_like_its_sql_on_texts_with_dates(spark, tmp_path):
    import __spark_entry__
    import duckdb

    words = ["", "2058", "invoice 2058", "in 1902 a parcel", "2023-1-5 parcel parcel", "due 1/2/1999: résumé", "the"]
    rows = [(i, w, "en", "web", len(w or "")) for i, w in enumerate([*words, None])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()["ker09_tags"](spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(db.execute(__spark_entry__.oracle_sql()["ker09_tags"]).fetchall())


def test_tags_without_spans_like_the_joins(spark):
    files = texts(spark)
    fast, slow = (tg.extract_tags(files, F.col("body"), files, F.col("body"), few=few, spans=False).collect() for few in (tg.FEW_TERMS, -1))
    assert sorted(map(tuple, fast)) == sorted(map(tuple, slow))
    assert not any(r["tag"].startswith(("date:", "year:")) for r in fast)
    assert any(r["tag"].startswith("year:") for r in tg.extract_tags(files, F.col("body"), files, F.col("body")).collect())


def test_mean_vectors_and_cohesion_like_plain_sums(spark, monkeypatch):
    import numpy as np

    from corvane.operators import cluster as cu

    monkeypatch.setattr(cu, "GROUPS", 3)
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, 4, None]), [rng.uniform(-1, 1) for _ in range(4)]) for _ in range(200)]
    rows += [(8, [1.0, 0.0, 0.0, 0.0]), (9, [1.0, 2.0]), (9, [1.0]), (10, []), (11, None), (4, None), (12, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "g int, vector array<float>").repartition(5)
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    means = {r["g"]: (r["n"], r["centroid"]) for r in cu.mean_vectors(frame, "g").collect()}
    assert {g: n for g, (n, _) in means.items()} == {g: len(v) for g, v in by.items()}
    cohesion = {r["g"]: r["cohesion"] for r in cu.cohesion(frame, "g").collect()}
    for g, vs in by.items():
        known = [np.array(v, np.float32).astype(float) for v in vs if v is not None]
        if len({len(v) for v in known}) == 1 and len(known[0]):
            total = sum(known)
            assert np.allclose(means[g][1], total / (np.linalg.norm(total) or 1), atol=1e-12)
            if len(known) == len(vs) > 1:
                pairs = [float(a @ b) for i, a in enumerate(known) for b in known[:i]]
                assert abs(cohesion[g] - sum(pairs) / len(pairs)) < 2e-6
        else:
            assert means[g][1] is None
    assert cohesion[8] == 0.0 and 10 not in cohesion and 11 not in cohesion


def test_parents_of_clusters_like_one_text(spark):
    from corvane.operators import cluster as cu
    from corvane.operators.classify import predict_category
    from corvane.schema import ALBUMS

    rng = random.Random(12)
    names = ["offer", "letter.pdf", "bank_", "statement", "the", "", "tax", "pan", "card 2", "salary", "slip of", "course", "lab", "social", "security"]
    rows = [(rng.randrange(12), i, rng.choice(names)) for i in range(60)] + [(50, 900, None), (51, 901, "")]
    members = spark.createDataFrame(rows, "cluster long, file_id long, display_name string").repartition(4)
    albums = spark.createDataFrame([(i, n, None, "PREDEFINED", None, False, None, None, None) for i, n in enumerate(["Finance", "Career", "Education", "Identity"])], ALBUMS)
    texts = {}
    for c, _, name in sorted(rows, key=lambda r: r[1]):
        texts.setdefault(c, []).append(name)
    joined = spark.createDataFrame([(c, "\n".join(n for n in ns if n is not None)) for c, ns in texts.items()], "file_id long, names string")
    ids = {"Finance": 0, "Career": 1, "Education": 2, "Identity": 3, None: None}
    want = {r["file_id"]: ids[r["category"]] for r in predict_category(joined, F.col("names")).collect()}
    assert {r["cluster"]: r["parent_album_id"] for r in cu.parent_albums(members, albums).collect()} == want and len(set(want.values())) > 2
