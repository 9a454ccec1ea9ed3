"""Registered text and vector functions, classification, tags, albums and related files, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.fixtures import Index
from corvane.functions import lexicon as lx
from corvane.functions import text as tx
from corvane.functions import vector as vc
from corvane.functions import wordpiece as wp
from corvane.operators import classify as cl
from corvane.operators import cluster as cu
from corvane.operators import dedup as dd
from corvane.operators import queue as qu
from corvane.operators import reads as rd
from corvane.operators import search as se
from corvane.operators import tags as tg
from corvane.plans.catalog import _CENTROIDS, _DOT, _KNN, _LEX, _PROFILES, _SCORES, _album_centroids, _hits_sql, _query_vectors
from corvane.plans.registry import NOW, query

# --- text ----------------------------------------------------------------------------------------

query(
    "txt09_title_case",
    f"WITH {_hits_sql('extracted_text')} SELECT DISTINCT file_id, term, array_to_string(list_transform(string_split(term, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM hits",
    "files",
)(lambda ix: cl.term_hits(ix.files, F.col("extracted_text")).select("file_id", "term", tx.title_case(F.col("term")).alias("title")).distinct())

# A vocabulary and the ids of a few texts, eight positions each.
_VOCABULARY = {"[PAD]": 0, "[CLS]": 101, "[SEP]": 102, "[UNK]": 100, "hello": 7592, "world": 2088, "machine": 2600, "learning": 1550, "##ing": 1089, "the": 1996, "weather": 3565, "sunn": 2827, "##y": 2243}
_CASES = {
    "hello world": "101 7592 2088 102 0 0 0 0",
    "the sunny weather": "101 1996 2827 2243 3565 102 0 0",
    "zzzzqqqqxxxx": "101 100 102 0 0 0 0 0",
    "hello world hello world hello world": "101 7592 2088 7592 2088 7592 2088 102",
    "Caf\u00e9": "101 100 102 0 0 0 0 0",
}


@query(
    "txt15_worked_token_ids",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '101 7592 2088 100 100 102 0 0' WHEN 1 THEN '101 1996 2827 2243 3565 100 100 102' WHEN 2 THEN '101 2600 1550 100 100 102 0 0' ELSE '101 7592 2088 7592 2088 7592 2088 102' END AS ids FROM part",
)
def _worked_ids(ix: Index) -> DataFrame:
    """The worked examples' words before the two words of every part's name, which have no pieces; the last ones are cut."""
    before = F.when(F.col("p_partkey") % 4 == 0, "hello world").when(F.col("p_partkey") % 4 == 1, "the sunny weather").when(F.col("p_partkey") % 4 == 2, "machine learning").otherwise("hello world hello world hello world")
    rows = ix.part.select("p_partkey", F.concat_ws(" ", before, "p_name").alias("text"))
    return rows.select("p_partkey", F.array_join(wp.wordpiece_ids(rows, "text", _VOCABULARY, 8), " ").alias("ids"))


query("txt13_normalise", "SELECT doc_id AS file_id, md5(array_to_string(list_filter(string_split_regex(strip_accents(lower(text)), '\\s+'), lambda w: w <> ''), ' ')) AS digest FROM documents")(
    lambda ix: ix.documents.select(F.col("doc_id").alias("file_id"), F.md5(F.array_join(wp.normalised(F.col("text")), " ")).alias("digest"))
)

#: A vocabulary of letters and a few longer pieces, so that ids follow from a recursive query.
_LETTERS = [chr(c) for c in range(ord("a"), ord("z") + 1) if chr(c) not in "qx"]
_LONGER = ["th", "the", "an", "re", "st", "qu", "##er", "##in", "##ing", "##th", "##qu", "##x"]
_PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *_LETTERS, *[f"##{c}" for c in _LETTERS], *_LONGER]
_PIECE_SQL = "pc(piece, id) AS (VALUES " + ", ".join(f"('{p}', {i})" for i, p in enumerate(_PIECES)) + ")"
_MOST = 24
_WORDPIECE = f"""{_PIECE_SQL},
  tx AS (SELECT doc_id AS file_id, list_filter(string_split_regex(strip_accents(lower(text)), '\\s+'), lambda w: w <> '') AS ws FROM documents),
  wd AS (SELECT DISTINCT unnest(ws) AS word FROM tx),
  gr AS (SELECT word, 0 AS done, CAST([] AS INTEGER[]) AS ids, false AS bad FROM wd
    UNION ALL SELECT word, done + coalesce(hit.len, 100000), list_append(ids, coalesce(hit.id, 1)), hit.id IS NULL
    FROM (SELECT gr.*, (SELECT max_by({{'len': length(p.body), 'id': p.id}}, length(p.body)) FROM (SELECT CASE WHEN piece LIKE '##%' THEN piece[3:] ELSE piece END AS body, piece LIKE '##%' AS inner_piece, id FROM pc WHERE piece NOT LIKE '[%') p
        WHERE p.inner_piece = (gr.done > 0) AND substr(gr.word, gr.done + 1, length(p.body)) = p.body) AS hit FROM gr WHERE done < length(word)) x),
  ok AS (SELECT word, CASE WHEN max(done) >= 100000 THEN [1] ELSE max_by(ids, done) END AS ids FROM gr GROUP BY 1),
  id AS (SELECT tx.file_id, flatten(list(ok.ids ORDER BY w.pos)) AS ids FROM tx, (SELECT file_id, unnest(ws[1:{_MOST}]) AS word, unnest(range(1, least(len(ws), {_MOST}) + 1)) AS pos FROM tx) w, ok WHERE w.file_id = tx.file_id AND ok.word = w.word GROUP BY 1),
  fin AS (SELECT tx.file_id, [2] || coalesce(ids[1:{_MOST - 2}], CAST([] AS INTEGER[])) || [3] AS ids FROM tx LEFT JOIN id ON id.file_id = tx.file_id)"""


def _token_ids(ix: Index) -> DataFrame:
    rows = ix.documents
    vocabulary = {p: i for i, p in enumerate(_PIECES)}
    return rows.select(F.col("doc_id").alias("file_id"), wp.wordpiece_ids(rows, "text", vocabulary, _MOST).alias("ids"))


query("txt14_pieces_of_words", f"WITH RECURSIVE {_WORDPIECE} SELECT word, array_to_string(ids, ' ') AS ids FROM ok")(lambda ix: _word_pieces(ix))
query("txt15_token_ids", f"WITH RECURSIVE {_WORDPIECE} SELECT file_id, array_to_string(ids || list_transform(range(len(ids), {_MOST}), lambda i: 0), ' ') AS ids FROM fin")(lambda ix: _token_ids(ix).select("file_id", F.array_join("ids", " ").alias("ids")))
query("txt16_attention_mask", f"WITH RECURSIVE {_WORDPIECE} SELECT file_id, CAST(len(ids) AS BIGINT) AS n, repeat('1', len(ids)) || repeat('0', {_MOST} - len(ids)) AS mask FROM fin")(
    lambda ix: _token_ids(ix).withColumn("m", wp.attention_mask(F.col("ids"))).select("file_id", F.aggregate("m", F.lit(0), lambda s, x: s + x).cast("long").alias("n"), F.array_join("m", "").alias("mask"))
)


def _word_pieces(ix: Index) -> DataFrame:
    words = ix.documents.select(F.explode(F.array_distinct(wp.normalised(F.col("text")))).alias("word")).distinct()
    vocabulary = {p: i for i, p in enumerate(_PIECES)}
    ids = wp.word_pieces(words, "word", vocabulary)
    return words.select("word", F.array_join(ids, " ").alias("ids"))


_ASKED = """SELECT o_orderkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN 'Show me ' WHEN 1 THEN 'find my ' ELSE '' END ||
  CASE o_orderkey % 5 WHEN 0 THEN n_name WHEN 1 THEN substr(n_name, 1, 2) || substr(n_name, 4) WHEN 2 THEN n_name || 'xs' WHEN 3 THEN substr(n_name, 2, 1) || substr(n_name, 1, 1) || substr(n_name, 3) ELSE 'papers' END ||
  ' documents related to yellow ' || substr(o_orderpriority, 3) || ' ' || CAST(1990 + o_orderkey % 45 AS STRING) || CASE o_orderkey % 2 WHEN 0 THEN '-1-12 end' ELSE ' 12345' END AS query
  FROM {orders} JOIN {nation} ON n_nationkey = o_custkey % 25"""
query(
    "txt19_query_intent",
    f"""WITH q AS ({_ASKED.replace("{", "").replace("}", "")}),
      r AS (SELECT query_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(query), '\\bdocuments related to\\b', ' ', 'g'), '\\bfind my\\b', ' ', 'g'), '\\bshow me\\b', ' ', 'g'), '\\bsearch for\\b', ' ', 'g'), '\\bshow\\b', ' ', 'g'), '\\bfind\\b', ' ', 'g') AS rest FROM q),
      w AS (SELECT query_id, array_to_string(regexp_extract_all(rest, '\\b((?:19|20)\\d{{2}}(?:-\\d{{1,2}}-\\d{{1,2}})?)\\b'), ' ') AS dates,
        list_filter(string_split_regex(regexp_replace(rest, '\\b((?:19|20)\\d{{2}}(?:-\\d{{1,2}}-\\d{{1,2}})?)\\b', ' ', 'g'), '\\s+'), lambda x: x <> '') AS words FROM r),
      e AS (SELECT query_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w),
      b AS (SELECT word, min_by(name, (levenshtein(word, lower(name)), name)) AS album FROM (SELECT DISTINCT word FROM e) d, albums WHERE levenshtein(word, lower(name)) <= least(2, length(name) // 4) GROUP BY 1),
      f AS (SELECT query_id, min(pos) AS pos, min_by(album, pos) AS album FROM e JOIN b USING (word) GROUP BY 1)
    SELECT w.query_id, f.album, w.dates, array_to_string(list_filter(words, lambda x, i: i <> coalesce(f.pos, 0)), ' ') AS text FROM w LEFT JOIN f ON f.query_id = w.query_id""",
    "albums",
)(lambda ix: se.parse_intents(ix.spark.sql(_ASKED, orders=ix.orders, nation=ix.nation), ix.albums).select("query_id", "album", F.array_join("dates", " ").alias("dates"), "text"))


# --- vectors -------------------------------------------------------------------------------------

query(
    "vec04_half_decode",
    """WITH b AS (SELECT p_partkey, p_partkey * 31 % 31744 AS bits, p_partkey % 3 = 0 AS minus FROM part)
       SELECT p_partkey, CASE WHEN minus THEN -1.0 ELSE 1.0 END * CASE WHEN bits // 1024 = 0 THEN pow(2.0, -14) * (bits % 1024) / 1024.0 ELSE pow(2.0, bits // 1024 - 15) * (1 + (bits % 1024) / 1024.0) END + 0.0 AS x, CAST(0 AS DOUBLE) AS missing FROM b""",
)(lambda ix: _half_decoded(ix))


def _half_decoded(ix: Index) -> DataFrame:
    bits = F.col("p_partkey") * 31 % 31744 + F.when(F.col("p_partkey") % 3 == 0, 32768).otherwise(0)
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    raw = ix.part.select("p_partkey", F.unhex(F.concat(byte(bits % 256), byte((bits / 256).cast("long")))).alias("raw"), F.lit(2).alias("n"))
    out = raw.select("p_partkey", vc.half_decode("raw", "n").alias("v"))
    return out.select("p_partkey", (F.col("v")[0].cast("double") + F.lit(0.0)).alias("x"), F.col("v")[1].cast("double").alias("missing"))


query(
    "vec05_sparse_cosine",
    f"""WITH {_PROFILES}, w AS (SELECT a.file_id, a.file_id + 1 AS other_id FROM files a JOIN files b ON b.file_id = a.file_id + 1),
         d AS (SELECT w.file_id, w.other_id, sum(a.tf * b.tf) AS dot FROM w JOIN pr a ON a.file_id = w.file_id JOIN pr b ON b.file_id = w.other_id AND b.term = a.term GROUP BY 1, 2)
       SELECT w.file_id, w.other_id, round(CASE WHEN d.dot > 0 THEN d.dot / (na.n * nb.n) ELSE 0.0 END, 6) AS cosine FROM w LEFT JOIN d ON d.file_id = w.file_id LEFT JOIN nm na ON na.file_id = w.file_id LEFT JOIN nm nb ON nb.file_id = w.other_id""",
    "files",
)(
    lambda ix: cl.sparse_cosines(
        ix.files.select("file_id", (F.col("file_id") + 1).alias("other_id")).join(ix.files.select(F.col("file_id").alias("other_id")), "other_id", "left_semi").select("file_id", "other_id"), cl.profiles(ix.files, F.col("extracted_text"))
    )
)
query(
    "vec06_average_hash",
    """WITH g AS (SELECT p_partkey, list_transform(range(0, 64), lambda i: p_partkey * (i * i + 7) % 64) AS v FROM part), b AS (SELECT p_partkey, list_transform(v, lambda x: CASE WHEN x >= list_sum(v) / 64.0 THEN 1 ELSE 0 END) AS b FROM g)
       SELECT p_partkey, CAST(list_sum(list_transform(range(0, 32), lambda i: b[i + 1] * CAST(pow(2, i) AS BIGINT))) AS BIGINT) AS low, CAST(list_sum(list_transform(range(0, 32), lambda i: b[i + 33] * CAST(pow(2, i) AS BIGINT))) AS BIGINT) AS high FROM b""",
)(
    lambda ix: ix.part.select("p_partkey", vc.average_hash(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (F.col("p_partkey") * (i * i + 7) % 64).cast("double"))).alias("h")).select(
        "p_partkey", F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftrightunsigned("h", 32).alias("high")
    )
)
query(
    "vec07_hamming",
    "SELECT a.file_id, CAST(bit_count(CAST(xor(a.phash, b.phash) AS HUGEINT)) AS INT) AS distance FROM hashes a JOIN hashes b ON b.file_id = a.file_id + 1",
    "hashes",
)(lambda ix: ix.hashes.alias("a").join(ix.hashes.alias("b"), F.col("b.file_id") == F.col("a.file_id") + 1).select("a.file_id", vc.hamming(F.col("a.phash"), F.col("b.phash")).alias("distance")))
query("vec09_clamp", "SELECT p_partkey, round(least(greatest((p_retailprice - 1200.0) / 500.0, 0.0), 1.0), 9) AS x FROM part")(
    lambda ix: ix.part.select("p_partkey", F.round(vc.clamp((F.col("p_retailprice") - 1200.0) / 500.0), 9).alias("x"))
)
_NEAR_SQL = "SELECT a.file_id AS file_a, b.file_id AS file_b, CAST(bit_count(CAST(xor(a.phash, b.phash) AS HUGEINT)) AS INT) AS distance, CASE WHEN bit_count(CAST(xor(a.phash, b.phash) AS HUGEINT)) <= 5 THEN 'NEAR' ELSE 'SIMILAR' END AS kind FROM mh a JOIN mh b ON a.file_id < b.file_id WHERE bit_count(CAST(xor(a.phash, b.phash) AS HUGEINT)) <= 10"
_MADE = "SELECT file_id, phash FROM hashes UNION ALL SELECT file_id + 1000000, xor(phash, CAST(pow(2, file_id % 13) - 1 AS UBIGINT)) FROM hashes WHERE file_id % 3 = 0"


def _made_hashes(ix: Index) -> DataFrame:
    """The hashes and copies of a third of them with 0 to 12 changed bits."""
    changed = F.col("phash").bitwiseXOR((F.pow(F.lit(2), F.col("file_id") % 13) - 1).cast("long"))
    return ix.hashes.unionByName(ix.hashes.where("file_id % 3 = 0").select((F.col("file_id") + 1000000).alias("file_id"), changed.alias("phash")))


query("join15_hamming", f"WITH al AS ({_MADE}), mh AS (SELECT min(file_id) AS file_id, phash FROM al GROUP BY phash) {_NEAR_SQL}", "hashes")(lambda ix: dd.hamming_pairs(_made_hashes(ix)))

query(
    "join15_hamming_links",
    f"WITH al AS ({_MADE}), c AS (SELECT phash, min(file_id) AS class_id, count(*) AS n FROM al GROUP BY phash), l AS (SELECT a.phash, a.class_id, sum(b.n) - 1 AS n_links FROM c a JOIN c b ON bit_count(CAST(xor(a.phash, b.phash) AS HUGEINT)) <= 10 GROUP BY ALL) SELECT al.file_id, l.class_id, CAST(l.n_links AS BIGINT) AS n_links FROM al JOIN l ON l.phash = al.phash",
    "hashes",
)(lambda ix: dd.hamming_links(_made_hashes(ix)))
query(
    "ker34_duplicates",
    f"""WITH RECURSIVE al AS ({_MADE}), mh AS (SELECT min(file_id) AS file_id, phash FROM al GROUP BY phash), np AS ({_NEAR_SQL}), ed AS (SELECT file_a AS a, file_b AS b FROM np UNION SELECT file_b, file_a FROM np),
          rc(a, b) AS (SELECT a, b FROM ed UNION SELECT rc.a, ed.b FROM rc JOIN ed ON ed.a = rc.b), cl AS (SELECT file_id, min(distance) AS d FROM (SELECT file_a AS file_id, distance FROM np UNION ALL SELECT file_b, distance FROM np) x GROUP BY 1),
          eg AS (SELECT sha256_hash, min(file_id) AS first FROM files WHERE NOT is_deleted GROUP BY 1 HAVING count(*) > 1)
        SELECT 'EXACT' AS group_type, eg.first AS representative_file_id, f.file_id, CAST(1 AS DOUBLE) AS similarity_score FROM files f JOIN eg ON eg.sha256_hash = f.sha256_hash WHERE NOT f.is_deleted
        UNION ALL SELECT 'PERCEPTUAL_NEAR', least(min(rc.b), rc.a), rc.a, round(1 - min(cl.d) / 64e0, 6) FROM rc JOIN cl ON cl.file_id = rc.a GROUP BY rc.a""",
    "files hashes",
)(lambda ix: dd.duplicate_groups(dd.exact_groups(ix.files), dd.hamming_pairs(_made_hashes(ix)), ix.files))

query(
    "ker34_near_with_copies",
    f"""WITH RECURSIVE al AS ({_MADE}), ed AS (SELECT a.file_id AS a, b.file_id AS b, bit_count(CAST(xor(a.phash, b.phash) AS HUGEINT)) AS d FROM al a JOIN al b ON a.file_id <> b.file_id AND bit_count(CAST(xor(a.phash, b.phash) AS HUGEINT)) <= 10),
          rc(a, b) AS (SELECT DISTINCT a, b FROM ed UNION SELECT rc.a, ed.b FROM rc JOIN ed ON ed.a = rc.b)
        SELECT least(min(rc.b), rc.a) AS group_id, rc.a AS file_id FROM rc GROUP BY rc.a""",
    "hashes",
)(lambda ix: dd.group_members(dd.with_copies(dd.hamming_pairs(_made_hashes(ix)), _made_hashes(ix))).select("group_id", "file_id"))

# --- classification ------------------------------------------------------------------------------

query("agg21_best_category", f"WITH {_hits_sql('extracted_text')}, {_SCORES} SELECT file_id, category, score FROM best WHERE r = 1", "files")(
    lambda ix: cl.best_category(cl.category_scores(ix.files, F.col("extracted_text"))).select("file_id", "category", "score")
)
query(
    "ker03_result",
    f"""WITH {_hits_sql("extracted_text")}, {_SCORES} SELECT f.file_id, coalesce(p.score, 0.0) AS confidence, 'Matched category ' || p.category AS reason, coalesce(array_to_string(p.terms[1:5], ','), '') AS tags FROM files f LEFT JOIN pred p ON p.file_id = f.file_id""",
    "files",
)(lambda ix: cl.as_result(cl.predict_category(ix.files, F.col("extracted_text"))).select("file_id", "confidence", "reason", F.array_join("tags", ",").alias("tags")))
_EVIDENCE = "e AS (SELECT file_id, (file_id % 10) / 1e1 AS k, CASE WHEN file_id % 3 > 0 THEN (file_id % 7) / 7e0 END AS c, CASE WHEN file_id % 4 > 0 THEN (file_id % 5) / 5e0 END AS a, CASE WHEN file_id % 5 > 0 THEN (file_id % 11) / 11e0 END AS h FROM files)"
query(
    "ker04_confidence",
    f"""WITH {_EVIDENCE}, w AS (SELECT *, 0.45 + CASE WHEN c IS NULL THEN 0 ELSE 0.35 END + CASE WHEN a IS NULL THEN 0 ELSE 0.15 END + 0.05 AS w FROM e)
        SELECT file_id, round((0.45 * k + 0.35 * coalesce(c, 0) + 0.15 * coalesce(a, 0) + 0.05 * coalesce(h, 0.5)) / w, 6) AS confidence, round(CAST(w AS DOUBLE), 6) AS coverage FROM w""",
    "files",
)(lambda ix: _confidences(ix))


def _confidences(ix: Index) -> DataFrame:
    some = lambda by, value: F.when(F.col("file_id") % by > 0, value)
    id = F.col("file_id")
    score, coverage = cl.confidence(id % 10 / 10.0, some(3, id % 7 / 7.0), some(4, id % 5 / 5.0), some(5, id % 11 / 11.0))
    return ix.files.select("file_id", score.alias("confidence"), coverage.alias("coverage"))


_WANTED = "100 + file_id % 3 * 3"
query(
    "ker05_agreement",
    f"""WITH {_PROFILES}, tg AS (SELECT file_id, {_WANTED} AS wanted FROM files WHERE file_id % 2 = 0)
        SELECT cs.file_id, count(*) AS similar, count(*) FILTER (sm.primary_album_id = tg.wanted) AS agree, round(count(*) FILTER (sm.primary_album_id = tg.wanted) / CAST(count(*) AS DOUBLE), 6) AS agreement
        FROM cs JOIN sm ON sm.file_id = cs.other_id JOIN tg ON tg.file_id = cs.file_id WHERE cosine >= 0.4 GROUP BY 1""",
    "files",
)(lambda ix: cl.cluster_agreement(ix.files.where("file_id % 2 = 0").withColumn("wanted", F.expr(_WANTED)), F.col("extracted_text"), "wanted", rd.classified_profiles(ix.files, 40)))
query(
    "ker06_centroid_evidence",
    f"WITH {_CENTROIDS}, v AS (SELECT file_id, list_transform(vector, lambda x: CASE WHEN file_id % 2 = 0 THEN x ELSE -x END) AS vector FROM embs) SELECT a.file_id, round(least(greatest(max("
    + _DOT.format(a="a.vector", b="c.centroid")
    + "), 0.0), 1.0), 6) + 0.0 AS centroid_score FROM v a, ce c WHERE c.album_id % 2 = 0 GROUP BY 1",
    "embs file_album",
)(
    lambda ix: cl.centroid_evidence(ix.embs.select("file_id", F.when(F.col("file_id") % 2 == 0, F.col("vector")).otherwise(F.transform("vector", lambda x: -x)).alias("vector")), _album_centroids(ix).where("album_id % 2 = 0")).select(
        "file_id", (F.col("centroid_score") + F.lit(0.0)).alias("centroid_score")
    )
)
#: All evidence: keywords, centroids, and agreement with a sample of files that are in the albums of the categories.
_ENGINE = f"""WITH nt AS (SELECT file_id, doc_type, display_name || coalesce(chr(10) || substr(extracted_text, 1, 6000), '') AS txt FROM files), {_hits_sql("txt", "nt")}, {_SCORES}, {_CENTROIDS},
  c AS (SELECT e.file_id, round(least(greatest(max({_DOT.format(a="e.vector", b="k.centroid")}), 0.0), 1.0), 6) AS s FROM embs e, ce k GROUP BY 1), {_PROFILES},
  ag AS (SELECT cs.file_id, 201 + cs.other_id % 4 AS album, count(*) AS n FROM cs JOIN sm ON sm.file_id = cs.other_id WHERE cosine >= 0.4 GROUP BY 1, 2),
  base AS (SELECT n.file_id, n.doc_type, p.category, p.score, p.terms, a.album_id, c.s, (SELECT sum(n) FROM ag WHERE ag.file_id = n.file_id) AS sim, (SELECT sum(n) FROM ag WHERE ag.file_id = n.file_id AND ag.album = a.album_id) AS agree
    FROM nt n LEFT JOIN pred p ON p.file_id = n.file_id LEFT JOIN albums a ON a.name = p.category AND a.parent_album_id IS NULL LEFT JOIN c ON c.file_id = n.file_id),
  ev AS (SELECT *, CASE WHEN album_id IS NOT NULL AND sim > 0 THEN round(coalesce(agree, 0) / CAST(sim AS DOUBLE), 6) END AS agr FROM base),
  cf AS (SELECT *, 0.45 + CASE WHEN s IS NULL THEN 0 ELSE 0.35 END + CASE WHEN agr IS NULL THEN 0 ELSE 0.15 END + 0.05 AS w FROM ev),
  sc AS (SELECT *, least(greatest(round((0.45 * score + 0.35 * coalesce(s, 0) + 0.15 * coalesce(agr, 0) + 0.025) / w, 6), 0.0), 1.0) AS conf FROM cf),
  fin AS (SELECT file_id, CASE WHEN category IS NULL AND doc_type = 'IMAGE' THEN 205 WHEN category IS NOT NULL THEN album_id END AS album_id,
    CAST(CASE WHEN category IS NULL AND doc_type = 'IMAGE' THEN 0.9 WHEN category IS NOT NULL THEN conf ELSE 0.0 END AS DOUBLE) AS confidence,
    CASE WHEN category IS NULL AND doc_type = 'IMAGE' THEN ['Media type: image with no extractable text'] WHEN category IS NOT NULL THEN
      ['Category: ' || category] || list_transform(terms[1:5], lambda t: 'Matched term: ' || t) || ['keyword: ' || CAST(CAST(floor(score * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%']
      || CASE WHEN s IS NULL THEN [] ELSE ['centroid: ' || CAST(CAST(floor(s * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'] END || CASE WHEN agr IS NULL THEN [] ELSE ['cluster agreement: ' || CAST(CAST(floor(agr * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'] END
      || ['history prior: 50%'] || CASE WHEN w < 1 - 1e-6 THEN ['Evidence coverage: ' || CAST(CAST(floor(w * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'] ELSE [] END END AS reasons FROM sc)"""


def _engine(ix: Index) -> DataFrame:
    text = tx.classification_text(F.col("display_name"), F.col("extracted_text"))
    seeds = F.broadcast(ix.albums.where("parent_album_id IS NULL AND album_id > 200").select(F.col("name").alias("category"), F.col("album_id").alias("wanted")))
    wanted = cl.predict_category(ix.files, text).join(seeds, "category")
    sample = rd.classified_profiles(ix.files, 40).withColumn("primary_album_id", 201 + F.col("file_id") % 4)
    agreement = cl.cluster_agreement(wanted, F.col("extracted_text"), "wanted", sample)
    return cl.decide(ix.files, ix.albums, text, agreement, cl.centroid_evidence(ix.embs, _album_centroids(ix)))


query("ker07_engine", f"{_ENGINE} SELECT file_id, album_id, confidence FROM fin", "files albums embs file_album")(lambda ix: _engine(ix).select("file_id", "album_id", "confidence"))
query(
    "ker08_decide_all_evidence",
    f"{_ENGINE} SELECT file_id, CASE WHEN album_id IS NULL THEN 'NONE' WHEN confidence >= 0.85 THEN 'ASSIGN' WHEN confidence >= 0.6 THEN 'SUGGEST' ELSE 'NONE' END AS decision FROM fin",
    "files albums embs file_album",
)(lambda ix: _engine(ix).select("file_id", "decision"))
query("txt17_reasons", f"{_ENGINE} SELECT file_id, array_to_string(reasons, '|') AS reasons FROM fin", "files albums embs file_album")(
    lambda ix: _engine(ix).select("file_id", F.when(F.col("reasons").isNotNull(), F.array_join("reasons", "|")).alias("reasons"))
)
query("top07_first_reasons", f"{_ENGINE} SELECT file_id, array_to_string(reasons[1:3], '|') AS shown FROM fin WHERE reasons IS NOT NULL", "files albums embs file_album")(
    lambda ix: _engine(ix).where("reasons IS NOT NULL").select("file_id", F.array_join(tx.first_reasons(F.col("reasons")), "|").alias("shown"))
)

# --- tags ----------------------------------------------------------------------------------------


def _made_tags(ix: Index) -> DataFrame:
    """Fifteen tags a file, three of them twice, with many equal scores."""
    i = F.col("i")
    rows = ix.files.select("file_id", F.explode(F.sequence(F.lit(0), F.lit(14))).alias("i"))
    return rows.select("file_id", F.concat(F.lit("Tag"), i % 12).alias("tag"), (F.col("file_id") * (i + 3) % 5 / 10.0).alias("score"), i.cast("long").alias("rank"))


_TAGS = "mt AS (SELECT file_id, 'Tag' || i % 12 AS tag, max(file_id * (i + 3) % 5 / 1e1) AS score, min(i) AS first FROM files, range(0, 15) r(i) GROUP BY 1, 2), bt AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, first, tag) AS rank FROM mt)"
query("top05_best_tags", f"WITH {_TAGS} SELECT file_id, rank, tag, round(score, 6) AS score FROM bt WHERE rank <= 10", "files")(lambda ix: tg.best_tags(_made_tags(ix)).select("file_id", F.col("rank").cast("long").alias("rank"), "tag", "score"))


def _persisted(ix: Index) -> tuple[DataFrame, DataFrame]:
    """Tags of every second file are kept: new ones, and one that is known in other letters."""
    known = ix.tags.withColumn("name", F.when(F.col("name") == "en", "TAG3").otherwise(F.col("name"))).select(F.col("tag_id").cast("long").alias("tag_id"), "name", "category")
    told = tg.best_tags(_made_tags(ix).where("file_id % 2 = 0"), 4)
    sure = ix.files.select("file_id", (F.col("file_id") % 10 / 10.0).alias("confidence"))
    tags, links = tg.persist_tags(known, ix.file_tag.select("file_id", "tag_id", "confidence"), told, sure)
    return tags, links


_KEPT = f"""WITH {_TAGS}, kn AS (SELECT tag_id, CASE WHEN name = 'en' THEN 'TAG3' ELSE name END AS name FROM tags), us AS (SELECT file_id, tag FROM bt WHERE rank <= 4 AND file_id % 2 = 0),
  nw AS (SELECT DISTINCT tag AS name FROM us WHERE lower(tag) NOT IN (SELECT lower(name) FROM kn)), al AS (SELECT name FROM kn UNION ALL SELECT name FROM nw)"""
query("ker10_tags_after", f"{_KEPT} SELECT name FROM al", "files tags")(lambda ix: _persisted(ix)[0].select("name"))
query(
    "ker10_links_after",
    f"""{_KEPT} SELECT x.file_id, kn.name, x.confidence FROM file_tag x JOIN kn ON kn.tag_id = x.tag_id WHERE x.file_id % 2 = 1 UNION ALL SELECT us.file_id, al.name, (us.file_id % 10) / 1e1 FROM us JOIN al ON lower(al.name) = lower(us.tag)""",
    "files tags file_tag",
)(lambda ix: (lambda tags, links: links.join(tags, "tag_id").select("file_id", "name", "confidence"))(*_persisted(ix)))

# --- albums of clusters --------------------------------------------------------------------------


def _swept(ix: Index) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a sweep changes: two clusters get albums, one has a known name, two are suggested, one of them to a known album."""
    from corvane.operators.cluster import apply_reconcile

    kinds = [(0, "Garden", 203, "AUTO_CREATE", 0.8), (1, "Career", 4, "AUTO_CREATE", 0.9), (2, "Harvest", None, "AUTO_CREATE", 0.79), (3, "Boats", 201, "SUGGEST_TO_USER", 0.7), (4, "Identity", 3, "SUGGEST_TO_USER", 0.84)]
    named = ix.spark.createDataFrame(kinds, "cluster long, name string, parent_album_id long, verdict string, confidence double")
    members = ix.files.where("file_id % 40 < 5").groupBy((F.col("file_id") % 40).alias("cluster")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("file_id")).alias("file_ids"))
    return apply_reconcile(members.join(named, "cluster").withColumn("cohesion", F.col("confidence")), ix.albums, ix.file_album, ix.suggestions, NOW)


query(
    "ker14_auto_albums",
    """SELECT name, parent_album_id, type FROM albums UNION ALL SELECT * FROM (VALUES ('Garden', 203, 'AUTO_CREATED'), ('Harvest', NULL, 'AUTO_CREATED'), ('Boats', 201, 'AUTO_CREATED')) t""",
    "albums",
)(lambda ix: _swept(ix)[0].select("name", "parent_album_id", "type"))
query(
    "ker14_assigned",
    """WITH n AS (SELECT file_id, CASE file_id % 40 WHEN 0 THEN 'Garden' ELSE 'Harvest' END AS name, CASE file_id % 40 WHEN 0 THEN 0.8e0 ELSE 0.79e0 END AS confidence FROM files WHERE file_id % 40 IN (0, 2))
       SELECT f.file_id, a.name, f.confidence FROM file_album f JOIN albums a ON a.album_id = f.album_id UNION ALL SELECT * FROM n""",
    "file_album albums files",
)(lambda ix: (lambda albums, links, _: links.join(albums.select("album_id", "name"), "album_id").select("file_id", "name", "confidence"))(*_swept(ix)))
query(
    "ker15_suggested",
    """SELECT s.file_id, s.status, count(*) AS n FROM (SELECT file_id, status FROM suggestions UNION ALL
         SELECT file_id, 'PENDING' FROM files f WHERE f.file_id % 40 IN (3, 4) AND NOT EXISTS (SELECT 1 FROM suggestions s WHERE s.file_id = f.file_id AND s.status = 'PENDING')
           AND NOT EXISTS (SELECT 1 FROM suggestions s JOIN albums a ON a.album_id = s.suggested_album_id WHERE s.file_id = f.file_id AND s.status = 'REJECTED' AND f.file_id % 40 = 4 AND a.name = 'Identity')) s GROUP BY 1, 2""",
    "suggestions files albums",
)(lambda ix: _swept(ix)[2].groupBy("file_id", "status").agg(F.count("*").alias("n")))

# --- queue, search and related files -------------------------------------------------------------


def _user_drained(ix: Index) -> DataFrame:
    """Fifty items that a user asked for: level 2 alone."""
    ok = lambda files: files.select("file_id", (F.col("file_id") % 4 != 3).alias("ok"))
    few = qu.dequeue(ix.queue, NOW, qu.batch_size(False, False, user=True))
    items, files = qu.drain(few, ix.files, {2: ok, 3: ok, 4: ok}, NOW, only_level=2)
    return items.join(files.select("file_id", "processing_status", "processing_level"), "file_id")


query(
    "ker25_user_drain",
    f"""WITH d AS (SELECT * FROM queue WHERE (status = 'PENDING' OR (status = 'FAILED' AND retry_count < 3)) AND next_eligible_at <= {NOW} ORDER BY priority DESC, queue_id LIMIT 50)
        SELECT d.queue_id, CASE WHEN d.file_id % 4 = 3 THEN 'FAILED' ELSE 'DONE' END AS status, CASE WHEN d.file_id % 4 = 3 THEN retry_count + 1 ELSE retry_count END AS retry_count,
          CASE WHEN d.file_id % 4 = 3 THEN CAST({NOW} + 15000 * pow(2, least(retry_count, 4)) AS BIGINT) ELSE next_eligible_at END AS next_eligible_at,
          CASE WHEN d.file_id % 4 = 3 THEN f.processing_status ELSE 'CONTENT_DONE' END AS processing_status FROM d JOIN files f ON f.file_id = d.file_id""",
    "queue files",
)(lambda ix: _user_drained(ix).select("queue_id", "status", "retry_count", "next_eligible_at", "processing_status"))
query(
    "ker24_drain_items",
    f"""WITH d AS (SELECT *, (status = 'PENDING' OR (status = 'FAILED' AND retry_count < 3)) AND next_eligible_at <= {NOW} AS due FROM queue)
        SELECT queue_id, CASE WHEN due THEN CASE WHEN file_id % 10 = 9 THEN 'FAILED' ELSE 'DONE' END ELSE status END AS status, CASE WHEN due AND file_id % 10 = 9 THEN retry_count + 1 ELSE retry_count END AS retry_count,
          CASE WHEN due AND file_id % 10 = 9 THEN CAST({NOW} + 15000 * pow(2, least(retry_count, 4)) AS BIGINT) ELSE next_eligible_at END AS next_eligible_at FROM d""",
    "queue",
)(lambda ix: _all_drained(ix).select("queue_id", "status", "retry_count", "next_eligible_at"))


def _all_drained(ix: Index) -> DataFrame:
    ok = lambda files: files.select("file_id", (F.col("file_id") % 10 != 9).alias("ok"))
    return qu.drain(ix.queue, ix.files, {2: ok, 3: ok, 4: ok}, NOW)[0]


query("ker30_centroid_values", f"WITH {_CENTROIDS} SELECT album_id, round(list_sum(list_transform(range(1, 65), lambda i: centroid[i] * i)), 4) + 0.0 AS weighted FROM ce", "embs file_album")(
    lambda ix: _album_centroids(ix).select("album_id", (F.round(F.aggregate(F.transform("centroid", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 4) + F.lit(0.0)).alias("weighted"))
)
_BOOSTS = "CASE WHEN al THEN 0.05 ELSE 0.0 END + CASE WHEN tg THEN 0.02 ELSE 0.0 END + CASE WHEN fo THEN 0.03 ELSE 0.0 END"
query(
    "ker33_related",
    f"""WITH {_KNN}, nr AS (SELECT query_id, file_id, score + 0.3 AS score FROM rk WHERE rank <= 8),
          bo AS (SELECT n.*, EXISTS (SELECT 1 FROM file_album a JOIN file_album b ON a.album_id = b.album_id WHERE a.file_id = n.query_id AND b.file_id = n.file_id) AS al,
            EXISTS (SELECT 1 FROM file_tag a JOIN file_tag b ON a.tag_id = b.tag_id WHERE a.file_id = n.query_id AND b.file_id = n.file_id) AS tg,
            (SELECT regexp_replace(uri, '/[^/]*$', '') FROM files WHERE file_id = n.query_id) = (SELECT regexp_replace(uri, '/[^/]*$', '') FROM files WHERE file_id = n.file_id) AS fo FROM nr n)
        SELECT query_id, file_id, round(score + {_BOOSTS}, 6) AS score FROM bo WHERE round(score + {_BOOSTS}, 6) >= 0.55""",
    "embs file_album file_tag files",
)(lambda ix: se.related(se.nearest(_query_vectors(ix), ix.embs, 8).withColumn("score", F.col("score") + 0.3), ix.file_album, ix.file_tag, ix.files))
_SCORES_OF = "(query_id * 31 + file_id * 17) % {n} / {n}e0"


@query(
    "ker32_hybrid_four_scores",
    """WITH k AS (SELECT q.item_id AS query_id, f.file_id, (q.item_id * 31 + f.file_id * 17) % 101 / 101e0 AS keyword, (q.item_id * 7 + f.file_id * 5) % 97 / 97e0 AS semantic, (q.item_id + f.file_id * 3) % 89 / 89e0 AS filename, (q.item_id * 2 + f.file_id * 11) % 83 / 83e0 AS metadata FROM benchmark q, files f WHERE q.item_id < 10 AND f.file_id < 150),
         kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword DESC, file_id) AS r FROM k WHERE file_id % 2 = 0),
         c AS (SELECT query_id, file_id FROM kr WHERE r <= 30 UNION SELECT query_id, file_id FROM k WHERE file_id % 7 = 0)
       SELECT c.query_id, c.file_id, CAST(round((0.30 * CASE WHEN c.file_id % 2 = 0 THEN keyword ELSE 0 END + 0.40 * CASE WHEN c.file_id % 7 = 0 THEN semantic ELSE 0 END + 0.20 * CASE WHEN c.file_id % 3 = 0 THEN filename ELSE 0 END + 0.10 * CASE WHEN c.file_id % 5 = 0 THEN metadata ELSE 0 END) * 1000000) AS BIGINT) AS score_e6
       FROM c JOIN k ON k.query_id = c.query_id AND k.file_id = c.file_id""",
    "files",
)
def _hybrid_of_four(ix: Index) -> DataFrame:
    """Fusion of all four scores, each known for other files."""
    q, f = F.col("query_id"), F.col("file_id")
    pairs = ix.files.where("file_id < 150").select("file_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(10)])).alias("query_id")).join(ix.benchmark.select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    side = lambda name, by, score: pairs.where(f % by == 0).select("query_id", "file_id", score.alias(name))
    scored = se.hybrid(
        side("keyword", 2, (q * 31 + f * 17) % 101 / 101.0), side("semantic", 7, (q * 7 + f * 5) % 97 / 97.0), side("filename", 3, (q + f * 3) % 89 / 89.0), side("metadata", 5, (q * 2 + f * 11) % 83 / 83.0)
    )
    return scored.select("query_id", "file_id", F.round(F.col("score") * 1000000).cast("long").alias("score_e6"))
