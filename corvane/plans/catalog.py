"""Registered queries of the file index and the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.fixtures import Index
from corvane.functions import lexicon as lx
from corvane.functions import text as tx
from corvane.functions import vector as vc
from corvane.operators import albums as al
from corvane.operators import classify as cl
from corvane.operators import cluster as cu
from corvane.operators import dedup as dd
from corvane.operators import extract as ex
from corvane.operators import queue as qu
from corvane.operators import reads as rd
from corvane.operators import scan as sc
from corvane.operators import search as se
from corvane.operators import store as st
from corvane.operators import tags as tg
from corvane.plans.registry import NOW, found, query
from corvane.sources import discovery as di

_STOP = "[" + ", ".join(f"'{w}'" for w in lx.STOP_WORDS) + "]"
_TOKENS = "list_filter(string_split_regex(lower({0}), '[^a-z0-9+.#-]'), lambda t: length(t) >= 2 AND NOT list_contains(" + _STOP + ", t))"


def _toks(column: str) -> str:
    return _TOKENS.replace("{0}", column)


_LEX = "lex(cat_ord, category, term_ord, term, weight) AS (VALUES " + ", ".join(f"({c}, '{n}', {t}, '{w}', CAST({x} AS DOUBLE))" for c, n, t, w, x in lx.LEXICON) + ")"
_MATCH = "(l.term = g.gram OR (length(g.gram) - length(l.term) BETWEEN 1 AND 3 AND starts_with(g.gram, l.term)) OR (length(l.term) - length(g.gram) BETWEEN 1 AND 3 AND starts_with(l.term, g.gram)))"


def _hits_sql(column: str, source: str = "files") -> str:
    """Common table expressions up to hits(file_id, cat_ord, category, term_ord, term, weight)."""
    return f"""{_LEX},
      tk AS (SELECT file_id, {_toks(column)} AS toks FROM {source}),
      gr AS (SELECT DISTINCT file_id, gram FROM (
        SELECT file_id, unnest(toks) AS gram FROM tk UNION ALL
        SELECT file_id, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS gram FROM tk) x),
      dg AS (SELECT DISTINCT gram FROM gr),
      dh AS (SELECT g.gram, l.* FROM dg g JOIN lex l ON {_MATCH}),
      hits AS (SELECT DISTINCT gr.file_id, dh.cat_ord, dh.category, dh.term_ord, dh.term, dh.weight FROM gr JOIN dh ON dh.gram = gr.gram)"""


_SCORES = "scores AS (SELECT file_id, cat_ord, category, least(round(sum(weight) / 2.5, 6), 1.0) AS score, list(term ORDER BY term_ord) AS terms FROM hits GROUP BY 1, 2, 3), best AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, cat_ord) AS r FROM scores), pred AS (SELECT file_id, category, score, terms FROM best WHERE r = 1 AND score >= 0.35)"

# --- sources -------------------------------------------------------------------------------------

query(
    "src02_media_catalog",
    "SELECT uri, coalesce(display_name, 'unnamed') AS display_name, coalesce(mime_type, 'application/octet-stream') AS mime_type, CAST(coalesce(size_bytes, "
    "0) AS BIGINT) AS size_bytes, coalesce(date_modified_s, 0) * 1000 AS date_modified_source FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY "
    "source_ord, media_id) AS r FROM media) t WHERE r = 1",
    "media",
)(
    lambda ix: di.media_catalog(ix.media)
)
query(
    "src03_union_sources",
    "SELECT uri, count(*) AS n FROM (SELECT uri FROM discovered UNION ALL SELECT uri FROM files) t GROUP BY uri",
    "discovered files",
)(
    lambda ix: di.union_sources(ix.discovered, ix.files).groupBy("uri").agg(F.count("*").alias("n"))
)
query(
    "src04_size_capped",
    "SELECT uri, size_bytes FROM discovered WHERE size_bytes <= 536870912",
    "discovered",
)(
    lambda ix: di.size_capped(ix.discovered).select("uri", "size_bytes")
)
query(
    "src05_access",
    "SELECT folder_uri, permission_state = 'ACTIVE' AS granted, list_last(string_split(folder_uri, '/')) AS display_name FROM folders".replace("list_last(string_split(folder_uri, '/'))", "string_split(folder_uri, '/')[-1]"),
    "folders",
)(
    lambda ix: di.accessible(ix.folders, ix.folders.where("permission_state = 'ACTIVE'"))
)

# --- lookups and filters -------------------------------------------------------------------------

query(
    "flt01_file_by_id",
    "SELECT file_id, uri, display_name FROM files WHERE file_id = 7",
    "files",
)(
    lambda ix: rd.by_id(ix.files, "file_id", 7).select("file_id", "uri", "display_name")
)
query(
    "flt02_live_by_name",
    "SELECT file_id, display_name FROM files WHERE NOT is_deleted ORDER BY display_name, file_id",
    "files",
)(
    lambda ix: rd.live_by_name(ix.files).select("file_id", "display_name")
)
query(
    "flt03_change_signature",
    "SELECT file_id, size_bytes, date_modified_source FROM files WHERE uri = (SELECT min(uri) FROM files)",
    "files",
)(
    lambda ix: ix.files.join(ix.files.agg(F.min("uri").alias("uri")), "uri").select("file_id", "size_bytes", "date_modified_source")
)
query(
    "flt04_other_with_uri",
    "SELECT a.file_id, count(b.file_id) AS others FROM files a LEFT JOIN files b ON a.uri = b.uri AND a.file_id <> b.file_id GROUP BY 1",
    "files",
)(
    lambda ix: (
        ix.files.select("file_id", "uri")
        .join(ix.files.select(F.col("file_id").alias("o"), F.col("uri").alias("u")), (F.col("uri") == F.col("u")) & (F.col("file_id") != F.col("o")), "left")
        .groupBy("file_id")
        .agg(F.count("o").alias("others"))
    )
)
query("flt05_doc_type", "SELECT file_id, doc_type FROM files", "files")(lambda ix: ix.files.select("file_id", "doc_type"))
query(
    "flt06_classification_source",
    "SELECT file_id, display_name, extracted_text FROM files",
    "files",
)(
    lambda ix: ix.files.select("file_id", "display_name", "extracted_text")
)
query(
    "flt07_unprocessed",
    "SELECT file_id FROM files WHERE processing_status <> 'INDEXED' AND NOT is_deleted ORDER BY date_first_indexed, file_id LIMIT 50",
    "files",
)(
    lambda ix: rd.unprocessed(ix.files, 50).select("file_id")
)
query(
    "flt08_hashed",
    "SELECT file_id, sha256_hash FROM files WHERE doc_type = 'PDF' AND sha256_hash IS NOT NULL",
    "files",
)(
    lambda ix: rd.hashed(ix.files, "PDF")
)
query("flt08_hashed_null_type", "SELECT file_id, sha256_hash FROM files WHERE doc_type = NULL", "files")(lambda ix: rd.hashed(ix.files, None))
query(
    "flt09_perceptual_hashes",
    "SELECT file_id, bit_count(phash) AS bits FROM hashes WHERE phash IS NOT NULL".replace("bit_count(phash)", "CAST(bit_count(CAST(phash AS HUGEINT)) AS INT)"),
    "hashes",
)(
    lambda ix: ix.hashes.where("phash IS NOT NULL").select("file_id", F.bit_count("phash").alias("bits"))
)
query(
    "flt10_candidates",
    "SELECT file_id, display_name, extracted_text FROM files WHERE processing_status IN ('CONTENT_DONE', 'CLASSIFIED') AND primary_album_id IS NULL AND NOT "
    "is_deleted ORDER BY date_first_indexed DESC, file_id LIMIT 400",
    "files",
)(
    lambda ix: rd.classification_candidates(ix.files, 400)
)
query(
    "flt11_classified_profiles",
    "SELECT file_id, primary_album_id, extracted_text FROM files WHERE primary_album_id IS NOT NULL AND length(extracted_text) > 0 ORDER BY "
    "date_first_indexed DESC, file_id LIMIT 40",
    "files",
)(
    lambda ix: rd.classified_profiles(ix.files, 40)
)
query(
    "flt12_text_sample",
    "SELECT file_id, extracted_text FROM files WHERE length(extracted_text) > 0 ORDER BY date_first_indexed DESC, file_id LIMIT 300",
    "files",
)(
    lambda ix: rd.text_sample(ix.files, 300)
)
query("flt13_albums_by_name", "SELECT album_id, name FROM albums ORDER BY name", "albums")(lambda ix: ix.albums.orderBy("name").select("album_id", "name"))
query(
    "flt14_children",
    "SELECT album_id, name FROM albums WHERE parent_album_id IS NOT DISTINCT FROM 2",
    "albums",
)(
    lambda ix: rd.children(ix.albums, 2).select("album_id", "name")
)
query(
    "flt14_children_of_none",
    "SELECT album_id, name FROM albums WHERE parent_album_id IS NULL",
    "albums",
)(
    lambda ix: rd.children(ix.albums, None).select("album_id", "name")
)
query(
    "flt15_album_by_name",
    "SELECT album_id, name FROM albums WHERE lower(name) = 'france'",
    "albums",
)(
    lambda ix: rd.by_name_nocase(ix.albums, "fRaNcE", "album_id").select("album_id", "name")
)
query(
    "flt16_top_albums",
    "SELECT album_id FROM albums WHERE parent_album_id IS NULL AND album_id IN (SELECT album_id FROM albums)",
    "albums",
)(
    lambda ix: ix.albums.where("parent_album_id IS NULL").select("album_id")
)
query(
    "flt17_assignments",
    "SELECT album_id, confidence FROM file_album WHERE file_id = 12 ORDER BY confidence DESC, album_id",
    "file_album",
)(
    lambda ix: rd.assignments(ix.file_album, 12).select("album_id", "confidence")
)
query(
    "flt18_primary_albums",
    "SELECT file_id, primary_album_id FROM files WHERE primary_album_id IS NOT NULL",
    "files",
)(
    lambda ix: ix.files.where("primary_album_id IS NOT NULL").select("file_id", "primary_album_id")
)
query(
    "flt20_embedding",
    "SELECT file_id, dim, round(vector[1], 6) AS first FROM embs WHERE file_id = 3 AND model_version = 'm1'",
    "embs",
)(
    lambda ix: (
        ix.embs.where("file_id = 3 AND model_version = 'm1'")
        .select("file_id", "dim", F.round(F.col("vector")[0], 6).alias("first"))
    )
)
query(
    "flt21_filename_search",
    "SELECT file_id, display_name FROM files WHERE NOT is_deleted AND lower(display_name) LIKE '%_en_1%' ORDER BY display_name, file_id LIMIT 50",
    "files",
)(
    lambda ix: rd.filename_search(ix.files, "_EN_1")
)
query(
    "flt21_part_names",
    "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%e%' ",
)(
    lambda ix: ix.part.where(rd.ascii_lower(F.col("p_name")).like("%e%")).select("p_partkey", "p_name")
)
query(
    "flt22_folders",
    "SELECT folder_uri, permission_state <> 'ACTIVE' AS stale FROM folders",
    "folders",
)(
    lambda ix: rd.folders(ix.folders).select("folder_uri", (F.col("permission_state") != "ACTIVE").alias("stale"))
)
query(
    "flt22_active_folders",
    "SELECT folder_uri FROM folders WHERE permission_state = 'ACTIVE'",
    "folders",
)(
    lambda ix: rd.folders(ix.folders, True).select("folder_uri")
)
query(
    "flt23_pending_of_file",
    "SELECT file_id, count(*) AS n FROM queue WHERE status IN ('PENDING', 'IN_PROGRESS') GROUP BY 1",
    "queue",
)(
    lambda ix: ix.queue.where(F.col("status").isin("PENDING", "IN_PROGRESS")).groupBy("file_id").agg(F.count("*").alias("n"))
)
query(
    "flt24_tag_by_name",
    "SELECT tag_id, name FROM tags WHERE lower(name) = 'en'",
    "tags",
)(
    lambda ix: rd.by_name_nocase(ix.tags, "EN", "tag_id").select(F.col("tag_id").cast("long"), "name")
)
query(
    "flt25_list_items",
    "SELECT file_id, uri, display_name, doc_type, processing_status, substr(extracted_text, 1, 512) AS preview FROM files",
    "files",
)(
    lambda ix: rd.list_items(ix.files)
)

# --- joins ---------------------------------------------------------------------------------------

query(
    "join01_files_of_album",
    "SELECT f.file_id, f.display_name FROM files f JOIN file_album a ON a.file_id = f.file_id WHERE a.album_id = 103 AND NOT f.is_deleted ORDER BY 2, 1",
    "files file_album",
)(
    lambda ix: rd.files_of_album(ix.files, ix.file_album, 103).select("file_id", "display_name")
)
query(
    "join02_filed",
    "SELECT DISTINCT f.file_id, f.uri FROM files f JOIN file_album a ON a.file_id = f.file_id WHERE NOT f.is_deleted",
    "files file_album",
)(
    lambda ix: rd.filed(ix.files, ix.file_album).select("file_id", "uri")
)
query(
    "join03_files_by_tag",
    "SELECT f.file_id FROM files f JOIN file_tag x ON x.file_id = f.file_id JOIN tags t ON t.tag_id = x.tag_id WHERE lower(t.name) = 'fr' AND NOT "
    "f.is_deleted ORDER BY f.display_name, f.file_id LIMIT 100",
    "files file_tag tags",
)(
    lambda ix: rd.files_by_tag(ix.files, ix.file_tag, ix.tags, "fr", 100).select("file_id")
)
query(
    "join04_pending_suggestions",
    "SELECT s.suggestion_id, s.suggested_album_id, f.display_name FROM suggestions s JOIN files f ON f.file_id = s.file_id WHERE s.status = 'PENDING'",
    "suggestions files",
)(
    lambda ix: rd.pending_suggestions(ix.suggestions, ix.files).select("suggestion_id", "suggested_album_id", "display_name")
)
query(
    "join05_album_vectors",
    "SELECT e.file_id, e.dim FROM embs e JOIN file_album a ON a.file_id = e.file_id WHERE a.album_id = 104 AND e.model_version = 'm1'",
    "embs file_album",
)(
    lambda ix: rd.album_vectors(ix.embs, ix.file_album, 104, "m1").select("file_id", "dim")
)
query(
    "join06_tags_of_files",
    "SELECT x.file_id, row_number() OVER (PARTITION BY x.file_id ORDER BY x.confidence DESC, x.tag_id) AS rank, t.name, x.confidence FROM file_tag x JOIN "
    "tags t ON t.tag_id = x.tag_id",
    "file_tag tags",
)(
    lambda ix: rd.tags_of_file(ix.file_tag, ix.tags)
)
query(
    "join08_not_queued",
    "SELECT file_id FROM files f WHERE NOT is_deleted AND NOT EXISTS (SELECT 1 FROM queue q WHERE q.file_id = f.file_id AND q.status IN ('PENDING', "
    "'IN_PROGRESS'))",
    "files queue",
)(
    lambda ix: rd.not_queued(ix.files, ix.queue)
)
query(
    "join09_album_counts",
    "SELECT a.album_id, a.name, (SELECT count(*) FROM file_album x WHERE x.album_id = a.album_id) AS file_count FROM albums a",
    "albums file_album",
)(
    lambda ix: rd.album_counts(ix.albums, ix.file_album).select("album_id", "name", "file_count")
)
query(
    "join10_term_hits",
    f"WITH {_hits_sql('extracted_text')} SELECT file_id, category, term FROM hits",
    "files",
)(
    lambda ix: cl.term_hits(ix.files, F.col("extracted_text")).select("file_id", "category", "term")
)
_PROFILES = f"pt AS (SELECT file_id, unnest({_toks('substr(extracted_text, 1, 4000)')}) AS term FROM files), pr AS (SELECT file_id, term, CAST(count(*) AS DOUBLE) AS tf FROM pt GROUP BY 1, 2), nm AS (SELECT file_id, sqrt(sum(tf * tf)) AS n FROM pr GROUP BY 1), sm AS (SELECT file_id, primary_album_id FROM files WHERE primary_album_id IS NOT NULL AND length(extracted_text) > 0 ORDER BY date_first_indexed DESC, file_id LIMIT 40), cs AS (SELECT a.file_id, b.file_id AS other_id, round(sum(a.tf * b.tf) / (min(na.n) * min(nb.n)), 6) AS cosine FROM pr a JOIN (SELECT * FROM pr WHERE file_id IN (SELECT file_id FROM sm)) b ON a.term = b.term JOIN nm na ON na.file_id = a.file_id JOIN nm nb ON nb.file_id = b.file_id GROUP BY 1, 2)"
query(
    "join11_profile_similarity",
    f"WITH {_PROFILES} SELECT file_id, other_id, cosine FROM cs WHERE cosine >= 0.4",
    "files",
)(
    lambda ix: (
        cl.profile_cosines(cl.profiles(ix.files, F.col("extracted_text")), cl.profiles(rd.classified_profiles(ix.files, 40), F.col("extracted_text")))
        .where("cosine >= 0.4")
    )
)
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
_KNN = "kn AS (SELECT q.file_id AS query_id, e.file_id, round(" + _DOT.format(a="q.vector", b="e.vector") + ", 6) AS score FROM embs q JOIN embs e ON q.file_id <> e.file_id WHERE q.file_id % 100 = 0), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_id) AS rank FROM kn)"


def _query_vectors(ix: Index) -> DataFrame:
    """The stated query set of the vector searches: ids divisible by 100."""
    return ix.embs.where("file_id % 100 = 0").select(F.col("file_id").alias("query_id"), "vector")


query(
    "join12_knn",
    f"WITH {_KNN} SELECT query_id, rank, file_id, score FROM rk WHERE rank <= 10",
    "embs",
)(
    lambda ix: se.nearest(_query_vectors(ix), ix.embs, 10)
)
_CENTROIDS = "ps AS (SELECT a.album_id, i, sum(CAST(e.vector[i] AS DOUBLE)) AS s FROM embs e JOIN file_album a ON a.file_id = e.file_id, range(1, 65) t(i) GROUP BY 1, 2), ln AS (SELECT album_id, sqrt(sum(s * s)) AS l FROM ps GROUP BY 1), ce AS (SELECT ps.album_id, list(s / l ORDER BY i) AS centroid FROM ps JOIN ln ON ln.album_id = ps.album_id GROUP BY 1)"


def _album_centroids(ix: Index) -> DataFrame:
    return cu.mean_vectors(ix.embs.join(ix.file_album.select("file_id", "album_id"), "file_id"), "album_id").select("album_id", "n", "centroid")


query(
    "join13_nearest_centroid",
    f"WITH {_CENTROIDS} SELECT e.file_id, round(least(greatest(max("
    + _DOT.format(a="e.vector", b="c.centroid")
    + "), 0.0), 1.0), 6) AS centroid_score FROM embs e, ce c GROUP BY 1",
    "embs file_album",
)(
    lambda ix: cl.centroid_evidence(ix.embs, _album_centroids(ix))
)
query(
    "join14_cluster_pairs",
    "SELECT a.album_id, count(*) AS pairs, round(avg("
    + _DOT.format(a="ea.vector", b="eb.vector")
    + ("), 6) AS cohesion FROM file_album a JOIN file_album b ON a.album_id = b.album_id AND a.file_id < b.file_id JOIN embs ea ON ea.file_id = a.file_id JOIN "
    "embs eb ON eb.file_id = b.file_id GROUP BY 1"),
    "embs file_album",
)(
    lambda ix: (
        cu.cohesion(ix.embs.join(ix.file_album.select("file_id", "album_id"), "file_id"), "album_id")
        .where("n > 1")
        .select("album_id", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), "cohesion")
    )
)
query(
    "join16_versions",
    "SELECT a.file_id AS file_a, b.file_id AS file_b, round("
    + _DOT.format(a="ea.vector", b="eb.vector")
    + (", 6) AS cosine FROM files a JOIN files b ON a.file_id < b.file_id AND regexp_replace(regexp_replace(a.display_name, '\\.[^.]*$', ''), '_[0-9]+$', '') "
    "= regexp_replace(regexp_replace(b.display_name, '\\.[^.]*$', ''), '_[0-9]+$', '') JOIN embs ea ON ea.file_id = a.file_id JOIN embs eb ON eb.file_id = "
    "b.file_id WHERE round(")
    + _DOT.format(a="ea.vector", b="eb.vector")
    + ", 6) >= 0.3",
    "files embs",
)(
    lambda ix: dd.version_pairs(ix.files, ix.embs, cu.Settings(version_cosine_threshold=0.3))
)

# --- aggregates ----------------------------------------------------------------------------------

query(
    "agg01_status",
    "SELECT count(*) FILTER (NOT is_deleted) AS live, count(*) FILTER (NOT is_deleted AND processing_status = 'INDEXED') AS indexed, count(*) FILTER (NOT "
    "is_deleted AND primary_album_id IS NULL) AS uncategorised, (SELECT count(*) FROM queue WHERE status IN ('PENDING', 'IN_PROGRESS')) AS pending, CAST(0 "
    "AS BIGINT) AS in_progress FROM files",
    "files queue",
)(
    lambda ix: rd.status_counts(ix.files, ix.queue)
)
query(
    "agg05_suggestion_counts",
    "SELECT file_id, suggested_album_id, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'REJECTED') AS rejected FROM "
    "suggestions GROUP BY 1, 2",
    "suggestions",
)(
    lambda ix: rd.suggestion_counts(ix.suggestions)
)
query("agg06_embedding_counts", "SELECT model_version, count(*) AS n FROM embs GROUP BY 1", "embs")(lambda ix: rd.embedding_counts(ix.embs))
query(
    "agg07_queue_counts",
    f"SELECT count(*) FILTER (status IN ('PENDING', 'IN_PROGRESS')) AS pending, count(*) FILTER (status = 'PENDING' AND next_eligible_at <= {NOW}) AS "
    f"eligible FROM queue",
    "queue",
)(
    lambda ix: rd.queue_counts(ix.queue, NOW)
)
query(
    "agg08_tags_concat",
    "SELECT f.file_id, string_agg(t.name, ' ' ORDER BY t.name) AS tags_concat FROM files f LEFT JOIN file_tag x ON x.file_id = f.file_id LEFT JOIN tags t "
    "ON t.tag_id = x.tag_id GROUP BY 1",
    "files file_tag tags",
)(
    lambda ix: rd.tags_concat(ix.files, ix.file_tag, ix.tags)
)
query(
    "agg10_term_frequency",
    f"SELECT file_id, term, count(*) AS tf FROM (SELECT file_id, unnest({_toks('extracted_text')}) AS term FROM files) t GROUP BY 1, 2",
    "files",
)(
    lambda ix: tg.term_frequencies(ix.files, F.col("extracted_text")).select("file_id", "term", "tf")
)
query(
    "agg11_document_frequency",
    f"SELECT term, count(DISTINCT file_id) AS df FROM (SELECT file_id, unnest({_toks('substr(extracted_text, 1, 10000)')}) AS term FROM (SELECT file_id, "
    f"extracted_text FROM files WHERE length(extracted_text) > 0 ORDER BY date_first_indexed DESC, file_id LIMIT 300) s) t WHERE length(term) >= 3 GROUP BY "
    f"1",
    "files",
)(
    lambda ix: tg.document_frequencies(rd.text_sample(ix.files, 300), F.col("extracted_text"))
)
query(
    "agg12_mean_profile",
    f"WITH p AS (SELECT f.primary_album_id AS cluster, f.file_id, unnest({_toks('substr(extracted_text, 1, 4000)')}) AS term FROM files f WHERE "
    f"primary_album_id IS NOT NULL), n AS (SELECT cluster, count(DISTINCT file_id) AS n FROM p GROUP BY 1) SELECT p.cluster, term, round(count(*) / "
    f"CAST(min(n.n) AS DOUBLE), 6) AS tf FROM p JOIN n ON n.cluster = p.cluster GROUP BY 1, 2",
    "files",
)(
    lambda ix: (
        cu.mean_profile(cl.profiles(ix.files.where("primary_album_id IS NOT NULL"), F.col("extracted_text")).join(ix.files.select("file_id", F.col("primary_album_id").alias("cluster")), "file_id"))
        .select("cluster", "term", F.round("tf", 6).alias("tf"))
    )
)
query(
    "agg14_centroids",
    f"WITH {_CENTROIDS} SELECT album_id, i AS pos, round(centroid[i], 5) + 0.0 AS x FROM ce, range(1, 65) t(i)",
    "embs file_album",
)(
    lambda ix: (
        _album_centroids(ix)
        .select("album_id", F.posexplode("centroid").alias("p", "v"))
        .select("album_id", (F.col("p") + 1).cast("long").alias("pos"), (F.round("v", 5) + F.lit(0.0)).alias("x"))
    )
)
query(
    "agg16_cluster_names",
    f"WITH p AS (SELECT DISTINCT primary_album_id AS cluster, file_id, unnest({_toks('substr(extracted_text, 1, 4000)')}) AS term FROM files WHERE "
    f"primary_album_id IS NOT NULL), c AS (SELECT cluster, term, count(*) AS n FROM p WHERE length(term) >= 4 AND term NOT IN ('education', 'career', "
    f"'finance', 'identity', 'photos', 'uncategorized') GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS r "
    f"FROM c) SELECT cluster, upper(substr(term, 1, 1)) || substr(term, 2) AS name FROM r WHERE r = 1",
    "files",
)(
    lambda ix: cu.cluster_names(cl.profiles(ix.files.where("primary_album_id IS NOT NULL"), F.col("extracted_text")).join(ix.files.select("file_id", F.col("primary_album_id").alias("cluster")), "file_id"))
)
query(
    "agg17_ocr_pages",
    "SELECT doc_id AS file_id, round(avg(c), 6) AS ocr_confidence, count(*) AS pages FROM (SELECT doc_id, i, (doc_id + i) % 10 / 1e1 AS c, CASE WHEN i % 3 "
    "= 0 THEN '' ELSE 'p' END AS t FROM documents, range(0, 40) r(i)) x WHERE i < 30 AND length(t) > 0 GROUP BY 1",
)(
    lambda ix: (
        ex.page_text(ix.documents.select(F.col("doc_id").alias("file_id"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("page")).select("file_id", "page", F.when(F.col("page") % 3 == 0, "").otherwise("p").alias("text"), F.when(F.col("page") % 3 != 0, (F.col("file_id") + F.col("page")) % 10 / 10.0).alias("confidence")))
        .select("file_id", F.round("ocr_confidence", 6).alias("ocr_confidence"), F.col("recognized").alias("pages"))
    )
)
query(
    "agg18_exact_duplicates",
    "SELECT sha256_hash, count(*) AS n, min(file_id) AS representative_file_id FROM files WHERE NOT is_deleted GROUP BY 1 HAVING count(*) > 1",
    "files",
)(
    lambda ix: dd.exact_groups(ix.files)
)
query(
    "agg19_agreement",
    f"WITH {_PROFILES}, tg AS (SELECT file_id, 100 + file_id % 25 AS wanted FROM files) SELECT cs.file_id, count(*) AS similar, count(*) FILTER "
    f"(sm.primary_album_id = tg.wanted) AS agree, round(count(*) FILTER (sm.primary_album_id = tg.wanted) / CAST(count(*) AS DOUBLE), 6) AS agreement FROM "
    f"cs JOIN sm ON sm.file_id = cs.other_id JOIN tg ON tg.file_id = cs.file_id WHERE cosine >= 0.4 GROUP BY 1",
    "files",
)(
    lambda ix: cl.cluster_agreement(ix.files.withColumn("wanted", 100 + F.col("file_id") % 25), F.col("extracted_text"), "wanted", rd.classified_profiles(ix.files, 40))
)

# --- top-k ---------------------------------------------------------------------------------------

query(
    "top01_newest",
    "SELECT file_id FROM files WHERE NOT is_deleted ORDER BY date_first_indexed DESC, file_id LIMIT 500",
    "files",
)(
    lambda ix: rd.newest(ix.files).select("file_id")
)
query(
    "top02_dequeue",
    f"SELECT queue_id, priority FROM queue WHERE status = 'PENDING' AND next_eligible_at <= {NOW} ORDER BY priority DESC, queue_id LIMIT 20",
    "queue",
)(
    lambda ix: qu.dequeue(ix.queue, NOW, 20, reference_mode=True).select("queue_id", "priority")
)
query(
    "top02_dequeue_with_retries",
    f"SELECT queue_id, status FROM queue WHERE (status = 'PENDING' OR (status = 'FAILED' AND retry_count < 3)) AND next_eligible_at <= {NOW} ORDER BY "
    f"priority DESC, queue_id LIMIT 20",
    "queue",
)(
    lambda ix: qu.dequeue(ix.queue, NOW, 20).select("queue_id", "status")
)
query(
    "top06_labels",
    "SELECT doc_id AS file_id, list(l ORDER BY c DESC, l)[1:5] AS labels FROM (SELECT doc_id, 'l' || i AS l, (doc_id * (i + 3)) % 17 / 1e1 AS c FROM documents, range(0, 8) r(i)) t GROUP BY 1".replace("list(l ORDER BY c DESC, l)[1:5]", "array_to_string(list(l ORDER BY c DESC, l)[1:5], ',')"),
)(
    lambda ix: (
        ex.top_labels(ix.documents.select(F.col("doc_id").alias("file_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select("file_id", F.concat(F.lit("l"), "i").alias("label"), ((F.col("file_id") * (F.col("i") + 3)) % 17 / 10.0).alias("confidence")))
        .select("file_id", F.array_join("labels", ",").alias("labels"))
    )
)
query(
    "top08_related",
    f"WITH {_KNN}, nr AS (SELECT query_id, file_id, score FROM rk WHERE rank <= 8), bo AS (SELECT n.*, EXISTS (SELECT 1 FROM file_album a JOIN file_album b "
    f"ON a.album_id = b.album_id WHERE a.file_id = n.query_id AND b.file_id = n.file_id) AS al, EXISTS (SELECT 1 FROM file_tag a JOIN file_tag b ON a.tag_id "
    f"= b.tag_id WHERE a.file_id = n.query_id AND b.file_id = n.file_id) AS tg, (SELECT regexp_replace(uri, '/[^/]*$', '') FROM files WHERE file_id = "
    f"n.query_id) = (SELECT regexp_replace(uri, '/[^/]*$', '') FROM files WHERE file_id = n.file_id) AS fo FROM nr n) SELECT query_id, file_id, round(score "
    f"+ CASE WHEN al THEN 0.05 ELSE 0.0 END + CASE WHEN tg THEN 0.02 ELSE 0.0 END + CASE WHEN fo THEN 0.03 ELSE 0.0 END, 6) AS score FROM bo WHERE "
    f"round(score + CASE WHEN al THEN 0.05 ELSE 0.0 END + CASE WHEN tg THEN 0.02 ELSE 0.0 END + CASE WHEN fo THEN 0.03 ELSE 0.0 END, 6) >= 0.3",
    "embs file_album file_tag files",
)(
    lambda ix: se.related(se.nearest(_query_vectors(ix), ix.embs, 8), ix.file_album, ix.file_tag, ix.files, cu.Settings(related_min_similarity=0.3))
)

# --- text and scalar functions -------------------------------------------------------------------

query(
    "txt01_tokens",
    f"SELECT file_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT file_id, {_toks('extracted_text')} AS t FROM files) x",
    "files",
)(
    lambda ix: (
        ix.files.withColumn("t", tx.tokens(F.col("extracted_text")))
        .select("file_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))
    )
)
query(
    "txt02_bigrams",
    f"SELECT file_id, md5(array_to_string(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), '|')) AS digest FROM (SELECT file_id, "
    f"{_toks('extracted_text')} AS t FROM files) x",
    "files",
)(
    lambda ix: ix.files.select("file_id", F.md5(F.array_join(tx.bigrams(tx.tokens(F.col("extracted_text"))), "|")).alias("digest"))
)
query(
    "txt03_term_matches",
    f"WITH {_LEX}, w AS (SELECT DISTINCT unnest({_toks('extracted_text')}) AS gram FROM files) SELECT g.gram, l.term FROM w g JOIN lex l ON {_MATCH}",
    "files",
)(
    lambda ix: (
        lx.match_terms(ix.files.select(F.explode(tx.tokens(F.col("extracted_text"))).alias("gram")).distinct())
        .select("gram", "term")
        .distinct()
    )
)
query(
    "txt04_lexicon",
    f"WITH {_hits_sql('extracted_text')} SELECT l.category, l.term, l.weight, count(h.file_id) AS files FROM lex l LEFT JOIN hits h ON h.cat_ord = l.cat_ord AND h.term_ord = l.term_ord GROUP BY 1, 2, 3",
    "files",
)(
    lambda ix: (
        lx.lexicon_frame(ix.spark)
        .join(cl.term_hits(ix.files, F.col("extracted_text")).groupBy("cat_ord", "term_ord").agg(F.count("*").alias("files")), ["cat_ord", "term_ord"], "left")
        .select("category", "term", "weight", F.coalesce("files", F.lit(0).cast("long")).alias("files"))
    )
)
_SPANS = {"txt06_iso_dates": ("'\\b((?:19|20)\\d{2}[-/.]\\d{1,2}[-/.]\\d{1,2})\\b'", "'date:' || replace(replace(s, '/', '-'), '.', '-')", tx.iso_date_tags), "txt08_years": ("'\\b((?:19|20)\\d{2})\\b'", "'year:' || s", tx.year_tags)}
for _name, (_pattern, _tag, _fn) in _SPANS.items():
    query(_name, f"SELECT file_id, {_tag} AS tag FROM (SELECT file_id, unnest(regexp_extract_all(text, {_pattern}, 1)) AS s FROM dated) t", "dated")(lambda ix, fn=_fn: ix.dated.select("file_id", F.explode(fn(F.col("text"))).alias("tag")))
query(
    "txt07_us_dates",
    "SELECT file_id, 'date:' || string_split_regex(s, '[-/.]')[3] || '-' || lpad(string_split_regex(s, '[-/.]')[1], 2, '0') || '-' || "
    "lpad(string_split_regex(s, '[-/.]')[2], 2, '0') AS tag FROM (SELECT file_id, unnest(regexp_extract_all(text, "
    "'\\b(\\d{1,2}[-/.]\\d{1,2}[-/.](?:19|20)\\d{2})\\b', 1)) AS s FROM dated) t",
    "dated",
)(
    lambda ix: ix.dated.select("file_id", F.explode(tx.us_date_tags(F.col("text"))).alias("tag"))
)
query(
    "txt10_doc_type",
    "SELECT file_id, doc_type FROM files",
    "files",
)(
    lambda ix: ix.files.select("file_id", tx.doc_type(F.col("mime_type")).alias("doc_type"))
)
query(
    "txt11_classification_text",
    "SELECT file_id, md5(display_name || coalesce(chr(10) || substr(extracted_text, 1, 6000), '')) AS digest FROM files",
    "files",
)(
    lambda ix: ix.files.select("file_id", F.md5(tx.classification_text(F.col("display_name"), F.col("extracted_text"))).alias("digest"))
)
query(
    "txt12_embedding_text",
    "SELECT f.file_id, md5(display_name || CASE WHEN length(trim(extracted_text)) > 0 THEN chr(10) || substr(extracted_text, 1, 8000) ELSE '' END || CASE "
    "WHEN g.n IS NULL THEN '' ELSE chr(10) || g.n END) AS digest FROM files f LEFT JOIN (SELECT x.file_id, string_agg(t.name || ' ', '' ORDER BY t.name) AS "
    "n FROM file_tag x JOIN tags t ON t.tag_id = x.tag_id GROUP BY 1) g ON g.file_id = f.file_id",
    "files file_tag tags",
)(
    lambda ix: (
        ix.files.join(ix.file_tag.join(ix.tags, "tag_id").groupBy("file_id").agg(F.array_sort(F.collect_list("name")).alias("names")), "file_id", "left")
        .select("file_id", F.md5(tx.embedding_text(F.col("display_name"), F.col("extracted_text"), F.col("names"))).alias("digest"))
    )
)
query(
    "txt18_match_and",
    "SELECT file_id FROM (SELECT file_id, string_split_regex(lower(display_name), '[^a-z0-9]+') AS n, string_split_regex(lower(extracted_text), "
    "'[^a-z0-9\u0080-\U0010ffff]+') AS t FROM files) x WHERE (list_contains(n, 'the') OR list_contains(t, 'the')) AND (list_contains(n, 'of') OR "
    "list_contains(t, 'of'))",
    "files",
)(
    lambda ix: se.match(se.inverted_index(ix.files), "the of")
)
query(
    "txt18_match_column_prefix",
    "SELECT file_id FROM (SELECT file_id, string_split_regex(lower(display_name), '[^a-z0-9]+') AS n FROM files) x WHERE len(list_filter(n, lambda w: "
    "starts_with(w, 'src1'))) > 0 OR list_contains(n, 'fr')",
    "files",
)(
    lambda ix: se.match(se.inverted_index(ix.files), "name:src1* OR name:fr")
)
query(
    "txt18_match_phrase",
    "SELECT file_id FROM files WHERE position(' of the ' IN ' ' || array_to_string(list_filter(string_split_regex(lower(extracted_text), "
    "'[^a-z0-9\u0080-\U0010ffff]+'), lambda w: w <> ''), ' ') || ' ') > 0",
    "files",
)(
    lambda ix: se.match(se.inverted_index(ix.files, {"text": "extracted_text"}), '"of the"')
)
query(
    "vec01_dot",
    "SELECT a.file_id, round(" + _DOT.format(a="a.vector", b="b.vector") + ", 6) AS dot FROM embs a JOIN embs b ON b.file_id = a.file_id + 1",
    "embs",
)(
    lambda ix: (
        ix.embs.alias("a")
        .join(ix.embs.alias("b"), F.col("b.file_id") == F.col("a.file_id") + 1)
        .select("a.file_id", F.round(vc.dot(F.col("a.vector"), F.col("b.vector")), 6).alias("dot"))
    )
)
query(
    "vec02_normalize",
    "SELECT file_id, round(sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS length, CAST(1.0 AS DOUBLE) AS "
    "unit FROM embs",
    "embs",
)(
    lambda ix: ix.embs.select("file_id", F.round(vc.norm(F.col("vector")), 4).alias("length"), F.round(vc.norm(vc.normalize(F.col("vector"))), 6).alias("unit"))
)
query(
    "vec08_idf",
    f"WITH t AS (SELECT term, count(DISTINCT file_id) AS df FROM (SELECT file_id, unnest({_toks('extracted_text')}) AS term FROM files) x WHERE length(term) "
    f">= 3 GROUP BY 1), n AS (SELECT count(*) AS n FROM files) SELECT term, round(ln((n + 1.0) / (df + 1.0)) + 1.0, 6) AS idf FROM t, n WHERE ln((n + 1.0) / "
    f"(df + 1.0)) + 1.0 >= 1.8",
    "files",
)(
    lambda ix: (
        tg.document_frequencies(ix.files, F.col("extracted_text"), most=1 << 30)
        .crossJoin(F.broadcast(ix.files.agg(F.count("*").alias("n"))))
        .withColumn("idf", vc.smoothed_idf(F.col("n"), F.col("df")))
        .where("idf >= 1.8")
        .select("term", F.round("idf", 6).alias("idf"))
    )
)
query(
    "vec10_backoff",
    "SELECT queue_id, CAST(15000 * pow(2, least(retry_count, 4)) AS BIGINT) AS wait_ms FROM queue",
    "queue",
)(
    lambda ix: ix.queue.select("queue_id", vc.backoff_ms(F.col("retry_count")).alias("wait_ms"))
)
query(
    "vec03_half_round_trip",
    "SELECT file_id, CAST(64 AS INT) AS dim FROM embs",
    "embs",
)(
    lambda ix: (
        ix.embs.withColumn("back", vc.half_decode(vc.half_encode("vector"), F.col("dim")))
        .where(F.forall(F.zip_with("vector", "back", lambda a, b: F.abs(a - b) <= F.greatest(F.abs(a) / 1024, F.lit(6e-8))), lambda x: x))
        .select("file_id", "dim")
    )
)

# --- composite operators -------------------------------------------------------------------------

query(
    "ker01_changes",
    "SELECT coalesce(f.uri, d.uri) AS uri, f.file_id, CASE WHEN f.uri IS NULL THEN 'NEW' WHEN d.uri IS NULL THEN 'MISSING' WHEN f.size_bytes = d.size_bytes "
    "AND f.date_modified_source = d.date_modified_source THEN 'UNCHANGED' ELSE 'CHANGED' END AS change_type FROM discovered d FULL JOIN files f ON d.uri = "
    "f.uri",
    "discovered files",
)(
    lambda ix: sc.changes(ix.discovered, ix.files)
)
query(
    "dml24_sync_scan",
    "SELECT file_id, change_type FROM (SELECT f.file_id, 'CHANGED' AS change_type FROM discovered d JOIN files f ON d.uri = f.uri WHERE f.size_bytes <> "
    "d.size_bytes OR f.date_modified_source <> d.date_modified_source UNION ALL SELECT (SELECT max(file_id) FROM files) + row_number() OVER (ORDER BY "
    "d.uri), 'NEW' FROM discovered d WHERE d.uri NOT IN (SELECT uri FROM files)) t",
    "discovered files",
)(
    lambda ix: sc.sync_scan(ix.discovered, ix.files, NOW)[1]
)
query(
    "dml16_mark_missing",
    "SELECT file_id, is_deleted OR uri NOT IN (SELECT uri FROM discovered) AS is_deleted FROM files",
    "discovered files",
)(
    lambda ix: sc.mark_missing(ix.files, ix.discovered).select("file_id", "is_deleted")
)
query(
    "dml17_restore",
    "SELECT file_id, is_deleted AND uri NOT IN (SELECT uri FROM discovered) AS is_deleted FROM files",
    "discovered files",
)(
    lambda ix: sc.restore_present(ix.files, ix.discovered).select("file_id", "is_deleted")
)
query(
    "dml01_upsert",
    "SELECT album_id, CASE WHEN album_id BETWEEN 100 AND 103 THEN name || ' II' ELSE name END AS name FROM albums UNION ALL SELECT album_id + 10000, name "
    "FROM albums WHERE album_id = 1",
    "albums",
)(
    lambda ix: (
        st.upsert(ix.albums, ix.albums.where("album_id BETWEEN 100 AND 103").withColumn("name", F.concat("name", F.lit(" II"))).unionByName(ix.albums.where("album_id = 1").withColumn("album_id", F.col("album_id") + 10000)), ["album_id"])
        .select("album_id", "name")
    )
)
query(
    "dml06_upsert_assignment",
    "SELECT file_id, album_id, CASE WHEN file_id < 50 THEN 0.5 ELSE confidence END AS confidence, assigned_at FROM file_album UNION ALL SELECT file_id, "
    "album_id + 50, 0.5, CAST(9 AS BIGINT) FROM file_album WHERE file_id < 50",
    "file_album",
)(
    lambda ix: (
        st.upsert_assignment(ix.file_album, ix.file_album.where("file_id < 50").withColumns({"confidence": F.lit(0.5), "assigned_at": F.lit(9).cast("long")}).unionByName(ix.file_album.where("file_id < 50").withColumns({"album_id": F.col("album_id") + 50, "confidence": F.lit(0.5), "assigned_at": F.lit(9).cast("long")})))
        .select("file_id", "album_id", "confidence", "assigned_at")
    )
)
query(
    "dml08_insert_ignore_tag",
    "SELECT name FROM tags UNION SELECT 'extra'",
    "tags",
)(
    lambda ix: st.append_new(ix.tags, ix.spark.createDataFrame([("en",), ("extra",)], "name string"), ["name"]).select("name")
)
query(
    "dml10_delete_links",
    "SELECT file_id, tag_id FROM file_tag WHERE file_id NOT IN (SELECT file_id FROM files WHERE is_deleted)",
    "file_tag files",
)(
    lambda ix: st.delete_keys(ix.file_tag, ix.files.where("is_deleted"), ["file_id"]).select("file_id", "tag_id")
)
query(
    "dml12_mark_status",
    "SELECT file_id, CASE WHEN is_deleted THEN 'FAILED' ELSE processing_status END AS processing_status, CASE WHEN is_deleted THEN NULL ELSE last_error END "
    "AS last_error FROM files",
    "files",
)(
    lambda ix: (
        st.update_where(ix.files, F.col("is_deleted"), processing_status="FAILED", last_error=F.lit(None))
        .select("file_id", "processing_status", "last_error")
    )
)
query(
    "dml13_update_content",
    "SELECT file_id, CASE WHEN processing_status = 'DISCOVERED' THEN 'CONTENT_DONE' ELSE processing_status END AS processing_status, length(CASE WHEN "
    "processing_status = 'DISCOVERED' THEN 'x' ELSE extracted_text END) AS n FROM files",
    "files",
)(
    lambda ix: (
        st.update_from(ix.files, ix.files.where("processing_status = 'DISCOVERED'").select("file_id", F.lit("x").alias("extracted_text")), ["file_id"], {"processing_status": "CONTENT_DONE"})
        .select("file_id", "processing_status", F.length("extracted_text").cast("long").alias("n"))
    )
)
query(
    "dml14_sha256",
    "SELECT doc_id AS file_id, sha256(text) AS sha256_hash FROM documents",
)(
    lambda ix: ix.documents.select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("sha256_hash"))
)
query(
    "dml20_answer_suggestions",
    "SELECT suggestion_id, CASE WHEN status = 'PENDING' AND file_id % 2 = 0 THEN 'ACCEPTED' WHEN status = 'PENDING' THEN 'REJECTED' ELSE status END AS "
    "status FROM suggestions",
    "suggestions",
)(
    lambda ix: (
        al.answer(ix.suggestions, ix.suggestions.select("file_id", "suggested_album_id", F.when(F.col("file_id") % 2 == 0, "ACCEPTED").otherwise("REJECTED").alias("answer")))
        .select("suggestion_id", "status")
    )
)
query(
    "dml21_queue_transitions",
    f"SELECT queue_id, CASE queue_id % 3 WHEN 0 THEN 'DONE' WHEN 1 THEN 'FAILED' ELSE status END AS status, CASE WHEN queue_id % 3 = 1 THEN retry_count + 1 "
    f"ELSE retry_count END AS retry_count, CASE WHEN queue_id % 3 = 1 THEN CAST({NOW} + 15000 * pow(2, least(retry_count, 4)) AS BIGINT) ELSE "
    f"next_eligible_at END AS next_eligible_at FROM queue",
    "queue",
)(
    lambda ix: (
        qu.transition(ix.queue, ix.queue.where("queue_id % 3 < 2").select("queue_id", F.when(F.col("queue_id") % 3 == 0, "DONE").otherwise("FAILED").alias("result")), NOW)
        .select("queue_id", "status", "retry_count", "next_eligible_at")
    )
)
query(
    "dml_cascade_delete_album",
    "SELECT (SELECT count(*) FROM albums WHERE album_id <> 1) AS albums, (SELECT count(*) FROM albums WHERE album_id <> 1 AND (parent_album_id IS NULL OR "
    "parent_album_id = 1)) AS roots, (SELECT count(*) FROM file_album) AS links",
    "albums file_album",
)(
    lambda ix: _cascade(ix)
)
query(
    "ker02_category_scores",
    f"WITH {_hits_sql('extracted_text')}, {_SCORES} SELECT file_id, category, score FROM scores",
    "files",
)(
    lambda ix: cl.category_scores(ix.files, F.col("extracted_text")).select("file_id", "category", "score")
)
query(
    "ker02_predict",
    f"WITH {_hits_sql('extracted_text')}, {_SCORES} SELECT f.file_id, p.category, coalesce(p.score, 0.0) AS keyword_score, array_to_string(p.terms, ',') AS "
    f"terms FROM files f LEFT JOIN pred p ON p.file_id = f.file_id",
    "files",
)(
    lambda ix: (
        cl.predict_category(ix.files, F.col("extracted_text"))
        .select("file_id", "category", "keyword_score", F.when(F.col("matched_terms").isNotNull(), F.array_join("matched_terms", ",")).alias("terms"))
    )
)
_TEXT_VIEW = "nt AS (SELECT file_id, doc_type, display_name || coalesce(chr(10) || substr(extracted_text, 1, 6000), '') AS txt FROM files)"
_CONF = "least(greatest(round((0.45 * p.score + 0.35 * coalesce(c.s, 0) + 0.05 * 0.5) / (0.45 + CASE WHEN c.s IS NULL THEN 0 ELSE 0.35 END + 0.05), 6), 0.0), 1.0)"
query(
    "ker08_decide",
    f"WITH {_TEXT_VIEW}, {_hits_sql('txt', 'nt')}, {_SCORES}, {_CENTROIDS}, c AS (SELECT e.file_id, round(least(greatest(max("
    + _DOT.format(a="e.vector", b="k.centroid")
    + (f"), 0.0), 1.0), 6) AS s FROM embs e, ce k GROUP BY 1), d AS (SELECT n.file_id, CASE WHEN p.category IS NULL AND n.doc_type = 'IMAGE' THEN 205 WHEN "
    f"p.category IS NOT NULL THEN a.album_id END AS album_id, CAST(CASE WHEN p.category IS NULL AND n.doc_type = 'IMAGE' THEN 0.9 WHEN p.category IS NOT "
    f"NULL THEN {_CONF} ELSE 0.0 END AS DOUBLE) AS confidence FROM nt n LEFT JOIN pred p ON p.file_id = n.file_id LEFT JOIN albums a ON a.name = p.category "
    f"AND a.parent_album_id IS NULL LEFT JOIN c ON c.file_id = n.file_id) SELECT file_id, album_id, confidence, CASE WHEN album_id IS NULL THEN 'NONE' WHEN "
    f"confidence >= 0.85 THEN 'ASSIGN' WHEN confidence >= 0.6 THEN 'SUGGEST' ELSE 'NONE' END AS decision FROM d"),
    "files albums embs file_album",
)(
    lambda ix: (
        cl.decide(ix.files, ix.albums, tx.classification_text(F.col("display_name"), F.col("extracted_text")), None, cl.centroid_evidence(ix.embs, _album_centroids(ix)))
        .select("file_id", "album_id", "confidence", "decision")
    )
)
query(
    "ker09_tags",
    f"WITH {_LEX}, tk AS (SELECT file_id, {_toks('extracted_text')} AS toks FROM files), ex AS (SELECT file_id, unnest(toks) AS term, unnest(range(0, "
    f"len(toks))) AS pos FROM tk), tf AS (SELECT file_id, term, count(*) AS tf, min(pos) AS first FROM ex GROUP BY 1, 2), dt AS (SELECT DISTINCT term AS "
    f"gram FROM tf), dm AS (SELECT g.gram, l.* FROM dt g JOIN lex l ON {_MATCH}), lt AS (SELECT file_id, "
    f"array_to_string(list_transform(string_split(dm.term, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS tag, dm.weight * (1 + 0.2 * least(sum(tf) - 1, 3)) "
    f"AS score, cat_ord * 1000 + term_ord AS rk FROM tf JOIN dm ON dm.gram = tf.term GROUP BY file_id, dm.term, dm.weight, cat_ord, term_ord), sa AS (SELECT "
    f"file_id FROM files WHERE length(extracted_text) > 0 ORDER BY date_first_indexed DESC, file_id LIMIT 300), df AS (SELECT term, count(DISTINCT file_id) "
    f"AS df FROM (SELECT file_id, unnest({_toks('substr(extracted_text, 1, 10000)')}) AS term FROM files WHERE file_id IN (SELECT file_id FROM sa)) x WHERE "
    f"length(term) >= 3 GROUP BY 1), nn AS (SELECT count(*) AS n FROM sa), ct AS (SELECT file_id, tf.term AS tag, ln(1 + tf) * (ln((n + 1.0) / (coalesce(df, "
    f"0) + 1.0)) + 1.0) AS score, {len(lx.LEXICON) * 1000} + first AS rk FROM tf LEFT JOIN df ON df.term = tf.term, nn WHERE length(tf.term) >= 4 AND ln((n "
    f"+ 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 >= 1.8), al AS (SELECT file_id, tag, max(score) AS score, min(rk) AS rk FROM (SELECT * FROM lt UNION ALL "
    f"SELECT * FROM ct) u GROUP BY 1, 2), rn AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY round(score, 6) DESC, rk, tag) AS rank FROM al) "
    f"SELECT file_id, tag, round(score, 6) AS score FROM rn WHERE rank <= 10",
    "files",
)(
    lambda ix: (
        tg.extract_tags(ix.files, F.col("extracted_text"), rd.text_sample(ix.files, 300), F.col("extracted_text"), spans=False)
        .select("file_id", "tag", "score")
    )
)
query(
    "ker11_greedy_clusters",
)(
    lambda ix: cu.cluster_candidates(rd.live(ix.files).where(F.col("processing_status").isin("CONTENT_DONE", "CLASSIFIED") & F.col("primary_album_id").isNull()), F.col("extracted_text"))
)
query(
    "ker12_verdicts",
    "WITH co AS (SELECT a.album_id, count(DISTINCT a.file_id) AS n, avg("
    + _DOT.format(a="ea.vector", b="eb.vector")
    + (") AS c FROM file_album a JOIN file_album b ON a.album_id = b.album_id AND a.file_id <> b.file_id JOIN embs ea ON ea.file_id = a.file_id JOIN embs eb "
    "ON eb.file_id = b.file_id GROUP BY 1) SELECT album_id, n, CASE WHEN n >= 5 AND round(c, 6) >= 0.78 THEN 'AUTO_CREATE' WHEN n >= 3 AND round(c, 6) >= "
    "0.65 THEN 'SUGGEST_TO_USER' ELSE 'KEEP_UNCATEGORIZED' END AS verdict FROM co"),
    "embs file_album",
)(
    lambda ix: (
        cu.cohesion(ix.embs.join(ix.file_album.select("file_id", "album_id"), "file_id"), "album_id")
        .where("n > 1")
        .select("album_id", "n", cu.verdict(F.col("n"), F.col("cohesion"), F.lit(0.2)).alias("verdict"))
    )
)
query("ker13_reconcile")(lambda ix: cu.reconcile(ix.files, ix.embs, ix.albums, _album_centroids(ix)).withColumn("file_ids", F.array_join("file_ids", ",")))
query(
    "ker16_parent_albums",
    f"WITH nm AS (SELECT primary_album_id AS file_id, string_agg(display_name, chr(10) ORDER BY file_id) AS names FROM files WHERE primary_album_id IS NOT "
    f"NULL GROUP BY 1), {_hits_sql('names', 'nm')}, {_SCORES} SELECT nm.file_id AS cluster, a.album_id AS parent_album_id FROM nm LEFT JOIN pred p ON "
    f"p.file_id = nm.file_id LEFT JOIN albums a ON a.name = p.category AND a.parent_album_id IS NULL",
    "files albums",
)(
    lambda ix: cu.parent_albums(ix.files.where("primary_album_id IS NOT NULL").withColumn("cluster", F.col("primary_album_id")), ix.albums)
)
query(
    "ker17_seed_albums",
    "SELECT name FROM albums WHERE album_id NOT IN (203, 204) UNION SELECT unnest(['Education', 'Career', 'Finance', 'Identity', 'Photos', "
    "'Uncategorized'])",
    "albums",
)(
    lambda ix: al.seed(ix.albums.where("album_id NOT IN (203, 204)"), NOW).select("name")
)
query(
    "ker18_assign",
    "SELECT f.file_id, CASE WHEN x.file_id IS NULL THEN f.primary_album_id ELSE x.album_id END AS primary_album_id FROM files f LEFT JOIN file_album x ON "
    "x.file_id = f.file_id",
    "files file_album",
)(
    lambda ix: al.assign(ix.files, ix.file_album.limit(0), ix.file_album)[0].select("file_id", "primary_album_id")
)
query(
    "ker19_create_album",
    "SELECT name FROM albums UNION SELECT 'Holiday'",
    "albums",
)(
    lambda ix: al.create(al.create(ix.albums, "Holiday", None, NOW), "Finance", None, NOW).select("name")
)
query(
    "ker20_album_tree",
    "WITH RECURSIVE ct AS (SELECT album_id, count(*) AS n FROM file_album GROUP BY 1), tr AS (SELECT album_id, name, 0 AS depth, name AS path FROM albums "
    "WHERE parent_album_id IS NULL UNION ALL SELECT a.album_id, a.name, tr.depth + 1, tr.path || ' / ' || a.name FROM albums a JOIN tr ON a.parent_album_id "
    "= tr.album_id) SELECT tr.album_id, tr.name, coalesce(ct.n, 0) AS file_count, tr.depth, tr.path FROM tr LEFT JOIN ct ON ct.album_id = tr.album_id",
    "albums file_album",
)(
    lambda ix: al.tree(ix.albums, rd.album_counts(ix.albums, ix.file_album))
)
query(
    "ker21_offer",
    "SELECT file_id, suggested_album_id, status FROM suggestions UNION ALL SELECT file_id, 100 + (file_id + 1) % 25, 'PENDING' FROM files f WHERE NOT "
    "EXISTS (SELECT 1 FROM suggestions s WHERE s.file_id = f.file_id AND s.status = 'PENDING') AND NOT EXISTS (SELECT 1 FROM suggestions s WHERE s.file_id "
    "= f.file_id AND s.status = 'REJECTED' AND s.suggested_album_id = 100 + (f.file_id + 1) % 25)",
    "suggestions files",
)(
    lambda ix: (
        al.offer(ix.suggestions, ix.files.select("file_id", (100 + (F.col("file_id") + 1) % 25).alias("suggested_album_id"), F.lit(0.7).alias("confidence")))
        .select("file_id", "suggested_album_id", "status")
    )
)
query(
    "ker22_accept",
    "SELECT file_id, album_id FROM file_album UNION SELECT file_id, suggested_album_id FROM suggestions WHERE status = 'PENDING'",
    "file_album suggestions",
)(
    lambda ix: al.accept(ix.files, ix.file_album, ix.suggestions, ix.suggestions.select("file_id", "suggested_album_id"), NOW)[1].select("file_id", "album_id")
)
query(
    "ker23_enqueue",
    "SELECT file_id, count(*) AS n FROM (SELECT file_id FROM queue UNION ALL SELECT file_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM queue q WHERE "
    "q.file_id = f.file_id AND q.status IN ('PENDING', 'IN_PROGRESS'))) t GROUP BY 1",
    "queue files",
)(
    lambda ix: qu.enqueue(ix.queue, ix.files, 4).groupBy("file_id").agg(F.count("*").alias("n"))
)
query(
    "ker24_drain",
    f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN (status = 'PENDING' OR (status = 'FAILED' AND retry_count < 3)) AND next_eligible_at <= {NOW} THEN "
    f"CASE WHEN file_id % 10 = 9 THEN 'FAILED' ELSE 'DONE' END ELSE status END AS status FROM queue) t GROUP BY 1",
    "queue",
)(
    lambda ix: _drained(ix).groupBy("status").agg(F.count("*").alias("n"))
)
query(
    "ker26_extraction",
    "SELECT file_id, CASE WHEN doc_type = 'PDF' AND length(trim(extracted_text)) > 0 AND length(extracted_text) >= 100 THEN 'TEXT_LAYER' WHEN doc_type IN "
    "('PDF', 'IMAGE') THEN 'OCR' ELSE 'NONE' END AS source FROM files",
    "files",
)(
    lambda ix: ex.dispatch(ix.files.withColumns({"text_layer": F.col("extracted_text"), "ocr_text": F.lit("ocr")})).select("file_id", "source")
)
query(
    "ker30_all_centroids",
    "SELECT album_id, count(*) AS n FROM embs e JOIN file_album a ON a.file_id = e.file_id GROUP BY 1",
    "embs file_album",
)(
    lambda ix: _album_centroids(ix).select("album_id", "n")
)
query(
    "ker31_permissions",
    "SELECT folder_uri, CASE WHEN permission_state <> 'REVOKED' THEN 'ACTIVE' ELSE 'NEEDS_REGRANT' END AS permission_state FROM folders",
    "folders",
)(
    lambda ix: sc.refresh_permissions(ix.folders, ix.folders.where("permission_state != 'REVOKED'"), NOW).select("folder_uri", "permission_state")
)
query(
    "ker35_corrections",
    "SELECT file_id, CASE WHEN primary_album_id IS NULL THEN 101 ELSE primary_album_id END AS primary_album_id FROM files",
    "files",
)(
    lambda ix: al.correct(ix.files, ix.file_album, ix.spark.createDataFrame([], st_corrections()), ix.files.where("primary_album_id IS NULL").select("file_id", F.lit(101).cast("long").alias("album_id")), NOW)[0].select("file_id", "primary_album_id")
)
query(
    "ker36_nudge",
    "SELECT a.file_id, round(list_sum(list_transform(range(1, 65), lambda i: a.vector[i] + 0.05 * (CAST(b.vector[i] AS DOUBLE) - a.vector[i]))), 4) AS "
    "total FROM embs a JOIN embs b ON b.file_id = a.file_id + 1",
    "embs",
)(
    lambda ix: (
        ix.embs.alias("a")
        .join(ix.embs.alias("b"), F.col("b.file_id") == F.col("a.file_id") + 1)
        .select("a.file_id", F.round(F.aggregate(al.nudge(F.col("a.vector"), F.col("b.vector"), 0.05), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))
    )
)
query(
    "ker37_purge",
    "SELECT file_id FROM files WHERE NOT (is_deleted AND date_modified_source < 1700000300000)",
    "files",
)(
    lambda ix: qu.purge(ix.files, 1_700_000_400_000, 100_000).select("file_id")
)
_BQ = "bq AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_KW = "kw AS (SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(translate(query, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\u0080-\U0010ffff]+'), lambda w: w <> '')) AS term FROM bq), kz AS (SELECT query_id, count(*) AS n FROM kw GROUP BY 1), iw AS (SELECT DISTINCT file_id, unnest(list_filter(string_split_regex(translate(display_name || ' ' || extracted_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\u0080-\U0010ffff]+'), lambda w: w <> '')) AS term FROM files), ks AS (SELECT kw.query_id, iw.file_id, round(count(*) / CAST(min(kz.n) AS DOUBLE), 6) AS keyword FROM iw JOIN kw ON kw.term = iw.term JOIN kz ON kz.query_id = kw.query_id GROUP BY 1, 2)"


def _benchmark_queries(ix: Index) -> DataFrame:
    return ix.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _hybrid(ix: Index) -> DataFrame:
    keyword = se.keyword_scores(se.inverted_index(ix.files), _benchmark_queries(ix))
    vectors = ix.embs.join(ix.benchmark.select(F.col("item_id").alias("query_id")), F.col("file_id") == F.col("query_id")).select("query_id", "vector")
    semantic = se.nearest(vectors, ix.embs, 30).select("query_id", "file_id", F.col("score").alias("semantic"))
    none = ix.files.select(F.col("file_id").alias("query_id"), "file_id").where("file_id < 0")
    return se.hybrid(keyword, semantic, none.withColumn("filename", F.lit(0.0)), none.withColumn("metadata", F.lit(0.0)))


query(
    "ker32_keyword_scores",
    f"WITH {_BQ}, {_KW} SELECT query_id, file_id, keyword FROM ks WHERE keyword >= 0.3",
    "files",
)(
    lambda ix: se.keyword_scores(se.inverted_index(ix.files), _benchmark_queries(ix)).where("keyword >= 0.3")
)
query(
    "ker32_hybrid",
    (f"WITH {_BQ}, {_KW}, kt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY keyword DESC, file_id) AS r FROM ks), sm AS (SELECT q.file_id AS "
    f"query_id, e.file_id, round(")
    + _DOT.format(a="q.vector", b="e.vector")
    + (", 6) AS semantic FROM embs q JOIN embs e ON q.file_id <> e.file_id WHERE q.file_id IN (SELECT item_id FROM benchmark)), st AS (SELECT *, row_number() "
    "OVER (PARTITION BY query_id ORDER BY semantic DESC, file_id) AS r FROM sm), cd AS (SELECT query_id, file_id FROM kt WHERE r <= 30 UNION SELECT "
    "query_id, file_id FROM st WHERE r <= 30) SELECT cd.query_id, cd.file_id, CAST(floor(10000 * (0.30 * least(greatest(coalesce(keyword, 0.0), 0.0), 1.0) "
    "+ 0.40 * least(greatest(coalesce(st.semantic, 0.0), 0.0), 1.0)) + 0.0005) AS BIGINT) AS score_e4 FROM cd LEFT JOIN ks ON ks.query_id = cd.query_id AND "
    "ks.file_id = cd.file_id LEFT JOIN (SELECT * FROM st WHERE r <= 30) st ON st.query_id = cd.query_id AND st.file_id = cd.file_id"),
    "files embs",
)(
    lambda ix: _hybrid(ix).select("query_id", "file_id", F.floor(F.col("score") * 10000 + 0.0005).alias("score_e4"))
)


def st_corrections() -> str:
    return "correction_id long, file_id long, previous_album_id long, corrected_album_id long, correction_type string, timestamp long"


def _cascade(ix: Index) -> DataFrame:
    out = st.delete_cascade({"albums": ix.albums, "file_album": ix.file_album}, "albums", ix.spark.createDataFrame([(1,)], "album_id long"))
    a = out["albums"].agg(F.count("*").alias("albums"), F.count_if(F.col("parent_album_id").isNull()).alias("roots"))
    return a.crossJoin(out["file_album"].agg(F.count("*").alias("links")))


def _drained(ix: Index) -> DataFrame:
    ok = lambda files: files.select("file_id", (F.col("file_id") % 10 != 9).alias("ok"))
    return qu.drain(ix.queue, ix.files, {2: ok, 3: ok, 4: ok}, NOW)[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return found()[0]


def oracle_sql() -> dict[str, str]:
    return found()[1]
