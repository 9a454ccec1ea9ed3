"""Registered writes, reads and counts of the file index that the catalog has not, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.fixtures import Index
from corvane.functions import lexicon as lx
from corvane.functions.lexicon import categories_of
from corvane.functions.wordpiece import load_vocabulary
from corvane.operators import albums as al
from corvane.operators import cluster as cu
from corvane.operators import extract as ex
from corvane.operators import reads as rd
from corvane.operators import scan as sc
from corvane.operators import search as se
from corvane.operators import store as st
from corvane.plans.registry import NOW, query
from corvane.runtime import Workspace
from corvane.schema import Settings, settings_rows
from corvane.sources import discovery as di

# --- sources -------------------------------------------------------------------------------------


#: Where a document's file lies: in plain, hidden, thumbnail, underscored and deep folders, under plain, hidden and underscored names.
_PLACE = """source || '/' || CASE doc_id % 11 WHEN 0 THEN '.trash/' WHEN 1 THEN '.thumbnails/' WHEN 2 THEN '_archive/' WHEN 3 THEN 'a/b/c/' WHEN 4 THEN 'a/b/c/d/' WHEN 5 THEN '.git/a/' ELSE '' END
  || CASE doc_id % 5 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END || 'doc' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.PDF' ELSE '' END"""


@query(
    "src01_tree_walk",
    f"""WITH p AS (SELECT {_PLACE} AS place, strlen(text) AS size_bytes, doc_id FROM documents)
       SELECT place, regexp_extract(place, '[^/]*$') AS display_name, CASE doc_id % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime_type,
         size_bytes, CAST(length(place) - length(replace(place, '/', '')) AS INT) AS depth FROM p WHERE doc_id % 11 NOT IN (0, 1, 4, 5)""",
)
def _tree_walk(ix: Index) -> DataFrame:
    """A tree with a file for every document; four folders deep."""
    root = Workspace(ix.spark, "tree").path("tree")
    places = ix.documents.select(F.expr(_PLACE).alias("place"), F.encode("text", "UTF-8").alias("content"))

    def write(batches):
        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = di.file_system(f"{root}/{place}")
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(content)
            yield batch.select(["place"])

    places.mapInArrow(write, "place string").write.format("noop").mode("overwrite").save()
    found = di.walk_tree(ix.spark, root, max_depth=4)
    return found.select(F.element_at(F.split("uri", "/tree/"), -1).alias("place"), "display_name", "mime_type", "size_bytes", "depth")


@query(
    "src06_vocabulary",
    """WITH l AS (SELECT n_nationkey AS pos, n_name AS piece FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region UNION ALL SELECT 200 + n_nationkey, n_name FROM nation WHERE n_nationkey % 5 = 0),
         f AS (SELECT piece, min(pos) AS first, max(pos) AS last FROM l GROUP BY 1)
       SELECT a.piece, (SELECT count(*) FROM f b WHERE b.first < a.last) AS id FROM f a""",
)
def _vocabulary(ix: Index) -> DataFrame:
    """A file of one piece a line, some of them twice."""
    again = ix.nation.where("n_nationkey % 5 = 0").select((F.col("n_nationkey") + 200).alias("pos"), F.col("n_name").alias("piece"))
    lines = ix.nation.select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("piece")).unionByName(ix.region.select((F.col("r_regionkey") + 100).alias("pos"), F.col("r_name").alias("piece"))).unionByName(again)
    work = Workspace(ix.spark, "vocabulary")
    lines.coalesce(1).sortWithinPartitions("pos").select("piece").write.text(work.path("pieces"))
    return ix.spark.createDataFrame(list(load_vocabulary(ix.spark, work.path("pieces")).items()), "piece string, id long")


_SETTINGS = {**{f: str(getattr(Settings(), f)) for f in Settings.__dataclass_fields__}, "related_top_k": "3", "cloud_enabled": "True"}


@query(
    "src07_settings",
    "WITH d AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _SETTINGS.items()) + """) t(name, value)),
         u AS (SELECT 'new_album_min_cluster_size' AS name, CAST(count(*) AS VARCHAR) AS value FROM region UNION ALL SELECT 'ocr_max_pages_per_doc', CAST(max(n_nationkey) AS VARCHAR) FROM nation
           UNION ALL SELECT 'setting_' || n_nationkey, n_name FROM nation)
       SELECT name, coalesce(u.value, d.value) AS value FROM d FULL JOIN u USING (name)""",
)
def _settings(ix: Index) -> DataFrame:
    """Settings as a table of names and values: defaults and what the session overrides, then updates twice; read as a whole."""
    for key, value in (("related_top_k", "3"), ("cloud_enabled", "true")):
        ix.spark.conf.set(f"corvane.{key}", value)
    stored = st.ChangeTable(ix.spark, Workspace(ix.spark, "settings").path("t"), ["name"])
    stored.write(settings_rows(ix.spark))
    for key in ("related_top_k", "cloud_enabled"):
        ix.spark.conf.unset(f"corvane.{key}")
    named = ix.nation.select(F.concat(F.lit("setting_"), F.col("n_nationkey")).alias("name"), "n_name")
    stored.merge(named.select("name", F.lower("n_name").alias("value")).unionByName(ix.region.agg(F.lit("new_album_min_cluster_size").alias("name"), F.count("*").cast("string").alias("value"))))
    stored.merge(named.select("name", F.col("n_name").alias("value")).unionByName(ix.nation.agg(F.lit("ocr_max_pages_per_doc").alias("name"), F.max("n_nationkey").cast("string").alias("value"))))
    return stored.read()


query(
    "src08_image_sample",
    """WITH s AS (SELECT p_partkey, p_partkey * 7 % 9000 AS w, p_size * 170 AS h FROM part)
       SELECT p_partkey, CAST((SELECT min(x) FROM unnest([1, 2, 4, 8, 16, 32]) u(x) WHERE greatest(w, h) // x <= 1024 AND w > 0 AND h > 0) AS INT) AS sample FROM s""",
)(lambda ix: ix.part.select("p_partkey", di.subsample(F.col("p_partkey") * 7 % 9000, F.col("p_size") * 170).alias("sample")))

# --- writes --------------------------------------------------------------------------------------

query(
    "dml01_upsert_file",
    """SELECT file_id, CASE WHEN file_id % 17 = 0 THEN 'renamed' ELSE display_name END AS display_name, processing_status FROM files
       UNION ALL SELECT file_id + 100000000, display_name, processing_status FROM files WHERE file_id % 50 = 0""",
    "files",
)(
    lambda ix: st.upsert(
        ix.files,
        ix.files.where("file_id % 17 = 0").withColumn("display_name", F.lit("renamed")).unionByName(ix.files.where("file_id % 50 = 0").withColumn("file_id", F.col("file_id") + 100000000)),
        ["file_id"],
    ).select("file_id", "display_name", "processing_status")
)
query(
    "dml02_upsert_album",
    """SELECT album_id, name, CASE WHEN album_id % 4 = 0 THEN 203 ELSE parent_album_id END AS parent_album_id, CASE WHEN album_id % 4 = 0 THEN 'USER_CREATED' ELSE type END AS type FROM albums
       UNION ALL SELECT album_id + 5000, name, parent_album_id, type FROM albums WHERE parent_album_id = 2""",
    "albums",
)(
    lambda ix: st.upsert(
        ix.albums,
        ix.albums.where("album_id % 4 = 0").withColumns({"parent_album_id": F.lit(203).cast("long"), "type": F.lit("USER_CREATED")}).unionByName(ix.albums.where("parent_album_id = 2").withColumn("album_id", F.col("album_id") + 5000)),
        ["album_id"],
    ).select("album_id", "name", "parent_album_id", "type")
)
query(
    "dml03_upsert_embedding",
    """SELECT file_id, model_version, CASE WHEN file_id % 10 = 0 THEN 1 ELSE dim END AS dim, CASE WHEN file_id % 10 = 0 THEN 0.5 ELSE round(CAST(vector[1] AS DOUBLE), 6) END AS first FROM embs
       UNION ALL SELECT file_id, 'm2', 1, 0.5 FROM embs WHERE file_id % 15 = 0""",
    "embs",
)(
    lambda ix: st.upsert(
        ix.embs,
        (lambda rows: rows.where("file_id % 10 = 0").unionByName(rows.where("file_id % 15 = 0").withColumn("model_version", F.lit("m2"))))(ix.embs.withColumns({"dim": F.lit(1), "vector": F.array(F.lit(0.5)).cast("array<float>")})),
        ["file_id", "model_version"],
    ).select("file_id", "model_version", "dim", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))
)
query(
    "dml04_upsert_folder",
    """SELECT folder_uri, CASE WHEN permission_state = 'REVOKED' THEN 'ACTIVE' ELSE permission_state END AS permission_state, CASE WHEN permission_state = 'REVOKED' THEN 7 ELSE granted_at END AS granted_at FROM folders
       UNION ALL SELECT 'content://tree/NEW', 'ACTIVE', 7""",
    "folders",
)(
    lambda ix: st.upsert(
        ix.folders,
        ix.folders.where("permission_state = 'REVOKED'").unionByName(ix.folders.limit(1).withColumn("folder_uri", F.lit("content://tree/NEW"))).withColumns({"permission_state": F.lit("ACTIVE"), "granted_at": F.lit(7).cast("long")}),
        ["folder_uri"],
    ).select("folder_uri", "permission_state", "granted_at")
)
query(
    "dml05_insert_queue",
    """SELECT queue_id, file_id, status FROM queue
       UNION ALL SELECT (SELECT max(queue_id) FROM queue) + row_number() OVER (ORDER BY file_id), file_id, 'PENDING' FROM files WHERE file_id % 20 = 0""",
    "queue files",
)(lambda ix: st.append(ix.queue, ix.files.where("file_id % 20 = 0").select("file_id", F.lit("PENDING").alias("status")), "queue_id", ["file_id"]).select("queue_id", "file_id", "status"))
query(
    "dml07_insert_suggestion",
    """SELECT suggestion_id, file_id, suggested_album_id, status FROM suggestions
       UNION ALL SELECT (SELECT max(suggestion_id) FROM suggestions) + row_number() OVER (ORDER BY file_id), file_id, 101, 'PENDING' FROM files WHERE file_id % 30 = 0""",
    "suggestions files",
)(
    lambda ix: st.append(
        ix.suggestions, ix.files.where("file_id % 30 = 0").select("file_id", F.lit(101).cast("long").alias("suggested_album_id"), F.lit("PENDING").alias("status")), "suggestion_id", ["file_id"]
    ).select("suggestion_id", "file_id", "suggested_album_id", "status")
)
query(
    "dml09_insert_link",
    """SELECT file_id, tag_id, confidence FROM file_tag
       UNION ALL SELECT file_id, 1, 0.1 FROM files f WHERE file_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM file_tag x WHERE x.file_id = f.file_id AND x.tag_id = 1)""",
    "file_tag files",
)(lambda ix: st.append_new(ix.file_tag, ix.files.where("file_id % 3 = 0").select("file_id", F.lit(1).cast("long").alias("tag_id"), F.lit(0.1).alias("confidence")), ["file_id", "tag_id"]).select("file_id", "tag_id", "confidence"))
query(
    "dml11_tags_concat",
    """SELECT f.file_id, CASE WHEN f.file_id % 2 = 0 THEN (SELECT string_agg(t.name, ' ' ORDER BY t.name) FROM file_tag x JOIN tags t ON t.tag_id = x.tag_id WHERE x.file_id = f.file_id AND x.file_id % 4 <> 0) ELSE 'as it was' END AS tags_concat FROM files f""",
    "files file_tag tags",
)(
    lambda ix: st.update_from(
        ix.files.withColumn("tags_concat", F.lit("as it was")), rd.tags_concat(ix.files.where("file_id % 2 = 0"), ix.file_tag.where("file_id % 4 != 0"), ix.tags), ["file_id"]
    ).select("file_id", "tags_concat")
)
query(
    "dml15_mark_failed",
    """SELECT file_id, CASE WHEN doc_type = 'PDF' THEN 'FAILED' ELSE processing_status END AS processing_status, CASE WHEN doc_type = 'PDF' THEN 'cannot read ' || file_id ELSE last_error END AS last_error FROM files""",
    "files",
)(lambda ix: st.mark_failed(ix.files, ix.files.where("doc_type = 'PDF'").select("file_id", F.concat(F.lit("cannot read "), "file_id").alias("error"))).select("file_id", "processing_status", "last_error"))
query(
    "dml18_album_centroid_confidence",
    """SELECT album_id, CASE WHEN album_id BETWEEN 100 AND 109 THEN album_id / 1e3 ELSE 0.25 END AS first, CASE WHEN album_id = 101 THEN 0.75 ELSE confidence END AS confidence FROM albums""",
    "albums",
)(
    lambda ix: al.set_confidence(
        al.set_centroids(
            ix.albums.withColumn("centroid", F.array(F.lit(0.25))),
            ix.albums.where("album_id BETWEEN 100 AND 115").select("album_id", F.when(F.col("album_id") < 110, F.array(F.col("album_id") / 1000.0)).alias("centroid")),
        ),
        101,
        0.75,
    ).select("album_id", F.col("centroid")[0].alias("first"), "confidence")
)
query(
    "dml19_primary_album",
    """WITH r AS (SELECT file_id, 100 + file_id % 7 AS album_id, 0.5 + (file_id % 5) / 1e1 AS confidence, 5 AS since FROM files WHERE file_id % 4 = 0 UNION ALL SELECT file_id, 120, 0.25, 9 FROM files WHERE file_id % 8 = 0),
         l AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY since DESC) AS r FROM r)
       SELECT f.file_id, coalesce(l.album_id, f.primary_album_id) AS primary_album_id, coalesce(l.confidence, f.classification_confidence) AS classification_confidence FROM files f LEFT JOIN l ON l.file_id = f.file_id AND l.r = 1""",
    "files",
)(lambda ix: al.assign(ix.files, ix.file_album, _assignments(ix))[0].select("file_id", "primary_album_id", "classification_confidence"))


def _assignments(ix: Index) -> DataFrame:
    """Two rounds of assignments, the later one of fewer files."""
    row = lambda files, album, confidence, at: files.select("file_id", album.cast("long").alias("album_id"), confidence.alias("confidence"), F.lit("AUTO").alias("assigned_by"), F.lit(at).cast("long").alias("assigned_at"))
    first = row(ix.files.where("file_id % 4 = 0"), 100 + F.col("file_id") % 7, 0.5 + F.col("file_id") % 5 / 10.0, 5)
    return first.unionByName(row(ix.files.where("file_id % 8 = 0"), F.lit(120), F.lit(0.25), 9))


query(
    "dml22_folders",
    f"""SELECT folder_uri, CASE WHEN permission_state = 'ACTIVE' THEN 'ACTIVE' ELSE 'NEEDS_REGRANT' END AS permission_state, {NOW} AS last_validated_at FROM folders WHERE folder_uri NOT LIKE '%A'""",
    "folders",
)(lambda ix: sc.remove_folders(sc.refresh_permissions(ix.folders, ix.folders.where("permission_state = 'ACTIVE'"), NOW), ix.folders.where("folder_uri LIKE '%A'")).select("folder_uri", "permission_state", "last_validated_at"))
query(
    "dml23_purge_model",
    "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN NULL ELSE 'm2' END AS model_version FROM embs WHERE file_id % 3 < 2",
    "embs",
)(lambda ix: st.purge_model(ix.embs.withColumn("model_version", F.when(F.col("file_id") % 3 == 1, "m2").when(F.col("file_id") % 3 == 2, "m1")), "m1").select("file_id", "model_version"))

# --- reads, counts and pages ---------------------------------------------------------------------

query("flt19_albums_with_centroid", "SELECT album_id, name FROM albums WHERE album_id IN (SELECT album_id FROM file_album)", "albums file_album")(
    lambda ix: rd.albums_with_centroid(ix.albums.join(cu.mean_vectors(ix.embs.join(ix.file_album.select("file_id", "album_id"), "file_id"), "album_id"), "album_id", "left")).select("album_id", "name")
)
_FIND = "list_contains(string_split_regex(lower(extracted_text), '[^a-z0-9\u0080-\U0010ffff]+'), 'that')"
query("join07_match_files", f"SELECT file_id, display_name FROM files WHERE NOT is_deleted AND {_FIND}", "files")(
    lambda ix: se.matching_files(se.inverted_index(ix.files), ix.files, "text:that").select("file_id", "display_name")
)
query("agg02_indexed", "SELECT count(*) FILTER (NOT is_deleted AND processing_status = 'INDEXED') AS n FROM files", "files")(lambda ix: rd.status_counts(ix.files, ix.queue).select(F.col("indexed").alias("n")))
query("agg03_uncategorised", "SELECT count(*) AS n FROM files WHERE NOT is_deleted AND primary_album_id IS NULL", "files")(lambda ix: rd.status_counts(ix.files, ix.queue).select(F.col("uncategorised").alias("n")))
query("agg04_files_per_album", "SELECT album_id, count(*) AS file_count FROM file_album GROUP BY 1", "file_album")(lambda ix: rd.album_counts(ix.albums, ix.file_album).where("file_count > 0").select("album_id", "file_count"))
query(
    "agg09_snapshot",
    "SELECT (SELECT count(*) FROM queue WHERE status IN ('PENDING', 'IN_PROGRESS')) AS pending, CAST(0 AS BIGINT) AS in_progress, count(*) FILTER (NOT is_deleted AND processing_status = 'INDEXED') AS indexed FROM files",
    "files queue",
)(lambda ix: rd.status_counts(ix.files, ix.queue).select("pending", "in_progress", "indexed"))
query(
    "agg13_mean_vectors",
    """WITH v AS (SELECT file_id, file_id % 7 AS g, CASE WHEN file_id % 14 = 0 THEN vector[1:32] ELSE vector END AS vector FROM embs),
         p AS (SELECT g, i, sum(CAST(vector[i] AS DOUBLE)) AS s FROM v, range(1, 65) t(i) GROUP BY 1, 2), l AS (SELECT g, sqrt(sum(s * s)) AS l FROM p GROUP BY 1), z AS (SELECT g, count(*) AS n, min(len(vector)) AS low, max(len(vector)) AS high FROM v GROUP BY 1)
       SELECT z.g, z.n, i AS pos, CASE WHEN low = high THEN round(s / l, 5) + 0.0 END AS x FROM z JOIN p ON p.g = z.g JOIN l ON l.g = z.g WHERE i <= 3""",
    "embs",
)(
    lambda ix: cu.mean_vectors(ix.embs.select((F.col("file_id") % 7).alias("g"), F.when(F.col("file_id") % 14 == 0, F.slice("vector", 1, 32)).otherwise(F.col("vector")).alias("vector")), "g")
    .select("g", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("pos"), "centroid")
    .select("g", "n", "pos", (F.round(F.get("centroid", F.col("pos").cast("int") - 1), 5) + F.lit(0.0)).alias("x"))
)
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.vector[i] AS DOUBLE) * CAST(b.vector[i] AS DOUBLE)))"
query(
    "agg15_pairwise_cosine",
    f"""WITH g AS (SELECT CASE WHEN file_id = 1 THEN -1 ELSE file_id % 9 END AS g, file_id, vector FROM embs), p AS (SELECT a.g, avg({_DOT}) AS c FROM g a JOIN g b ON a.g = b.g AND a.file_id < b.file_id GROUP BY 1)
        SELECT g.g, count(*) AS n, round(coalesce(min(p.c), 0.0), 6) + 0.0 AS cohesion FROM g LEFT JOIN p ON p.g = g.g GROUP BY 1""",
    "embs",
)(
    lambda ix: cu.cohesion(ix.embs.select(F.when(F.col("file_id") == 1, F.lit(-1)).otherwise(F.col("file_id") % 9).cast("long").alias("g"), "vector"), "g").select("g", "n", (F.col("cohesion") + F.lit(0.0)).alias("cohesion"))
)
query("agg20_by_parent", "SELECT parent_album_id, count(*) AS children, string_agg(name, ',' ORDER BY name) AS names FROM albums GROUP BY 1", "albums")(
    lambda ix: al.by_parent(ix.albums).select("parent_album_id", "children", F.array_join("names", ",").alias("names"))
)
query("top03_page", "SELECT file_id FROM embs ORDER BY file_id LIMIT 20 OFFSET 40", "embs")(lambda ix: rd.page(ix.embs, "file_id", 20, 2).select("file_id"))
query(
    "top04_nearest_of_one",
    f"""SELECT row_number() OVER (ORDER BY score DESC, file_id) AS rank, file_id, score FROM (SELECT b.file_id, round({_DOT}, 6) AS score FROM embs a JOIN embs b ON a.file_id <> b.file_id WHERE a.file_id = 7) t ORDER BY score DESC, file_id LIMIT 5""",
    "embs",
)(lambda ix: se.nearest(ix.embs.where("file_id = 7").select(F.col("file_id").alias("query_id"), "vector"), ix.embs, 5).select(F.col("rank").cast("long").alias("rank"), "file_id", "score"))
query(
    "txt05_category_by_name",
    """WITH n AS (SELECT album_id, CASE album_id % 3 WHEN 0 THEN upper(name) WHEN 1 THEN lower(name) ELSE name END AS wanted FROM albums UNION ALL SELECT 1000 + p_partkey, upper(p_name) FROM part)
       SELECT album_id, wanted, c AS category FROM n LEFT JOIN (SELECT unnest(['Education', 'Career', 'Finance', 'Identity', 'Photos', 'Uncategorized']) AS c) k ON lower(k.c) = lower(n.wanted)""",
    "albums",
)(
    lambda ix: categories_of(
        ix.albums.select("album_id", F.when(F.col("album_id") % 3 == 0, F.upper("name")).when(F.col("album_id") % 3 == 1, F.lower("name")).otherwise(F.col("name")).alias("wanted")).unionByName(ix.part.select((F.col("p_partkey") + 1000).alias("album_id"), F.upper("p_name").alias("wanted"))),
        "wanted",
    )
)


query(
    "ker27_render_dpi",
    """WITH p AS (SELECT p_partkey, CAST(p_partkey * 37 % 3000 AS DOUBLE) AS w, p_size * 60.0e0 AS h FROM part)
       SELECT p_partkey, CASE WHEN w > 0 AND h > 0 THEN round(least(160.0, 72 * 2500 / greatest(w, h)), 6) END AS dpi FROM p""",
)(lambda ix: ix.part.select("p_partkey", F.round(ex.render_dpi((F.col("p_partkey") * 37 % 3000).cast("double"), F.col("p_size") * 60.0), 6).alias("dpi")))
query(
    "ker27_scanned_pages",
    """WITH p AS (SELECT doc_id, i, CASE WHEN i % 4 = 0 THEN chr(10) || ' ' ELSE 'page ' || i END AS t, CASE WHEN i % 5 <> 0 THEN (doc_id + i) % 10 / 1e1 END AS c FROM documents, range(0, 40) r(i) WHERE i < 2 + doc_id % 38)
       SELECT doc_id AS file_id, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (i % 4 <> 0), '') AS ocr_text, round(avg(c), 6) AS ocr_confidence, count(*) FILTER (i % 4 <> 0) AS recognized FROM p WHERE i < 30 GROUP BY 1""",
)(
    lambda ix: ex.page_text(
        ix.documents.select(F.col("doc_id").alias("file_id"), F.explode(F.sequence(F.lit(0), (1 + F.col("doc_id") % 38).cast("int"))).alias("page")).select(
            "file_id",
            "page",
            F.when(F.col("page") % 4 == 0, "\n ").otherwise(F.concat(F.lit("page "), "page")).alias("text"),
            F.when(F.col("page") % 5 != 0, (F.col("file_id") + F.col("page")) % 10 / 10.0).alias("confidence"),
        )
    ).select("file_id", "ocr_text", F.round("ocr_confidence", 6).alias("ocr_confidence"), "recognized")
)
query("ker28_text_layer", "SELECT file_id, CASE WHEN file_id % 6 <> 0 THEN length(extracted_text) END AS n FROM files", "files")(
    lambda ix: ex.text_layers(ix.files.select("file_id", F.when(F.col("file_id") % 5 != 1, F.col("file_id") % 6 == 0).otherwise(F.when(F.col("file_id") % 6 == 0, F.lit(True))).alias("encrypted"), F.col("extracted_text").alias("content"))).select("file_id", F.length("text_layer").cast("long").alias("n"))
)


def _length_model(texts):
    """A stand-in for the embedding model: the unit vector of (length, 1)."""
    return texts.map(lambda t: [len(t) / (len(t) ** 2 + 1) ** 0.5, 1 / (len(t) ** 2 + 1) ** 0.5])


query("vec11_embed", "SELECT file_id, round(length(extracted_text) / sqrt(length(extracted_text) * length(extracted_text) + 1.0), 5) AS first, true AS off FROM files", "files")(
    lambda ix: ex.embed(ex.embed(ix.files, "extracted_text", None).withColumn("off", F.col("vector").isNull()).drop("vector"), "extracted_text", _length_model).select("file_id", F.round(F.col("vector")[0].cast("double"), 5).alias("first"), "off")
)
query(
    "ker29_embed_and_store",
    """SELECT file_id, model_version, CASE WHEN file_id % 5 = 0 THEN 2 ELSE dim END AS dim FROM embs UNION ALL SELECT file_id, 'm1', 2 FROM files WHERE file_id % 5 = 0 AND file_id NOT IN (SELECT file_id FROM embs)""",
    "embs files",
)(lambda ix: ex.embed_and_store(ix.files.where("file_id % 5 = 0"), "extracted_text", ex.embed_and_store(ix.files, "extracted_text", ix.embs, None, "m1", NOW), _length_model, "m1", NOW).select("file_id", "model_version", "dim"))
