"""Stand-in index tables made from the test tables; every text is SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.runtime import ship_package, table

_STATUS = "CASE doc_id % 7 WHEN 0 THEN 'DISCOVERED' WHEN 1 THEN 'METADATA_DONE' WHEN 2 THEN 'CONTENT_DONE' WHEN 3 THEN 'CLASSIFIED' WHEN 4 THEN 'EMBEDDED' WHEN 5 THEN 'INDEXED' ELSE 'FAILED' END"

#: name -> SQL over test tables and earlier entries, in {braces}.
VIEWS = {
    "files": f"""
        SELECT doc_id AS file_id, 'content://' || source || '/' || doc_id AS uri,
          source || '_' || lang || '_' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.png' WHEN 2 THEN '.docx' ELSE '.txt' END AS display_name,
          CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'text/plain' END AS mime_type,
          n_chars AS size_bytes, 1700000000000 + doc_id * 1000 AS date_modified_source,
          1700000000000 + ((doc_id * 7919) % 1000003) * 1000 AS date_first_indexed, {{sha}}(text{{sha_bits}}) AS sha256_hash,
          CASE doc_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'IMAGE' WHEN 2 THEN 'DOCX' ELSE 'OTHER' END AS doc_type,
          text AS extracted_text, doc_id % 4 = 1 AS ocr_applied, {_STATUS} AS processing_status, CAST(doc_id % 5 AS INT) AS processing_level,
          CASE WHEN doc_id % 3 = 0 THEN 100 + doc_id % 25 END AS primary_album_id,
          CASE WHEN doc_id % 3 = 0 THEN (doc_id % 100) / 1e2 END AS classification_confidence,
          doc_id % 29 = 0 AS is_deleted, CASE WHEN doc_id % 7 = 6 THEN 'failed' END AS last_error
        FROM {{documents}}""",
    "albums": """
        SELECT CAST(r_regionkey AS BIGINT) + 1 AS album_id, r_name AS name, CAST(NULL AS BIGINT) AS parent_album_id, 'PREDEFINED' AS type, CAST(NULL AS DOUBLE) AS confidence, false AS created_automatically FROM {region}
        UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 100, n_name, CAST(n_regionkey AS BIGINT) + 1, 'AUTO_CREATED', n_nationkey / 1e2, true FROM {nation}
        UNION ALL SELECT CAST(201 AS BIGINT), 'Education', NULL, 'PREDEFINED', NULL, false UNION ALL SELECT CAST(202 AS BIGINT), 'Career', NULL, 'PREDEFINED', NULL, false
        UNION ALL SELECT CAST(203 AS BIGINT), 'Finance', NULL, 'PREDEFINED', NULL, false UNION ALL SELECT CAST(204 AS BIGINT), 'Identity', NULL, 'PREDEFINED', NULL, false
        UNION ALL SELECT CAST(205 AS BIGINT), 'Photos', NULL, 'PREDEFINED', NULL, false UNION ALL SELECT CAST(206 AS BIGINT), 'Uncategorized', NULL, 'PREDEFINED', NULL, false""",
    "embs": """SELECT e.vec_id AS file_id, 'm1' AS model_version, e.embedding AS vector, 64 AS dim FROM {embeddings} e JOIN {documents} d ON d.doc_id = e.vec_id""",
    "file_album": """
        SELECT e.vec_id AS file_id, CAST(100 + e.label AS BIGINT) AS album_id, (e.vec_id % 100) / 1e2 AS confidence,
          CASE e.vec_id % 3 WHEN 0 THEN 'AUTO' WHEN 1 THEN 'USER' ELSE 'SUGGESTED_ACCEPTED' END AS assigned_by, 1700000000000 + e.vec_id AS assigned_at
        FROM {embeddings} e JOIN {documents} d ON d.doc_id = e.vec_id""",
    "tags": """
        SELECT row_number() OVER (ORDER BY name) AS tag_id, name, category FROM (
          SELECT DISTINCT lang AS name, 'lang' AS category FROM {documents} UNION SELECT DISTINCT source AS name, 'source' AS category FROM {documents}) t""",
    "file_tag": """SELECT d.doc_id AS file_id, CAST(t.tag_id AS BIGINT) AS tag_id, CASE t.category WHEN 'lang' THEN 0.5e0 ELSE 0.9e0 END AS confidence FROM {documents} d JOIN {tags} t ON t.name IN (d.lang, d.source)""",
    "queue": """
        SELECT event_id AS queue_id, event_id % (SELECT count(*) FROM {documents}) AS file_id, CAST(2 + event_id % 3 AS INT) AS target_level, CAST(user_id % 3 AS INT) AS priority,
          CAST(event_id % 6 AS INT) AS retry_count, 1704067200000 + (event_id * 104729) % 2592000000 AS next_eligible_at,
          CASE event_id % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_PROGRESS' WHEN 2 THEN 'FAILED' ELSE 'DONE' END AS status
        FROM {events}""",
    "suggestions": """
        SELECT doc_id AS suggestion_id, doc_id AS file_id, CAST(NULL AS BIGINT) AS source_album_id, 100 + doc_id % 25 AS suggested_album_id, 0.6e0 + (doc_id % 25) / 1e2 AS confidence,
          CASE WHEN toxic = 1 THEN 'REJECTED' WHEN quality = 1 THEN 'PENDING' ELSE 'ACCEPTED' END AS status, 1700000000000 + doc_id * 31 AS created_at
        FROM {labels}""",
    "folders": """
        SELECT 'content://tree/' || r_name AS folder_uri, 1700000000000 + CAST(r_regionkey AS BIGINT) AS granted_at, 1700000000000 + CAST(r_regionkey AS BIGINT) AS last_validated_at,
          CASE r_regionkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'NEEDS_REGRANT' ELSE 'REVOKED' END AS permission_state
        FROM {region}""",
    "discovered": """
        SELECT uri, display_name, mime_type, CASE WHEN file_id % 10 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, date_modified_source FROM {files} WHERE file_id % 11 <> 0
        UNION ALL SELECT uri || '/new', 'new_' || display_name, mime_type, size_bytes, date_modified_source FROM {files} WHERE file_id % 13 = 0""",
    "media": """
        SELECT page_id AS media_id, 0 AS source_ord, url AS uri, CAST(NULL AS STRING) AS display_name, CAST(NULL AS STRING) AS mime_type, length(html) AS size_bytes, 1700000000 + page_id AS date_modified_s FROM {pages}
        UNION ALL SELECT page_id + 1000000, 1, url, 'copy', 'text/html', 0, 1600000000 + page_id FROM {pages}""",
    "dated": """SELECT o_orderkey AS file_id, 'invoice ' || {iso} || ' due ' || {us} || ' in ' || {year} || '.' AS text FROM {orders}""",
    "hashes": """SELECT file_id, {sign_bits} AS phash FROM {embs}""",
}
TABLES = ["documents", "region", "nation", "embeddings", "events", "labels", "pages", "orders", "benchmark", "part"]
_SPARK = {
    "sha": "sha2", "sha_bits": ", 256", "iso": "date_format(o_orderdate, 'yyyy-MM-dd')", "us": "date_format(o_orderdate, 'MM/dd/yyyy')", "year": "date_format(o_orderdate, 'yyyy')",
    "sign_bits": "aggregate(transform(sequence(0, 63), i -> CASE WHEN vector[i] > 0 THEN shiftleft(1L, i) ELSE 0L END), 0L, (a, x) -> a | x)",
}
_DUCK = {
    "sha": "sha256", "sha_bits": "", "iso": "strftime(o_orderdate, '%Y-%m-%d')", "us": "strftime(o_orderdate, '%m/%d/%Y')", "year": "strftime(o_orderdate, '%Y')",
    "sign_bits": "CAST(list_sum(list_transform(range(0, 64), lambda i: CASE WHEN vector[i + 1] > 0 THEN CAST(pow(2, i) AS HUGEINT) ELSE CAST(0 AS HUGEINT) END)) AS UBIGINT)",
}


class Index:
    """The index tables of a folder, each made on first use: ``ix.files``, ``ix.albums`` ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        ship_package(spark)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            found = table(self.spark, self.sf_dir, name)
        elif name in VIEWS:
            needs = {n: getattr(self, n) for n in [*TABLES, *VIEWS] if "{" + n + "}" in VIEWS[name]}
            text = VIEWS[name]
            for key, value in _SPARK.items():
                text = text.replace("{" + key + "}", value)
            found = self.spark.sql(text, **needs)
        else:
            raise AttributeError(name)
        setattr(self, name, found)
        return found


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views (and those below them) as common table expressions."""
    listed: list[str] = []

    def add(name: str) -> None:
        if name in listed:
            return
        for other in VIEWS:
            if "{" + other + "}" in VIEWS[name]:
                add(other)
        listed.append(name)

    for name in names:
        add(name)
    parts = []
    for name in listed:
        text = VIEWS[name]
        for key, value in _DUCK.items():
            text = text.replace("{" + key + "}", value)
        for other in [*TABLES, *VIEWS]:
            text = text.replace("{" + other + "}", other)
        parts.append(f"{name} AS ({text})")
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(parts)}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"
