"""Registered queries over stored indexes: each writes its index into the shared folder and answers from its files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.fixtures import Index
from corvane.operators import reads as rd
from corvane.operators import search as se
from corvane.operators.postings import NameIndex, TextIndex
from corvane.operators.vectorindex import VectorIndex
from corvane.plans.catalog import _BQ, _DOT, _KNN, _KW, _benchmark_queries
from corvane.plans.evidence import _BOOSTS
from corvane.plans.registry import query
from corvane.runtime import Workspace


def _texts(ix: Index) -> TextIndex:
    return TextIndex(ix.spark, Workspace(ix.spark, "words").path("index")).write(ix.files)


def _names(ix: Index, rows: DataFrame, name: str) -> NameIndex:
    return NameIndex(ix.spark, Workspace(ix.spark, "names").path("index")).write(rows, name)


def _vectors(ix: Index) -> VectorIndex:
    return VectorIndex(ix.spark, Workspace(ix.spark, "vectors").path("index")).write(ix.embs)


def _asked(ix: Index) -> list[tuple[int, list[float]]]:
    """The stated query set of the vector searches: ids divisible by 100."""
    return [(r["file_id"], r["vector"]) for r in ix.embs.where("file_id % 100 = 0").collect()]


# --- substrings of names -------------------------------------------------------------------------

query(
    "flt21_stored_wildcards",
    "SELECT file_id, display_name AS name FROM files WHERE NOT is_deleted AND lower(display_name) LIKE '%c1_e_%1%'",
    "files",
)(lambda ix: _names(ix, rd.live(ix.files), "display_name").search("C1_E_%1"))
query(
    "flt21_stored_names",
    """WITH t AS (SELECT row_number() OVER (ORDER BY term) AS term_id, term FROM (SELECT DISTINCT substr(p_name, 3, 4) AS term FROM part UNION SELECT DISTINCT p_type FROM part UNION SELECT DISTINCT p_name FROM part) s WHERE length(term) >= 3)
       SELECT term, p_partkey FROM t JOIN part ON contains(lower(p_name), lower(term))""",
)(lambda ix: _names_of_parts(ix))
query(
    "flt21_stored_short",
    "SELECT file_id, display_name AS name FROM files WHERE lower(display_name) LIKE '%9.%'",
    "files",
)(lambda ix: _names(ix, ix.files, "display_name").search("9."))


def _names_of_parts(ix: Index) -> DataFrame:
    terms = ix.part.select(F.substring("p_name", 3, 4).alias("term")).union(ix.part.select("p_type")).union(ix.part.select("p_name")).distinct().where(F.length("term") >= 3)
    asked = terms.withColumn("term_id", F.xxhash64("term"))
    found = _names(ix, ix.part.withColumnRenamed("p_partkey", "file_id"), "p_name").search_all(asked)
    return found.join(asked, "term_id").select("term", F.col("file_id").alias("p_partkey"))


# --- words of names and texts --------------------------------------------------------------------

_WORDS = "SELECT *, string_split_regex(lower(display_name), '[^a-z0-9]+') AS n, list_filter(string_split_regex(lower(extracted_text), '[^a-z0-9\u0080-\U0010ffff]+'), lambda w: w <> '') AS t FROM files"
_HAS = "(list_contains(n, '{0}') OR list_contains(t, '{0}'))"
query("txt18_stored_and", f"SELECT file_id FROM ({_WORDS}) x WHERE {_HAS.format('the')} AND {_HAS.format('of')} OR {_HAS.format('src2')} AND {_HAS.format('le')}", "files")(lambda ix: _texts(ix).match("the of OR src2 le"))
query("txt18_stored_phrase", f"SELECT file_id FROM ({_WORDS}) x WHERE position(' of the ' IN ' ' || array_to_string(t, ' ') || ' ') > 0", "files")(lambda ix: _texts(ix).match('text:"of the"'))
query(
    "txt18_stored_prefix",
    f"SELECT file_id FROM ({_WORDS}) x WHERE len(list_filter(n, lambda w: starts_with(w, 'src1'))) > 0 AND len(list_filter(list_concat(n, t), lambda w: starts_with(w, 'th'))) > 0 OR regexp_matches(' ' || array_to_string(t, ' '), ' of th')",
    "files",
)(lambda ix: _texts(ix).match('name:src1* th* OR text:"of th*"'))
query("join07_stored_match", f"SELECT file_id, display_name FROM ({_WORDS}) x WHERE NOT is_deleted AND list_contains(t, 'that')", "files")(
    lambda ix: rd.live(ix.files).join(_texts(ix).match("text:that"), "file_id", "left_semi").select("file_id", "display_name")
)
query("ker32_stored_keyword", f"WITH {_BQ}, {_KW} SELECT query_id, file_id, keyword FROM ks", "files")(lambda ix: _texts(ix).keyword_scores(_benchmark_queries(ix)))

# --- vectors -------------------------------------------------------------------------------------

query("join12_stored_knn", f"WITH {_KNN} SELECT query_id, rank, file_id, score FROM rk WHERE rank <= 10", "embs")(lambda ix: _vectors(ix).search(_asked(ix), 10))
query(
    "top04_stored_nearest",
    f"SELECT row_number() OVER (ORDER BY score DESC, file_id) AS rank, file_id, score FROM (SELECT b.file_id, round({_DOT.format(a='a.vector', b='b.vector')}, 6) AS score FROM embs a JOIN embs b ON a.file_id <> b.file_id WHERE a.file_id = 7) t WHERE score >= 0.05 ORDER BY score DESC, file_id LIMIT 5",
    "embs",
)(lambda ix: _vectors(ix).search([(7, ix.embs.where("file_id = 7").first()["vector"])], 5, floor=0.05).select("rank", "file_id", "score"))
query(
    "ker33_stored_related",
    f"""WITH {_KNN}, nr AS (SELECT query_id, file_id, score + 0.3 AS score FROM rk WHERE rank <= 8),
          bo AS (SELECT n.*, EXISTS (SELECT 1 FROM file_album a JOIN file_album b ON a.album_id = b.album_id WHERE a.file_id = n.query_id AND b.file_id = n.file_id) AS al,
            EXISTS (SELECT 1 FROM file_tag a JOIN file_tag b ON a.tag_id = b.tag_id WHERE a.file_id = n.query_id AND b.file_id = n.file_id) AS tg,
            (SELECT regexp_replace(uri, '/[^/]*$', '') FROM files WHERE file_id = n.query_id) = (SELECT regexp_replace(uri, '/[^/]*$', '') FROM files WHERE file_id = n.file_id) AS fo FROM nr n)
        SELECT query_id, file_id, round(score + {_BOOSTS}, 6) AS score FROM bo WHERE round(score + {_BOOSTS}, 6) >= 0.55""",
    "embs file_album file_tag files",
)(lambda ix: se.related(_vectors(ix).search(_asked(ix), 8).withColumn("score", F.col("score") + 0.3), ix.file_album, ix.file_tag, ix.files))
