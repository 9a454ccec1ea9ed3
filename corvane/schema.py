"""Table schemas, value domains and tunables of the file index."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<float>": T.ArrayType(T.FloatType()), "array<string>": T.ArrayType(T.StringType())}


def _struct(spec: str) -> T.StructType:
    """Columns as "name type" pairs; needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (part.strip().split(" ") for part in spec.split(","))])


FILES = _struct(
    "file_id long, uri string, display_name string, mime_type string, size_bytes long, date_modified_source long, date_first_indexed long, sha256_hash string, perceptual_hash long, doc_type string, width_px int, height_px int, extracted_text string, ocr_applied boolean, ocr_confidence_avg double, processing_status string, processing_level int, primary_album_id long, classification_confidence double, is_deleted boolean, last_error string, tags_concat string"
)
ALBUMS = _struct("album_id long, name string, parent_album_id long, type string, confidence double, created_automatically boolean, centroid array<float>, icon string, created_at long")
FILE_ALBUM = _struct("file_id long, album_id long, confidence double, assigned_by string, assigned_at long")
TAGS = _struct("tag_id long, name string, category string")
FILE_TAG = _struct("file_id long, tag_id long, confidence double")
EMBEDDINGS = _struct("file_id long, model_version string, vector array<float>, dim int, generated_at long")
QUEUE = _struct("queue_id long, file_id long, target_level int, priority int, retry_count int, last_attempt_at long, next_eligible_at long, status string")
CORRECTIONS = _struct("correction_id long, file_id long, previous_album_id long, corrected_album_id long, correction_type string, timestamp long, not_duplicate_pair string")
DUPLICATE_GROUPS = _struct("group_id long, group_type string, representative_file_id long, status string, created_at long")
DUPLICATE_MEMBERS = _struct("group_id long, file_id long, similarity_score double")
FOLDERS = _struct("folder_uri string, granted_at long, last_validated_at long, permission_state string")
SUGGESTIONS = _struct("suggestion_id long, file_id long, source_album_id long, suggested_album_id long, confidence double, reasons array<string>, status string, created_at long")
DISMISSED = _struct("file_a long, file_b long")
DISCOVERED = _struct("uri string, display_name string, mime_type string, size_bytes long, date_modified_source long")

KEYS = {
    "files": ["file_id"], "albums": ["album_id"], "file_album": ["file_id", "album_id"], "tags": ["tag_id"], "file_tag": ["file_id", "tag_id"], "embeddings": ["file_id", "model_version"],
    "queue": ["queue_id"], "corrections": ["correction_id"], "duplicate_groups": ["group_id"], "duplicate_members": ["group_id", "file_id"], "folders": ["folder_uri"], "suggestions": ["suggestion_id"], "dismissed": ["file_a", "file_b"],
}

#: The domains of enumerated columns.
DOMAINS = {
    "processing_status": ["DISCOVERED", "METADATA_DONE", "CONTENT_DONE", "CLASSIFIED", "EMBEDDED", "INDEXED", "FAILED"],
    "doc_type": ["PDF", "IMAGE", "DOCX", "OTHER"],
    "album_type": ["PREDEFINED", "AUTO_CREATED", "USER_CREATED"],
    "assigned_by": ["AUTO", "USER", "SUGGESTED_ACCEPTED"],
    "queue_status": ["PENDING", "IN_PROGRESS", "FAILED", "DONE"],
    "correction_type": ["RECLASSIFY", "TAG_ADD", "TAG_REMOVE", "DUPLICATE_REJECTED", "ALBUM_MERGE"],
    "duplicate_group_type": ["EXACT", "PERCEPTUAL_NEAR", "SEMANTIC_VERSION"],
    "duplicate_group_status": ["PENDING_REVIEW", "RESOLVED", "DISMISSED"],
    "suggestion_status": ["PENDING", "ACCEPTED", "REJECTED"],
    "permission_state": ["ACTIVE", "NEEDS_REGRANT", "REVOKED"],
}


def in_domain(column: Column, domain: str) -> Column:
    """Whether a value belongs to its domain (null: unknown)."""
    return column.isin(DOMAINS[domain])


@dataclass(frozen=True)
class Settings:
    """Tunables; override(spark) takes values from ``corvane.<name>`` in the session."""

    auto_classify_threshold: float = 0.85
    suggest_threshold: float = 0.60
    new_album_min_cluster_size: int = 5
    new_album_cohesion_threshold: float = 0.78
    new_album_distinctiveness_threshold: float = 0.35
    vector_search_chunk_size: int = 2000
    duplicate_phash_hamming_near: int = 5
    duplicate_phash_hamming_similar: int = 10
    version_cosine_threshold: float = 0.92
    related_min_similarity: float = 0.55
    related_top_k: int = 8
    search_weight_semantic: float = 0.40
    search_weight_keyword: float = 0.30
    search_weight_filename: float = 0.20
    search_weight_metadata: float = 0.10
    correction_learning_rate: float = 0.05
    deep_batch_battery: int = 5
    deep_batch_charging: int = 20
    pdf_min_chars_per_page: int = 40
    ocr_max_pages_per_doc: int = 20
    embedding_dim: int = 384
    model_idle_unload_ms: int = 60000
    cloud_enabled: bool = False

    def override(self, spark: SparkSession) -> Settings:
        found = {}
        for f in fields(self):
            text = spark.conf.get(f"corvane.{f.name}", None)
            if text is not None:
                kind = type(getattr(self, f.name))
                found[f.name] = text.lower() == "true" if kind is bool else kind(text)
        return replace(self, **found)

    def store(self, spark: SparkSession) -> None:
        """Keep these values in the session."""
        for f in fields(self):
            spark.conf.set(f"corvane.{f.name}", str(getattr(self, f.name)).lower() if f.type == "bool" else str(getattr(self, f.name)))


def settings_rows(spark: SparkSession, settings: Settings | None = None):
    """(name, value) of all settings."""
    settings = settings or Settings().override(spark)
    return spark.createDataFrame([(f.name, str(getattr(settings, f.name))) for f in fields(settings)], "name string, value string")


def timestamp(column: Column) -> Column:
    """Epoch milliseconds as a timestamp."""
    return F.timestamp_millis(column)
