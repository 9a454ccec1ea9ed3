"""Content extraction: what is taken from text layers, recognised pages and images.

Recognition itself (OCR, labels, pixels) is a seam: its results come as columns or from a Pandas UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.vector import average_hash, luma
from corvane.operators.store import upsert

MIN_TEXT_LAYER = 100
MAX_OCR_PAGES = 30
OCR_DPI = 160
MAX_RENDER = 2500


def page_text(pages: DataFrame, most: int = MAX_OCR_PAGES) -> DataFrame:
    """(file_id, ocr_text, ocr_confidence, recognized): text of the first pages, blank ones left out, and the mean of the confidences there are.

    pages: (file_id, page, text, confidence), one row a page, numbered from 0.
    """
    shown = F.when(F.col("text").rlike(r"\S"), F.struct("page", "text"))
    lines = F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["text"])
    first = pages.where(F.col("page") < most).groupBy("file_id")
    return first.agg(F.array_join(lines, "\n").alias("ocr_text"), F.avg("confidence").alias("ocr_confidence"), F.count(shown).alias("recognized"))


def render_dpi(width_pt: Column, height_pt: Column) -> Column:
    """Resolution at which a page is rendered for recognition: OCR_DPI, less for one whose longer side would pass MAX_RENDER pixels; null for a page without a side."""
    scale = F.least(F.lit(OCR_DPI / 72), MAX_RENDER / F.greatest(width_pt, height_pt))
    return F.when((width_pt > 0) & (height_pt > 0), 72 * scale)


def text_layers(pdfs: DataFrame, extract=None) -> DataFrame:
    """(file_id, text_layer) of (file_id, encrypted, content): null where encrypted; extract: the seam content -> text, else content is the text."""
    text = F.col("content") if extract is None else F.pandas_udf(extract, "string")("content")
    return pdfs.select("file_id", F.when(~F.coalesce("encrypted", F.lit(False)), text).alias("text_layer"))


def dispatch(files: DataFrame) -> DataFrame:
    """(file_id, source, text, ocr_applied) from doc_type, text_layer and ocr_text; an encrypted file's layer is null."""
    layer = F.col("text_layer")
    good = (F.length(F.trim(layer)) > 0) & (F.length(layer) >= MIN_TEXT_LAYER)
    source = F.when((F.col("doc_type") == "PDF") & good, "TEXT_LAYER").when(F.col("doc_type").isin("PDF", "IMAGE"), "OCR").otherwise("NONE")
    told = files.withColumn("source", source)
    return told.select("file_id", "source", F.when(F.col("source") == "TEXT_LAYER", layer).when(F.col("source") == "OCR", F.col("ocr_text")).alias("text"), (F.col("source") == "OCR").alias("ocr_applied"))


def top_labels(labels: DataFrame, k: int = 5) -> DataFrame:
    """(file_id, labels): the k surest labels of (file_id, label, confidence)."""
    listed = labels.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "label"))).alias("l"))
    return listed.select("file_id", F.slice(F.transform("l", lambda x: x["label"]), 1, k).alias("labels"))


def image_hash(pixels: DataFrame) -> DataFrame:
    """(file_id, perceptual_hash) of 8 x 8 pixels (file_id, rgb array<struct<r,g,b>>)."""
    gray = F.transform("rgb", lambda p: luma(p["r"], p["g"], p["b"]))
    return pixels.select("file_id", average_hash(gray).alias("perceptual_hash"))


def embed(df: DataFrame, text: str, model) -> DataFrame:
    """df with a vector column from a model: an Arrow-batched function (texts) -> vectors, or None where the model is off."""
    if model is None:
        return df.withColumn("vector", F.lit(None).cast("array<float>"))
    return df.withColumn("vector", F.pandas_udf(model, "array<float>")(F.col(text)))


def embed_and_store(files: DataFrame, text: str, embeddings: DataFrame, model, model_version: str, now_ms: int) -> DataFrame:
    """Embeddings after those of files are made and kept, one a file and model version; unchanged where the model is off."""
    if model is None:
        return embeddings
    made = embed(files.select("file_id", text), text, model).where(F.col("vector").isNotNull())
    rows = made.select("file_id", F.lit(model_version).alias("model_version"), "vector", F.size("vector").alias("dim"), F.lit(now_ms).cast("long").alias("generated_at"))
    return upsert(embeddings, rows.select([c for c in rows.columns if c in embeddings.columns]), ["file_id", "model_version"])
