"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.lexicon import STOP_WORDS

# What parts tokens, and the patterns of dates and years.
TOKEN_SPLIT = "[^a-z0-9+.#-]"
ISO_DATE = r"\b((?:19|20)\d{2}[-/.]\d{1,2}[-/.]\d{1,2})\b"
US_DATE = r"\b(\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)\d{2})\b"
YEAR = r"\b((?:19|20)\d{2})\b"


def tokens(text: Column) -> Column:
    """Lower-case tokens of two characters and more that are no stop words; null for null."""
    return F.filter(F.split(F.lower(text), TOKEN_SPLIT), lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))


def bigrams(toks: Column) -> Column:
    """Neighbours of an array of tokens, joined by a space."""
    return F.when(F.size(toks) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(toks, F.lit(1), F.size(toks) - 1), F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def iso_date_tags(text: Column) -> Column:
    """date:yyyy-m-d for every span of the kind yyyy-m-d, yyyy/m/d or yyyy.m.d of the years 19xx and 20xx."""
    spans = F.regexp_extract_all(text, F.lit(ISO_DATE), F.lit(1))
    return F.transform(spans, lambda s: F.concat(F.lit("date:"), F.translate(s, "/.", "--")))


def us_date_tags(text: Column) -> Column:
    """date:yyyy-mm-dd for every span month, day, year; no check of ranges."""
    spans = F.regexp_extract_all(text, F.lit(US_DATE), F.lit(1))

    def tag(span: Column) -> Column:
        part = F.split(span, "[-/.]")
        return F.concat(F.lit("date:"), part[2], F.lit("-"), F.lpad(part[0], 2, "0"), F.lit("-"), F.lpad(part[1], 2, "0"))

    return F.transform(spans, tag)


def year_tags(text: Column) -> Column:
    """year:yyyy for every year 19xx or 20xx, those within dates too."""
    return F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: F.concat(F.lit("year:"), y))


def date_tags(text: Column) -> Column:
    """All structured tags of a text, in the order ISO dates, other dates, years."""
    return F.concat(iso_date_tags(text), us_date_tags(text), year_tags(text))


def title_case(term: Column) -> Column:
    """First letters of words upper-cased."""
    return F.initcap(term)


def doc_type(mime: Column) -> Column:
    """Document type of a MIME type."""
    return F.when(mime == "application/pdf", "PDF").when(F.startswith(mime, F.lit("image/")), "IMAGE").when(mime == "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "DOCX").otherwise("OTHER")


def classification_text(name: Column, text: Column, most: int = 6000) -> Column:
    """The name, and on a new line the first characters of the text, if there is one (empty counts, null doesn't)."""
    return F.when(text.isNull(), name).otherwise(F.concat(name, F.lit("\n"), F.substring(text, 1, most)))


def embedding_text(name: Column, text: Column, tags: Column, most: int = 8000, most_tags: int = 10) -> Column:
    """Name, then the text unless blank, then up to ten tags, each with a space after it."""
    body = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 0, F.concat(F.lit("\n"), F.substring(text, 1, most))).otherwise("")
    few = F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, most_tags)
    tail = F.when(F.size(few) > 0, F.concat(F.lit("\n"), F.array_join(F.transform(few, lambda t: F.concat(t, F.lit(" "))), ""))).otherwise("")
    return F.concat(name, body, tail)


def preview(text: Column, most: int = 512) -> Column:
    return F.substring(text, 1, most)


def percent(x: Column) -> Column:
    """Rounded half up, with a percent sign."""
    return F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))


def first_reasons(said: Column, most: int = 3) -> Column:
    """The reasons that are shown."""
    return F.slice(said, 1, most)


def reasons(category: Column, terms: Column, evidence: Column, coverage: Column) -> Column:
    """Reason strings: category, up to five matched terms, evidence, and its coverage where it isn't whole."""
    head = F.when(category.isNotNull(), F.array(F.concat(F.lit("Category: "), category))).otherwise(F.array().cast("array<string>"))
    matched = F.transform(F.slice(F.coalesce(terms, F.array().cast("array<string>")), 1, 5), lambda t: F.concat(F.lit("Matched term: "), t))
    partial = F.when(coverage < 1 - 1e-6, F.array(F.concat(F.lit("Evidence coverage: "), percent(coverage)))).otherwise(F.array().cast("array<string>"))
    return F.concat(head, matched, evidence, partial)
