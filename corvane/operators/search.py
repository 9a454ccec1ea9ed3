"""Search: inverted index, match queries, nearest vectors, fusion and related files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.vector import clamp
from corvane.operators.products import top_products
from corvane.operators.reads import ascii_lower
from corvane.schema import Settings

FEW_TERMS = 1000
ROW_GROUP = 4 << 20
_WORD = "[^a-z0-9\\x80-\\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Words of a text, A-Z folded; characters beyond ASCII belong to words."""
    return F.filter(F.split(ascii_lower(text), _WORD), lambda w: w != "")


def inverted_index(files: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """(term, file_id, col, pos) of all words of the searchable columns; ASCII letters are folded."""
    columns = columns or {"name": "display_name", "text": "extracted_text"}
    parts = [files.select("file_id", F.lit(label).alias("col"), F.posexplode(words(F.col(c))).alias("pos", "term")) for label, c in columns.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("term", "file_id", "col", "pos")


def store_index(index: DataFrame, path: str) -> None:
    """Write an inverted index in order of its terms, so that a few terms are read from few row groups."""
    index.repartitionByRange("term", "file_id").sortWithinPartitions("term", "file_id").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)


def stored_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, file_id long, col string, pos int").parquet(path)


def stored_keyword_scores(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """keyword_scores from a stored index; up to FEW_TERMS words are looked up by a filter that reaches the files."""
    index = stored_index(spark, path)
    terms = queries.select(F.explode(words(F.col("query"))).alias("term")).distinct().limit(FEW_TERMS + 1).collect()
    if len(terms) <= FEW_TERMS:
        index = index.where(F.col("term").isin([r["term"] for r in terms]))
    return keyword_scores(index, queries)


def parse_match(query: str) -> list[list[tuple[str | None, list[str], bool]]]:
    """A match query as alternatives of conditions (column, words, whether the last word is a prefix).

    Words together must all be there; OR parts alternatives; quotes hold phrases; word* is a prefix;
    column:word looks in one column.
    """
    out: list[list[tuple[str | None, list[str], bool]]] = [[]]
    for column, phrase, word in re.findall(r'(?:(\w+):)?(?:"([^"]*)"|(\S+))', query):
        if word == "OR" and not column:
            out.append([])
            continue
        prefix = (word or phrase).endswith("*")
        terms = [t for t in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (phrase or word).lower()) if t]
        if terms:
            out[-1].append((column or None, terms, prefix))
    return [a for a in out if a]


def match(index: DataFrame, query: str) -> DataFrame:
    """(file_id) of the files that fit a match query: each condition is one filter of the index, phrases join positions."""
    found = None
    for conditions in parse_match(query):
        part = None
        for column, terms, prefix in conditions:
            side = index if column is None else index.where(F.col("col") == column)
            hits = None
            for i, term in enumerate(terms):
                last = prefix and i == len(terms) - 1
                own = side.where(F.startswith("term", F.lit(term)) if last else F.col("term") == term).select("file_id", "col", (F.col("pos") - i).alias("at"))
                hits = own if hits is None else hits.join(own, ["file_id", "col", "at"], "left_semi")
            ids = hits.select("file_id").distinct()
            part = ids if part is None else part.join(ids, "file_id", "left_semi")
        found = part if found is None else found.unionByName(part)
    return found.distinct() if found is not None else index.select("file_id").limit(0)


def matching_files(index: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """The live files that fit a match query, by their id."""
    return files.where(~F.col("is_deleted")).join(match(index, query), "file_id", "left_semi").orderBy("file_id")


def keyword_scores(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, file_id, keyword): share of a query's distinct words that a file holds.

    queries: (query_id, query). An equi-join on words with those of the queries.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))
    size = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    some = index.select("term", "file_id").join(wanted.select("term").distinct(), "term", "left_semi")
    hits = some.distinct().join(wanted, "term").groupBy("query_id", "file_id").agg(F.count(F.lit(1)).alias("k"))
    return hits.join(size, "query_id").select("query_id", "file_id", F.round(F.col("k") / F.col("n"), 6).alias("keyword"))


def nearest(queries: DataFrame, embeddings: DataFrame, k: int, exclude_self: bool = True, floor: float | None = None) -> DataFrame:
    """(query_id, rank, file_id, score): the k most similar vectors of each query (query_id, vector).

    A stated query set against all rows, in blocks; every batch keeps about k rows a query before they meet.
    """
    found = top_products(embeddings, "file_id", "vector", queries, "query_id", "vector", k, exclude_self)
    scored = found.withColumn("score", F.round("score", 6))
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "file_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "file_id", "score")


def fuse(keyword, semantic, filename, metadata, settings: Settings = Settings()):
    """Weighted sum of four scores, each in 0..1."""
    zero = lambda c: clamp(F.coalesce(c, F.lit(0.0)))
    return F.round(settings.search_weight_keyword * zero(keyword) + settings.search_weight_semantic * zero(semantic) + settings.search_weight_filename * zero(filename) + settings.search_weight_metadata * zero(metadata), 9)


def hybrid(keyword: DataFrame, semantic: DataFrame, filename: DataFrame, metadata: DataFrame, k: int = 30, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, file_id, score): the k best by words and all by vector, with all four scores for each.

    Each input is (query_id, file_id, its score under its name), a file once a query. They meet in one sum
    by query and file; the candidates and their ranks are windows of a query.
    """
    sides = {"keyword": keyword, "semantic": semantic, "filename": filename, "metadata": metadata}
    rows = None
    for name, side in sides.items():
        own = side.select("query_id", "file_id", *[(F.col(c) if c == name else F.lit(None)).cast("double").alias(c) for c in sides])
        rows = own if rows is None else rows.unionByName(own)
    met = rows.groupBy("query_id", "file_id").agg(*[F.max(c).alias(c) for c in sides])
    by_words = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("keyword"), "file_id")
    candidates = met.withColumn("r", F.row_number().over(by_words)).where((F.col("keyword").isNotNull() & (F.col("r") <= k)) | F.col("semantic").isNotNull())
    scored = candidates.withColumn("score", fuse(F.col("keyword"), F.col("semantic"), F.col("filename"), F.col("metadata"), settings))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "file_id")
    return scored.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "file_id", "score")


def related(near: DataFrame, file_album: DataFrame, file_tag: DataFrame, files: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, file_id, score) of nearest files with boosts for a shared album, tag and folder, above the floor.

    near: (query_id, file_id, score), a few rows a query.
    """
    albums = near.join(file_album.select(F.col("file_id").alias("query_id"), "album_id"), "query_id").join(file_album.select("file_id", "album_id"), ["file_id", "album_id"], "left_semi").select("query_id", "file_id").distinct().withColumn("album", F.lit(True))
    tags = near.join(file_tag.select(F.col("file_id").alias("query_id"), "tag_id"), "query_id").join(file_tag.select("file_id", "tag_id"), ["file_id", "tag_id"], "left_semi").select("query_id", "file_id").distinct().withColumn("tag", F.lit(True))
    folder = F.regexp_replace("uri", "/[^/]*$", "")
    homes = files.select("file_id", folder.alias("home"))
    keys = ["query_id", "file_id"]
    told = near.join(albums, keys, "left").join(tags, keys, "left").join(homes, "file_id", "left").join(homes.select(F.col("file_id").alias("query_id"), F.col("home").alias("own")), "query_id", "left")
    boost = F.when(F.col("album"), 0.05).otherwise(0.0) + F.when(F.col("tag"), 0.02).otherwise(0.0) + F.when(F.col("home") == F.col("own"), 0.03).otherwise(0.0)
    return told.select("query_id", "file_id", F.round(F.col("score") + boost, 6).alias("score")).where(F.col("score") >= settings.related_min_similarity)


#: Phrases that say nothing about what is looked for, the longest first.
STOCK_PHRASES = ("documents related to", "find my", "show me", "search for", "show", "find")


#: Fixed value: a year, or a date that begins with one.
DATE = r"\b((?:19|20)\d{2}(?:-\d{1,2}-\d{1,2})?)\b"


def parse_intent(query: str, albums: list[str], most_edits: int = 2) -> dict:
    """Dates, album and free text of a query in words; an album is a word within two edits of its name."""
    rest = query.lower()
    for phrase in STOCK_PHRASES:
        rest = re.sub(rf"\b{phrase}\b", " ", rest)
    dates = re.findall(DATE, rest)
    rest = re.sub(DATE, " ", rest)
    album, left = None, []
    for word in rest.split():
        close = [a for a in albums if abs(len(a) - len(word)) <= most_edits and _edits(a.lower(), word) <= min(most_edits, max(0, len(a) // 4))]
        if close and album is None:
            album = min(close, key=lambda a: (_edits(a.lower(), word), a))
        else:
            left.append(word)
    return {"album": album, "dates": dates, "text": " ".join(left)}


def _deletions(word: Column, most: Column) -> Column:
    """A word and all that is left of it when up to ``most`` (0 to 2) of its characters are deleted, each once."""
    less = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    one = F.array_distinct(less(word))
    two = F.flatten(F.transform(one, less))
    return F.array_distinct(F.concat(F.array(word), F.when(most >= 1, one).otherwise(F.array().cast("array<string>")), F.when(most >= 2, two).otherwise(F.array().cast("array<string>"))))


def parse_intents(queries: DataFrame, albums: DataFrame, most_edits: int = 2) -> DataFrame:
    """(query_id, album, dates, text) of queries in words (query_id, query), by the rules of parse_intent, for any number of albums (name).

    Two words within two edits share what is left of them after up to two deletions: an equi-join on those
    finds candidates, whose distance is then computed. Each distinct word is looked up once.
    """
    rest = F.lower("query")
    for phrase in STOCK_PHRASES:
        rest = F.regexp_replace(rest, rf"\b{phrase}\b", " ")
    told = queries.select("query_id", rest.alias("rest")).select("query_id", F.regexp_extract_all("rest", F.lit(DATE), F.lit(1)).alias("dates"), F.filter(F.split(F.regexp_replace("rest", DATE, " "), r"\s+"), lambda w: w != "").alias("words"))
    each = told.select("query_id", F.posexplode("words").alias("pos", "word"))
    few = F.least(F.lit(most_edits), F.floor(F.length("name") / 4)).cast("int")
    named = albums.select("name").where(F.col("name").isNotNull()).distinct().select("name", F.lower("name").alias("low"), few.alias("few"))
    longest = named.agg(F.max(F.length("low")).alias("longest"))
    asked = each.select("word").distinct().join(F.broadcast(longest), F.length("word") <= F.col("longest") + most_edits).select("word", F.explode(_deletions(F.col("word"), F.lit(most_edits))).alias("left"))
    close = asked.join(named.select("name", "low", "few", F.explode(_deletions(F.col("low"), F.col("few"))).alias("left")), "left").select("word", "name", "low", "few").distinct()
    best = close.withColumn("edits", F.levenshtein("word", "low")).where(F.col("edits") <= F.col("few")).groupBy("word").agg(F.min(F.struct("edits", "name"))["name"].alias("album"))
    first = each.join(best, "word").groupBy("query_id").agg(F.min(F.struct("pos", "album")).alias("f"))
    text = F.array_join(F.filter(F.transform("words", lambda w, i: F.when(F.coalesce(F.col("f.pos"), F.lit(-1)) != i, w)), lambda w: w.isNotNull()), " ")
    return told.join(first, "query_id", "left").select("query_id", F.col("f.album").alias("album"), "dates", text.alias("text"))


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
