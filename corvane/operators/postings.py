"""Stored postings in blocks of files: words with their places for match queries and keyword scores, grams of names for substrings.

A block is the ``BLOCK`` files whose ids share all bits but the last twelve. A row of the table holds one
term in one block: the files in it (``ids``, the last bits, ascending), how often each has the term
(``counts``), and all its places there (``places``: the column in the upper bits, the position below). The
table is sorted by term, in small row groups, and written in Parquet's second format, which keeps ascending
integers and sorted strings as differences; so a few terms, or all that begin with a prefix, are read from a
few row groups, and a term that most files have is as many rows as there are blocks.

Everything after the read is a set operation on arrays within a block: conditions of a match query meet by
block, so no group is larger than a block has places, whatever the number of files. What a query has no
need for (places, for words alone) isn't read.

Substrings: every position of a name starts a gram of three characters, A-Z folded; the end is filled up
with marks. A substring of three or more characters is the grams at every third of its places, at fixed
distances; a shorter one is all grams that begin with it. Terms with wildcards are looked up by their
literal parts and then compared with the names, which are kept beside the postings by block.

Cases: files without an id aren't in an index; null texts have no words; negative ids have blocks of their
own; an empty query, or one without words, finds nothing; the substring '' (or wildcards alone) fits every
name it fits, from the names alone. Rows that repeat an id count once a file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.reads import ascii_lower
from corvane.operators.search import parse_match, words
from corvane.runtime import Workspace

BITS = 12
BLOCK = 1 << BITS
COLUMN_BITS = 27  # positions of a term within a text, below
ROW_GROUP = 2 << 20
FEW = 1000  # terms, or blocks, that a filter names
GRAM = 3
END = "\x00"
SCHEMA = "term string, block long, ids array<int>, counts array<int>, places array<int>"
NAMES = "block long, file_id long, name string"


def store(rows: DataFrame, path: str) -> None:
    """Write postings of (term, file_id, col, pos); col is a small number, pos a position in its text.

    One shuffle deals the rows by term and block; files and then blocks are formed within it.
    """
    spread = rows.where(F.col("file_id").isNotNull()).select(
        "term",
        F.shiftright("file_id", BITS).alias("block"),
        F.col("file_id").bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("id"),
        F.shiftleft(F.col("col"), COLUMN_BITS).bitwiseOR(F.col("pos")).alias("place"),
    )
    files = spread.repartition("term", "block").groupBy("term", "block", "id").agg(F.sort_array(F.collect_set("place")).alias("places"))
    blocks = files.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("id", "places"))).alias("f"))
    shaped = blocks.select("term", "block", F.col("f.id").alias("ids"), F.transform("f.places", lambda p: F.size(p)).alias("counts"), F.flatten("f.places").alias("places"))
    work = Workspace(rows.sparkSession, "postings")
    formed = work.write(shaped, "formed")  # sorting by range reads its input twice
    options = {"parquet.block.size": ROW_GROUP, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "compression": "zstd"}
    formed.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").options(**options).parquet(path)
    work.drop("formed")


def word_rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """(term, file_id, col, pos) of all words of these columns, numbered as listed."""
    parts = [files.select("file_id", F.lit(i).alias("col"), F.posexplode(words(F.col(c))).alias("pos", "term")) for i, c in enumerate(columns)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("term", "file_id", "col", "pos")


def gram_rows(files: DataFrame, name: str = "display_name") -> DataFrame:
    """(term, file_id, col, pos) of the grams of a column."""
    told = F.concat(ascii_lower(F.col(name)), F.lit(END * (GRAM - 1)))
    starts = F.when(F.length(name) > 0, F.sequence(F.lit(1), F.length(name)))
    grams = F.transform(starts, lambda i: F.substring(told, i, F.lit(GRAM)))
    return files.select("file_id", F.lit(0).alias("col"), F.posexplode(grams).alias("pos", "term")).select("term", "file_id", "col", "pos")


class TextIndex:
    """Words of some columns of files, stored in a folder."""

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, str] | None = None):
        """columns: the name of each in queries, and the column of files; their order is part of the index."""
        self.spark, self.path = spark, path
        self.columns = columns or {"name": "display_name", "text": "extracted_text"}

    def write(self, files: DataFrame) -> TextIndex:
        store(word_rows(files, list(self.columns.values())), self.path)
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def match(self, query: str) -> DataFrame:
        """(file_id) of the files that fit a match query (see parse_match)."""
        found = None
        for conditions in parse_match(query):
            part = None
            for column, terms, prefix in conditions:
                hits = self._condition(column, terms, prefix)
                part = hits if part is None else _both(part, hits)
            found = part if found is None else found.unionByName(part)
        if found is None:
            return self.rows().select(F.lit(0).cast("long").alias("file_id")).limit(0)
        return _files(found, "ids").distinct()

    def _condition(self, column: str | None, terms: list[str], prefix: bool) -> DataFrame:
        """(block, ids) of the files with these words one after the other."""
        rows, hits = self.rows(), None
        for i, term in enumerate(terms):
            last = prefix and i == len(terms) - 1
            own = rows.where(F.startswith("term", F.lit(term)) if last else F.col("term") == term)
            if column is None and len(terms) == 1:
                own = own.select("block", F.col("ids").alias("codes"))  # places aren't read
            else:
                codes = _codes(i)
                if column is not None:
                    number = list(self.columns).index(column) if column in self.columns else -1
                    codes = F.filter(codes, lambda c: F.shiftright(c.bitwiseAND(F.lit((1 << 32) - 1)), COLUMN_BITS) == number)
                own = own.select("block", codes.alias("codes"))
            if last:
                own = own.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("codes"))).alias("codes"))
            hits = own if hits is None else _both(hits, own, "codes")
        if column is None and len(terms) == 1:
            return hits.select("block", F.col("codes").alias("ids")).where(F.size("ids") > 0)
        return hits.select("block", F.array_distinct(F.transform("codes", lambda c: F.shiftright(c, 32).cast("int"))).alias("ids")).where(F.size("ids") > 0)

    def keyword_scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, file_id, keyword): share of a query's distinct words that a file holds. queries: (query_id, query)."""
        wanted = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("terms")).select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
        rows = self.rows().select("term", "block", "ids")
        few = wanted.select("term").distinct().limit(FEW + 1).collect()  # at most FEW + 1 words
        if len(few) <= FEW:
            rows = rows.where(F.col("term").isin([r["term"] for r in few]))
        hits = _files(rows.join(wanted, "term"), "ids", "query_id", "n")
        return hits.groupBy("query_id", "n", "file_id").agg(F.count(F.lit(1)).alias("k")).select("query_id", "file_id", F.round(F.col("k") / F.col("n"), 6).alias("keyword"))

    def search(self, query: str, k: int = 30) -> DataFrame:
        """(file_id, keyword) of the k best files of one query: the words are known to the plan, so the read, a sum and a limit are all of it."""
        terms = list(dict.fromkeys(t for t in re.split(r"[^a-z0-9\x80-\U0010ffff]+", _lower(query)) if t))
        hits = _files(self.rows().where(F.col("term").isin(terms)).select("block", "ids"), "ids")
        scored = hits.groupBy("file_id").agg(F.count(F.lit(1)).alias("k"))
        return scored.select("file_id", F.round(F.col("k") / max(len(terms), 1), 6).alias("keyword")).orderBy(F.desc("keyword"), "file_id").limit(k)


class NameIndex:
    """Substrings of the names of files, stored in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, files: DataFrame, name: str = "display_name") -> NameIndex:
        store(gram_rows(files, name), f"{self.path}/grams")
        named = files.where(F.col("file_id").isNotNull() & F.col(name).isNotNull()).select(F.shiftright("file_id", BITS).alias("block"), "file_id", F.col(name).alias("name"))
        named.repartitionByRange("block", "file_id").sortWithinPartitions("block", "file_id").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/names")
        return self

    def grams(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/grams")

    def names(self) -> DataFrame:
        return self.spark.read.schema(NAMES).parquet(f"{self.path}/names")

    def search(self, term: str) -> DataFrame:
        """(file_id, name) of the names that contain a term, A-Z folded; % stands for any characters, _ for one."""
        term = _lower(term)
        literal = [part for part in re.split("[%_]+", term) if part]
        hits = None
        for part in literal:
            found = self._part(part)
            hits = found if hits is None else _both(hits, found)
        if hits is None:
            named = self.names()
        else:
            blocks = [r["block"] for r in hits.select("block").distinct().limit(FEW + 1).collect()]  # at most FEW + 1 numbers
            named = self.names()
            if len(blocks) <= FEW:
                named = named.where(F.col("block").isin(blocks))
            named = named.join(_files(hits, "ids").distinct(), "file_id", "left_semi")
        if literal != [term] or END in term:
            named = named.where(ascii_lower(F.col("name")).like("%" + term.replace("\\", "\\\\") + "%"))
        return named.select("file_id", "name")

    def _part(self, part: str) -> DataFrame:
        """(block, ids) of the names with a literal part."""
        if len(part) < GRAM:
            own = self.grams().where(F.startswith("term", F.lit(part))).select("block", "ids")
            return own.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
        rows, hits = self.grams(), None
        for at in _gram_places(len(part)):
            own = rows.where(F.col("term") == part[at : at + GRAM]).select("block", _codes(at).alias("codes"))
            hits = own if hits is None else _both(hits, own, "codes")
        return hits.select("block", F.array_distinct(F.transform("codes", lambda c: F.shiftright(c, 32).cast("int"))).alias("ids"))

    def search_all(self, terms: DataFrame) -> DataFrame:
        """(term_id, file_id) of many literal terms (term_id, term) of three characters or more, each in all names: a join on grams.

        Shorter ones and those with wildcards are looked up one by one by ``search``.
        """
        asked = terms.where(F.length("term") >= GRAM).select("term_id", ascii_lower(F.col("term")).alias("word"))
        last = F.length("word") - GRAM
        at = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(GRAM)), F.array(last)))
        wanted = asked.select("term_id", F.size(at).alias("n"), "word", F.explode(at).alias("at")).select("term_id", "n", "at", F.substring("word", F.col("at") + 1, F.lit(GRAM)).alias("term"))
        met = self.grams().join(wanted, "term").select("term_id", "n", "block", F.transform(_codes(0), lambda c: c - F.col("at")).alias("codes"))
        sets = met.groupBy("term_id", "n", "block").agg(F.collect_list("codes").alias("sets")).where(F.size("sets") == F.col("n"))
        starts = F.reduce(F.slice("sets", 2, F.col("n")), F.col("sets")[0], lambda a, b: F.array_intersect(a, b))
        ids = F.array_distinct(F.transform(starts, lambda c: F.shiftright(c, 32).cast("int")))
        return _files(sets.select("term_id", "block", ids.alias("ids")), "ids", "term_id")


def _lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def _gram_places(length: int) -> list[int]:
    """Places of the grams that cover a part."""
    return sorted({*range(0, length - GRAM + 1, GRAM), length - GRAM})


def _codes(back: int) -> Column:
    """Every place of a row as one number: the file above 32 bits, the place, moved back, below."""
    each = F.flatten(F.transform(F.arrays_zip("ids", "counts"), lambda x: F.array_repeat(x["ids"], x["counts"])))
    return F.transform(F.arrays_zip(each.alias("i"), F.col("places").alias("p")), lambda x: F.shiftleft(x["i"].cast("long"), 32) + x["p"] - back)


def _both(a: DataFrame, b: DataFrame, name: str = "ids") -> DataFrame:
    """What both sides have in a block."""
    joined = a.join(b.select("block", F.col(name).alias("_other")), "block").select("block", F.array_intersect(name, "_other").alias(name))
    return joined.where(F.size(name) > 0)


def _files(rows: DataFrame, ids: str, *more: str) -> DataFrame:
    """Rows of blocks as rows of files."""
    each = rows.select(*more, "block", F.explode(ids).alias("_id"))
    return each.select(*more, F.shiftleft("block", BITS).bitwiseOR(F.col("_id").cast("long")).alias("file_id"))
