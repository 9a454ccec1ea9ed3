"""One entry point: the tables of a file index in a folder, and what can be asked of them or done to them.

Tables are a ``TableGroup`` below the folder: a call that changes several tables commits their changed rows
at once, or nothing. Reads give DataFrames of the newest commit.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schema
from corvane.functions import text as tx
from corvane.operators import albums, classify, cluster, dedup, queue, reads, scan, search, tags
from corvane.operators.postings import NameIndex, TextIndex
from corvane.operators.store import GroupedTable, TableGroup
from corvane.operators.vectorindex import VectorIndex
from corvane.schema import KEYS, Settings

_SCHEMAS = {
    "files": schema.FILES, "albums": schema.ALBUMS, "file_album": schema.FILE_ALBUM, "tags": schema.TAGS, "file_tag": schema.FILE_TAG, "embeddings": schema.EMBEDDINGS, "queue": schema.QUEUE,
    "corrections": schema.CORRECTIONS, "folders": schema.FOLDERS, "suggestions": schema.SUGGESTIONS, "dismissed": schema.DISMISSED,
}


class FileIndex:
    """The index below a folder that all executors share; tables are made empty where they are not there yet."""

    def __init__(self, spark: SparkSession, folder: str, now_ms=lambda: int(time.time() * 1000)):
        self.spark, self.folder, self.now_ms = spark, folder.rstrip("/"), now_ms
        self.settings = Settings().override(spark)
        self.group = TableGroup(spark, f"{self.folder}/tables", {name: KEYS[name] for name in _SCHEMAS})
        self.words, self.names, self.vectors = TextIndex(spark, f"{self.folder}/words"), NameIndex(spark, f"{self.folder}/names"), VectorIndex(spark, f"{self.folder}/vectors")
        self.tables = {name: GroupedTable(self.group, name) for name in _SCHEMAS}
        missing = {name: spark.createDataFrame([], shape) for name, shape in _SCHEMAS.items() if name not in self.group.state()["tables"]}
        if missing:
            self.group.commit(missing)

    def read(self, name: str) -> DataFrame:
        return self.group.read(name).select(_SCHEMAS[name].names)

    def _merge(self, **changes: DataFrame) -> None:
        """Commit changed rows of some tables at once."""
        self.group.commit({name: rows.select(_SCHEMAS[name].names) for name, rows in changes.items()})

    @staticmethod
    def _new(after: DataFrame, before: DataFrame) -> DataFrame:
        """Rows of after that before has not in this form."""
        return after.select(before.columns).exceptAll(before)

    def _write_new(self, name: str, after: DataFrame, before: DataFrame) -> None:
        self._merge(**{name: self._new(after, before)})

    # files ---------------------------------------------------------------------------------------

    def sync(self, discovered: DataFrame) -> DataFrame:
        """Take a scan over; (file_id, change_type) of new and changed files."""
        merged, touched = scan.sync_scan(discovered, self.read("files"), self.now_ms())
        touched = touched.persist()
        self._merge(files=merged.join(touched.select("file_id"), "file_id", "left_semi"))
        return touched

    def mark_missing(self, discovered: DataFrame) -> None:
        before = self.read("files")
        self._write_new("files", scan.mark_missing(before, discovered), before)

    def files(self) -> DataFrame:
        return reads.live_by_name(self.read("files"))

    def status(self) -> DataFrame:
        return reads.status_counts(self.read("files"), self.read("queue"))

    # albums, tags and suggestions ----------------------------------------------------------------

    def seed_albums(self) -> None:
        before = self.read("albums")
        self._write_new("albums", albums.seed(before, self.now_ms()), before)

    def create_album(self, name: str, parent: int | None = None) -> None:
        before = self.read("albums")
        self._write_new("albums", albums.create(before, name, parent, self.now_ms()), before)

    def album_tree(self) -> DataFrame:
        return albums.tree(self.read("albums"), reads.album_counts(self.read("albums"), self.read("file_album")))

    def classify(self, files: DataFrame | None = None) -> DataFrame:
        """Decide on files (those with content and no album, else the given ones); sure ones are assigned, others suggested."""
        own = self.read("files")
        if files is None:
            files = reads.live(own).where(F.col("primary_album_id").isNull() & F.col("processing_status").isin("CONTENT_DONE", "CLASSIFIED"))
        said = classify.decide(files, self.read("albums"), tx.classification_text(F.col("display_name"), F.col("extracted_text")), None, None, self.settings).persist()
        now = F.lit(self.now_ms()).cast("long")
        sure = said.where("decision = 'ASSIGN'").select("file_id", "album_id", "confidence", F.lit("AUTO").alias("assigned_by"), now.alias("assigned_at"))
        self.assign(sure)
        offers = said.where("decision = 'SUGGEST'").select("file_id", F.col("album_id").alias("suggested_album_id"), "confidence", "reasons", now.alias("created_at"))
        before = self.read("suggestions")
        self._write_new("suggestions", albums.offer(before, offers), before)
        return said

    def assign(self, rows: DataFrame) -> None:
        """rows: (file_id, album_id, confidence, assigned_by, assigned_at)."""
        files, links = albums.assign(self.read("files"), self.read("file_album"), rows)
        self._merge(files=files.join(rows.select("file_id").distinct(), "file_id", "left_semi"), file_album=links.join(rows.select("file_id", "album_id"), ["file_id", "album_id"], "left_semi"))

    def accept(self, keys: DataFrame) -> None:
        """keys: (file_id, suggested_album_id) of pending suggestions."""
        files, links, suggestions = albums.accept(self.read("files"), self.read("file_album"), self.read("suggestions"), keys, self.now_ms())
        self._merge(files=self._new(files, self.read("files")), file_album=self._new(links, self.read("file_album")), suggestions=self._new(suggestions, self.read("suggestions")))

    def reject(self, keys: DataFrame) -> None:
        before = self.read("suggestions")
        self._write_new("suggestions", albums.answer(before, keys.withColumn("answer", F.lit("REJECTED"))), before)

    def correct(self, rows: DataFrame) -> None:
        """rows: (file_id, album_id) that a user says."""
        files, links, corrections = albums.correct(self.read("files"), self.read("file_album"), self.read("corrections"), rows, self.now_ms())
        changes = {}
        for name, after in (("files", files), ("file_album", links), ("corrections", corrections)):
            before = self.read(name)
            changes[name] = self._new(after.select([c if c in after.columns else F.lit(None).cast(before.schema[c].dataType).alias(c) for c in before.columns]), before)
        self._merge(**changes)

    def extract_tags(self, files: DataFrame) -> DataFrame:
        return tags.extract_tags(files, F.col("extracted_text"), reads.text_sample(self.read("files"), 300), F.col("extracted_text"))

    def sweep(self) -> DataFrame:
        """Clusters of files without an album that are worth one."""
        vectors = self.read("embeddings")
        centroids = cluster.mean_vectors(vectors.join(self.read("file_album").select("file_id", "album_id"), "file_id"), "album_id").select("album_id", "centroid")
        return cluster.reconcile(self.read("files"), vectors, self.read("albums"), centroids, self.settings)

    # queue ---------------------------------------------------------------------------------------

    def enqueue(self, files: DataFrame, level: int, priority: int = 0) -> None:
        before = self.read("queue")
        self._write_new("queue", queue.enqueue(before, files, level, priority), before)

    def drain(self, stages: dict, only_level: int | None = None) -> None:
        now = self.now_ms()
        before = self.read("queue")
        due = queue.eligible(before, now).select("queue_id", "file_id").persist()
        items, files = queue.drain(before, self.read("files"), stages, now, only_level)
        self._merge(files=files.join(due.select("file_id").distinct(), "file_id", "left_semi"), queue=items.join(due.select("queue_id"), "queue_id", "left_semi"))
        due.unpersist()

    # search and duplicates -----------------------------------------------------------------------

    def build_search(self) -> None:
        """Write the stored indexes of words, names and vectors of the live files anew."""
        live = reads.live(self.read("files"))
        self.words.write(live)
        self.names.write(live)
        self.vectors.write(self.read("embeddings").join(live.select("file_id"), "file_id", "left_semi"))

    def _live(self, found: DataFrame) -> DataFrame:
        return reads.live(self.read("files")).join(found, "file_id", "left_semi").orderBy("file_id")

    def match(self, query: str) -> DataFrame:
        """Live files that fit a match query."""
        return self._live(self.words.match(query))

    def find_names(self, term: str, n: int = 50) -> DataFrame:
        """(file_id, display_name) of live files whose name contains a term; % and _ are wildcards."""
        found = self.names.search(term).join(reads.live(self.read("files")).select("file_id"), "file_id", "left_semi")
        return found.select("file_id", F.col("name").alias("display_name")).orderBy("display_name", "file_id").limit(n)

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, file_id, keyword) of (query_id, query), from the stored index."""
        return self.words.keyword_scores(queries)

    def nearest(self, vectors: list[tuple[int, list[float]]], k: int = 10) -> DataFrame:
        """(query_id, rank, file_id, score) of stated vectors, from the stored index."""
        return self.vectors.search(vectors, k)

    def hybrid(self, query: str, vector: list[float] | None = None, k: int = 30) -> DataFrame:
        """(file_id, score): candidates by words and by vector together, ranked by all their scores.

        The score of a name is the share of the query's words that it holds, that of the metadata the same
        for the file's tags.
        """
        keyword = self.words.search(query, k).withColumn("query_id", F.lit(0))
        semantic = self.vectors.search([(0, vector)], k, exclude_self=False) if vector is not None else keyword.select("query_id", "file_id", F.lit(0.0).alias("score")).limit(0)
        semantic = semantic.select(F.lit(0).alias("query_id"), "file_id", F.col("score").alias("semantic"))
        candidates = keyword.select("file_id").unionByName(semantic.select("file_id")).distinct()
        asked = F.array_distinct(search.words(F.lit(query)))
        share = lambda text: F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, search.words(text))) / F.size(asked)).otherwise(0.0)
        few = reads.live(self.read("files")).join(F.broadcast(candidates), "file_id").select(F.lit(0).alias("query_id"), "file_id", "display_name", "extracted_text", F.coalesce("tags_concat", F.lit("")).alias("tags"))  # at most 2 k candidates
        told = few.select("query_id", "file_id", F.round(share(F.concat_ws(" ", "display_name", "extracted_text")), 6).alias("keyword"), F.round(share(F.col("display_name")), 6).alias("filename"), F.round(share(F.col("tags")), 6).alias("metadata"))
        keys = ["query_id", "file_id"]
        return search.hybrid(told.select(*keys, "keyword"), semantic, told.select(*keys, "filename"), told.select(*keys, "metadata"), 2 * k, self.settings).select("file_id", "score").orderBy(F.desc("score"), "file_id")

    def related(self, file_ids: list[int]) -> DataFrame:
        """(query_id, file_id, score) of the files most like some stated files."""
        own = self.read("embeddings").where(F.col("file_id").isin(file_ids)).select("file_id", "vector")
        near = self.vectors.search([(r["file_id"], r["vector"]) for r in own.collect()], self.settings.related_top_k)  # the stated files
        return search.related(near, self.read("file_album"), self.read("file_tag"), self.read("files"), self.settings)

    def duplicates(self) -> DataFrame:
        """Groups of live files: equal contents, and images whose hashes are near or equal. Of equal contents, the representative alone has a hash that counts."""
        files, s = self.read("files"), self.settings
        exact = dedup.exact_groups(files)
        copies = reads.live(files).join(exact, "sha256_hash").where("file_id != representative_file_id").select("file_id")
        hashes = reads.live(files).join(copies, "file_id", "left_anti").select("file_id", F.col("perceptual_hash").alias("phash"))
        near = dedup.with_copies(dedup.hamming_pairs(hashes, s.duplicate_phash_hamming_similar, s.duplicate_phash_hamming_near), hashes)
        return dedup.duplicate_groups(exact, near, files, self.read("dismissed"))

    def dismiss(self, pairs: DataFrame) -> None:
        """pairs: (file_a, file_b) that are no duplicates."""
        self._merge(dismissed=pairs)

    def compact(self) -> None:
        self.group.compact()
