"""A stored index of vectors: nearest neighbours from a part of its files, the same rows as a comparison with all.

Cells are the vectors nearest to one of a bounded number of centroids, fitted on a bounded sample. The table
has a row a vector: its cell, its distance from the centroid, its id and its numbers; it is sorted by cell
and distance, in small row groups. Beside it lies a small table of the cells: centroid, radius, size.

For a query q and a vector x at distance r from its centroid c, q.x <= q.c + |q| r. A first read takes, for
every query, the cells with the best centroids until they hold k vectors; the k-th product there is a
floor. The second read takes the rest of what can reach the floor: in each cell the vectors with
r >= (floor - q.c) / |q|, as filters that reach the files' statistics. All products are in double precision
on the stored numbers, and rounding is allowed for in the bound, so no neighbour is lost.

Cases: a null vector, or one without numbers, counts as zeros; vectors of several lengths are filled up with
zeros; files without an id aren't in the index; equal products are ordered by id; an empty index, or no
queries, give no rows.

Scale: the sample and the centroids (``SAMPLE``, ``MOST_CELLS``) are the only things on the driver, beside the
stated queries; writing is one map and one sort by range. Cells grow beyond MOST_CELLS x ``CELL`` vectors,
and are still read in part, by distance. For vectors without groups the bound leaves most cells in: then
a search reads most of the table, once.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators.products import TIE, _matrix
from corvane.runtime import arrow_rows, ship_package

SAMPLE = 1 << 14
CELL = 512
MOST_CELLS = 4096
ROUNDS = 8
ROW_GROUP = 1 << 18
FILTERS = 256  # cells that the second read names with a distance of their own
SCHEMA = "cell int, distance double, file_id long, vector binary"
_FOUND = "query int, file_id long, score double"


def fit_centroids(x: np.ndarray, cells: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from rows far apart from each other."""
    centres = x[:1]
    nearest = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, cells):
        at = int(nearest.argmax())
        if nearest[at] <= 0:
            break
        centres = np.vstack([centres, x[at]])
        nearest = np.minimum(nearest, ((x - x[at]) ** 2).sum(axis=1))
    for _ in range(ROUNDS):
        own = _nearest(x, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of every row and the distance from it."""
    own = ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(axis=1))


def _padded(x: np.ndarray, length: int) -> np.ndarray:
    return np.pad(x[:, :length], ((0, 0), (0, length - min(length, x.shape[1]))))


def _best(scored: DataFrame, k: int, queries: int) -> DataFrame:
    """The k best of each query with their rank; those of a single query need no shuffle."""
    if queries == 1:
        scored = scored.orderBy(F.desc("rounded"), "file_id").limit(k)
    order = Window.partitionBy("query").orderBy(F.desc("rounded"), "file_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._cells: tuple | None = None

    def write(self, embeddings: DataFrame) -> VectorIndex:
        """Store the vectors of (file_id, vector)."""
        spark = self.spark
        ship_package(spark)
        arrow_rows(spark, 2048)
        rows = embeddings.where(F.col("file_id").isNotNull()).select(F.col("file_id").cast("long").alias("file_id"), F.col("vector").cast("array<float>").alias("vector"))
        n, length = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        length = max(length or 0, 1)
        picked = rows.orderBy(F.xxhash64("file_id"), "file_id").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
        sample = _padded(_matrix(picked), length) if len(picked) else np.zeros((1, length))
        centres = fit_centroids(sample, int(min(MOST_CELLS, max(1, n // CELL), max(1, len(sample) // 4))))
        shared = spark.sparkContext.broadcast(centres)

        def run(batches):
            for batch in batches:
                x = _padded(_matrix(batch.column(1)), length)
                own, distance = _nearest(x, shared.value)
                raw = x.astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(distance), batch.column(0), pa.array([r.tobytes() for r in raw], pa.binary())], ["cell", "distance", "file_id", "vector"])

        assigned = rows.mapInArrow(run, SCHEMA)
        assigned.repartitionByRange("cell", "distance").sortWithinPartitions("cell", "distance", "file_id").write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{self.path}/vectors")
        told = self.rows().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius"))
        kept = spark.createDataFrame([(i, json.dumps(c.tolist())) for i, c in enumerate(centres)], "cell int, centre string")
        kept.join(told, "cell").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells")
        self._cells = None
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/vectors")

    def cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centroids, radii and sizes of the cells, at most MOST_CELLS, read once."""
        if self._cells is None:
            found = self.spark.read.schema("cell int, centre string, n long, radius double").parquet(f"{self.path}/cells").orderBy("cell").collect()
            centres = np.array([json.loads(r["centre"]) for r in found]) if found else np.zeros((0, 1))
            self._cells = np.array([r["cell"] for r in found], int), centres, np.array([r["radius"] for r in found]), np.array([r["n"] for r in found], int)
        return self._cells

    def search(self, queries: list[tuple[int, list[float]]], k: int, exclude_self: bool = True, floor: float | None = None) -> DataFrame:
        """(query_id, rank, file_id, score): the k largest products of each stated query, above floor."""
        found, floors, wanted = None, None, None
        numbers, centres, radii, sizes = self.cells()
        if queries and len(numbers):
            q = _padded(_matrix([v for _, v in queries]), centres.shape[1])
            length = np.linalg.norm(q, axis=1)
            near = q @ centres.T
            slack = 1e-9 * (1 + length[:, None] * (np.linalg.norm(centres, axis=1) + radii)[None, :])
            first = np.zeros(near.shape, bool)
            for i, order in enumerate(np.argsort(-near, axis=1, kind="stable")):
                first[i, order[: int(np.searchsorted(np.cumsum(sizes[order]), k + 1)) + 1]] = True
            ids = [i for i, _ in queries]
            seeds = self._products(numbers[first.any(axis=0)].tolist(), None, q, ids, first, numbers, k, exclude_self)
            best = _best(seeds.withColumn("rounded", F.round("score", 6)), k, len(queries)).drop("rounded", "rank").toArrow()  # at most k rows a stated query
            by, scores = best.column("query").to_numpy(), best.column("score").to_numpy()
            floors = np.array([scores[by == i].min() if (by == i).sum() == k else -np.inf for i in range(len(q))]) - TIE
            if floor is not None:
                floors = np.maximum(floors, floor - TIE)
            wanted = (near + length[:, None] * radii + slack >= floors[:, None]) & ~first
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(wanted, np.where(length[:, None] > 0, (floors[:, None] - near - slack) / length[:, None], -np.inf), np.inf).min(axis=0)
            rest = np.flatnonzero(wanted.any(axis=0))
            found = self.spark.createDataFrame(best.select(["query", "file_id", "score"])) if best.num_rows else None
            if len(rest):
                more = self._products(numbers[rest].tolist(), least[rest].tolist(), q, ids, wanted, numbers, k, exclude_self)
                found = more if found is None else found.unionByName(more)
        if found is None:
            return self.spark.createDataFrame([], "query_id long, rank int, file_id long, score double")
        scored = found.withColumn("rounded", F.round("score", 6))
        if floor is not None:
            scored = scored.where(F.col("rounded") >= floor)
        named = F.array(*[F.lit(i).cast("long") for i in ids])[F.col("query")]
        return _best(scored, k, len(queries)).select(named.alias("query_id"), "rank", "file_id", F.col("rounded").alias("score"))

    def _products(self, cells: list[int], least: list[float] | None, q: np.ndarray, ids: list, visits: np.ndarray, numbers: np.ndarray, k: int, exclude_self: bool) -> DataFrame:
        """At least the k largest products of each query with the vectors of the cells that it visits, ties included."""
        rows = self.rows()
        if least is None or len(cells) > FILTERS:
            rows = rows.where(F.col("cell").isin(cells))
        else:
            part = F.lit(False)
            for cell, distance in zip(cells, least):
                part = part | ((F.col("cell") == cell) & (F.col("distance") >= (distance if np.isfinite(distance) else 0.0)))
            rows = rows.where(part)
        shared = self.spark.sparkContext.broadcast((q, np.array(ids, dtype=object), {int(n): np.flatnonzero(visits[:, j]) for j, n in enumerate(numbers) if visits[:, j].any()}))

        def run(batches):
            q, ids, by_cell = shared.value
            for batch in batches:
                cell, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f4").astype(np.float64).reshape(len(own), -1) if len(own) else np.zeros((0, 1))
                for c in np.unique(cell).tolist():
                    at, asked = np.flatnonzero(cell == c), by_cell.get(c, np.zeros(0, int))
                    if not len(asked):
                        continue
                    scores = q[asked] @ x[at].T
                    if exclude_self:
                        scores[ids[asked][:, None] == own[at][None, :]] = -np.inf
                    low = np.partition(scores, len(at) - k, axis=1)[:, len(at) - k] if len(at) > k else np.full(len(asked), -np.inf)
                    a, b = np.nonzero((scores >= low[:, None] - TIE) & (scores > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(asked[a], pa.int32()), pa.array(own[at[b]]), pa.array(scores[a, b])], ["query", "file_id", "score"])

        return rows.select("cell", "file_id", "vector").mapInArrow(run, _FOUND)
