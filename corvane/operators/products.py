"""Products of all vectors with a stated, bounded side: matrix products over Arrow batches, the side in blocks.

The side (queries, centroids) is read in blocks of ``SIDE`` vectors; each block is sent to the tasks and
costs one pass over the rows, so neither memory nor a broadcast grows with either side, and no pair is
ever a row. Products are made in tiles of ``TILE`` rows a side, so a worker holds a few tiles at most. Vectors of different lengths are multiplied over the shorter length; a null vector counts as
empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.runtime import arrow_rows, ship_package

SIDE = 1 << 14
TILE = 1 << 11
TIE = 2e-6  # scores are rounded to six places later


def _matrix(lists) -> np.ndarray:
    """Rows of a list column, or of lists, padded with zeros."""
    column = lists if isinstance(lists, pa.Array) else pa.array(lists, pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.list_flatten(column).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = min(a.shape[1], b.shape[1])
    return a[:, :n] @ b[:, :n].T


def _blocks(side: DataFrame, key: str, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    rows: list = []
    for row in side.select(key, vector).toLocalIterator():
        rows.append(row)
        if len(rows) == SIDE:
            yield [r[0] for r in rows], _matrix([r[1] for r in rows])
            rows = []
    if rows:
        yield [r[0] for r in rows], _matrix([r[1] for r in rows])


def best_product(rows: DataFrame, id: str, vector: str, side: DataFrame, side_vector: str) -> DataFrame:
    """(id, best): the largest product of each row with any vector of the side; nothing without a side."""
    spark, kind, found = rows.sparkSession, dict(rows.dtypes)[id], None
    ship_package(spark)
    arrow_rows(spark, TILE)
    picked = rows.select(id, vector)
    for _, block in _blocks(side.withColumn("_", F.lit(0)), "_", side_vector):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                x, best = _matrix(batch.column(1)), np.full(batch.num_rows, -np.inf)
                for at in range(0, len(shared.value), TILE):
                    np.maximum(best, _product(x, shared.value[at : at + TILE]).max(axis=1), out=best)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best)], names=[id, "best"])

        part = picked.mapInArrow(run, f"{id} {kind}, best double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return picked.select(id, F.lit(0.0).alias("best")).limit(0)
    return found.groupBy(id).agg(F.max("best").alias("best"))


def top_products(rows: DataFrame, id: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, exclude_self: bool) -> DataFrame:
    """(query, id, score) of at least the k rows with the largest products of each query, ties with the last one included."""
    spark, kinds, found = rows.sparkSession, (dict(queries.dtypes)[query], dict(rows.dtypes)[id]), None
    ship_package(spark)
    arrow_rows(spark, TILE)
    picked = rows.select(id, vector)
    for keys, block in _blocks(queries, query, query_vector):
        shared = spark.sparkContext.broadcast((np.array(keys), block))

        def run(batches, shared=shared):
            names, block = shared.value
            for batch in batches:
                own, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
                for at in range(0, len(names), TILE):
                    asked = names[at : at + TILE]
                    scores = _product(block[at : at + TILE], x)
                    if exclude_self:
                        scores[asked[:, None] == own[None, :]] = -np.inf
                    if scores.shape[1] > k:
                        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                    else:
                        floor = np.full(len(asked), -np.inf)
                    q, r = np.nonzero((scores >= floor[:, None] - TIE) & (scores > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(asked[q]), batch.column(0).take(pa.array(r)), pa.array(scores[q, r])], names=[query, id, "score"])

        part = picked.mapInArrow(run, f"{query} {kinds[0]}, {id} {kinds[1]}, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.select(query).limit(0).join(picked.select(id).limit(0)).withColumn("score", F.lit(0.0))
    return found
