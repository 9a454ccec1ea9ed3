"""Whitening of embeddings by matrix-free block Lanczos.

Every entry c becomes the integer x = floor(64 c) + 1,000,000. The covariance V of the x-vectors is never
formed: a pass over the rows gives V times a block of vectors, as the sum of centred rows times their
products with the block. ``lanczos`` asks for such passes. Each new block is orthogonalised against all
earlier ones, twice; directions that have vanished (breakdown) are replaced by random ones orthogonal to the
basis, so equal eigenvalues and invariant subspaces are found whole. It ends when the residuals of all wanted
pairs are as small as double precision gives them, or the basis spans the space; a basis of ``BASIS``
columns is begun again from its best vectors. Eigenvalues are shares of the trace, which comes from the
exact deviations of the rows.

Sums, deviations and n are exact integers; x - S/n is computed as (x - floor(S/n)) - (S mod n)/n, which
loses nothing to the size of x. A last pass forms the covariance of the whitened rows, centred by their means,
for ``identity_error``.

Cases: vectors that are null or hold null or non-finite entries leave; vectors of several lengths are
filled up with zeros to the longest; x is kept within 62 bits; a deviation beyond 63 bits is null; repeated
rows and null ids are rows like others. Components whose eigenvalue isn't above 1e-12 of the
largest have no scale and are left out, so a single row, or equal rows, give no result, like an empty table.
Other columns play no part.

Scale: rows are read once and kept as integers in a working table; each pass reads it once and sends one
partial sum a task, added up by Spark. The driver holds the basis, BASIS x dimensions, and its
products: it grows with the length of vectors, not with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.kernel import tidy
from corvane.runtime import Workspace, arrow_rows, ship_package, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK = 32
BASIS = 512
ROUNDS = 200
LARGEST = 1 << 62
TINY = 1e-12  # of the largest eigenvalue
_SAFE = 9e18


def whole_numbers(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """x of every vector that remains, rows x length, and which rows remain."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(column).cast(pa.float64())
    values = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    finite = np.diff(np.concatenate([[0], np.cumsum(np.isfinite(values))])[bounds]) == sizes
    good = np.flatnonzero(finite & pc.is_valid(column).to_numpy(zero_copy_only=False))
    out = np.full((len(good), length), SHIFT, dtype=np.int64)
    n = sizes[good]
    if n.sum():
        row = np.repeat(np.arange(len(good)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        taken = values[np.repeat(bounds[good], n) + at]
        bound = float(LARGEST)
        scaled = np.clip(np.floor(np.clip(taken, -bound / SCALE, bound / SCALE) * SCALE), -bound, bound - 1024)
        out[row, at] = scaled.astype(np.int64) + SHIFT
    return out, good


def _matrices(batches: Iterator[pa.RecordBatch], at: int, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


class Fit:
    """n, exact sums S, and the rows centred by them."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], dtype=object)
        self.rest = np.array([(s % n) / n for s in sums])
        self.small = all(abs(f) < 1 << 61 for f in self.floor)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n as doubles."""
        if self.small and np.abs(x).max(initial=0) < 1 << 61:
            return (x - self.floor.astype(np.int64)).astype(np.float64) - self.rest
        return (x.astype(object) - self.floor).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 of each row, exact."""
        bound = float(np.abs(self.centred(x)).max(initial=0) + 1) * self.n
        if bound * bound * x.shape[1] < _SAFE and self.small and max(map(abs, self.sums), default=0) < _SAFE and float(np.abs(x).max(initial=0)) * self.n < _SAFE:
            apart = x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
            return (apart * apart).sum(axis=1).tolist()
        apart = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        return (apart * apart).sum(axis=1).tolist()


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """Orthonormal columns for block, orthogonal to basis; those that vanish (below scale) become random ones."""
    out, room = basis, basis.shape[0] - basis.shape[1]
    for j in range(min(block.shape[1], room)):
        v, least = block[:, j], scale
        while True:
            for _ in range(2):
                v = v - out @ (out.T @ v)
            size = np.linalg.norm(v)
            if size > least:
                break
            v, least = rng.standard_normal(len(v)), 1e-8  # breakdown: go on in a new direction
        v = v / size
        v = v - out @ (out.T @ v)
        out = np.column_stack([out, v / np.linalg.norm(v)])
    return out[:, basis.shape[1] :]


def lanczos(product: Callable[[np.ndarray], np.ndarray], length: int, wanted: int, block: int = BLOCK, most: int = BASIS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit vectors (columns), of the symmetric matrix behind product."""
    rng, wanted = np.random.default_rng(seed), min(wanted, length)
    block = max(block, wanted)  # equal eigenvalues are found as often as a block has columns
    most = max(most, 4 * block)
    basis, image = np.zeros((length, 0)), np.zeros((length, 0))
    new = orthonormal(rng.standard_normal((length, block)), basis, rng, 1e-8)
    best = np.inf
    for _ in range(ROUNDS):
        basis, image = np.column_stack([basis, new]), np.column_stack([image, product(new)])
        inner = basis.T @ image
        values, inside = np.linalg.eigh((inner + inner.T) / 2)
        values, inside = values[::-1][: most // 2], inside[:, ::-1][:, : most // 2]
        vectors, moved = basis @ inside, image @ inside
        apart = moved - vectors * values
        residual, scale = np.linalg.norm(apart[:, :wanted], axis=0).max(initial=0), max(abs(values[0]), np.finfo(float).tiny)
        settled = residual <= 4e-15 * scale or (residual <= 1e-12 * scale and residual > best / 2)
        if basis.shape[1] == length or (basis.shape[1] >= wanted and settled):
            return values[:wanted], np.linalg.qr(vectors[:, :wanted])[0]
        best = min(best, residual)
        if basis.shape[1] + block > most < length:
            basis, image = vectors, moved  # begin again from the best half; what they lack spans one block
            new = orthonormal(np.linalg.svd(apart, full_matrices=False)[0][:, :block], basis, rng, 1e-8)
        else:
            new = orthonormal(image[:, -new.shape[1] :], basis, rng, 1e-13 * scale)
    raise ArithmeticError(f"no convergence: residual {residual:.3g} beside {scale:.3g} after {ROUNDS} passes")


def _summed(rows: DataFrame, length: int, width: int, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of make(matrix of rows), an array of width columns; one partial sum a task."""

    def run(batches):
        total = None
        for _, x in _matrices(batches, 0, length):
            part = make(x)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(total[:, j]) for j in range(width))], ["slot", *(f"c{j}" for j in range(width))])

    names = [f"c{j}" for j in range(width)]
    parts = rows.select("x").mapInArrow(tidy(run), "slot int, " + ", ".join(f"{c} double" for c in names))
    found = parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in names]).orderBy("slot").toArrow()  # one row a slot: bounded by the length of vectors
    return np.column_stack([found.column(c).to_numpy() for c in names])


def _numbers(vectors: DataFrame, id: str, embedding: str, work: Workspace) -> tuple[DataFrame, int]:
    """Working table (vec_id, x) of the rows that remain, and the length of x."""
    picked = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    length = picked.where(~F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))).agg(F.max(F.size("vector"))).first()[0] or 0

    def run(batches):
        for batch in batches:
            x, good = whole_numbers(batch.column(1), length)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1) * length, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), listed], ["vec_id", "x"])

    return work.write(picked.mapInArrow(tidy(run), "vec_id long, x array<long>"), "numbers"), length


def _exact_sums(rows: DataFrame, length: int) -> tuple[int, list[int]]:
    def run(batches):
        n, total = 0, np.zeros(length, dtype=object)
        for _, x in _matrices(batches, 0, length):
            n += len(x)
            total = total + (x.sum(axis=0) if float(np.abs(x).max(initial=0)) * len(x) < _SAFE else x.astype(object).sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(length)], pa.int32()), pa.array([str(v) for v in (n, *total)])], ["slot", "s"])

    found = rows.select("x").mapInArrow(tidy(run), "slot int, s string").groupBy("slot").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    exact = {r["slot"]: int(r["s"]) for r in found.collect()}  # one row a dimension
    return exact.get(-1, 0), [exact.get(j, 0) for j in range(length)]


def whiten(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, label: str = "whitening") -> DataFrame:
    """One row a remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    ship_package(spark)
    arrow_rows(spark, 4096)
    work = Workspace(spark, label)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, length = _numbers(vectors, id, embedding, work)
    n, sums = _exact_sums(rows, length) if length else (0, [])
    if not n:
        return spark.createDataFrame([], schema)
    fit = Fit(n, sums)

    def product(block):
        def part(x):
            centred = fit.centred(x)
            return centred.T @ (centred @ block)

        return _summed(rows, length, block.shape[1], part) / n

    values, columns = lanczos(product, length, components)
    # the sum of exact deviations, as doubles of at most 2**53 each
    trace = _summed(rows, length, 1, lambda x: np.array([[float(sum(fit.deviations(x)))]]))[0, 0] / n / n / n
    kept = values > TINY * max(values[0], 0)
    values, columns = values[kept], columns[:, kept]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = columns / np.sqrt(values)

    def moments(x):
        w = fit.centred(x) @ scaled
        return np.vstack([w.T @ w, w.sum(axis=0)])

    sums_of = _summed(rows, length, k, moments)
    mean = sums_of[k] / n  # zero but for rounding, as rows are centred before they are multiplied
    identity_error = float(np.abs(sums_of[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = values / trace

    def run(batches):
        for batch, x in _matrices(batches, 1, length):
            m = len(x)
            deviation = pa.array([d if d < 1 << 63 else None for d in fit.deviations(x)], pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    deviation.take(each),
                    pa.array((fit.centred(x) @ scaled).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(tidy(run), schema)


def op13_embedding_whitening(spark, sf_dir):
    """Contract query over all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
