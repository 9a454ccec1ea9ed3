"""Embedding near-duplicates by spherical k-means cells and blocked cosine products.

Equal vectors are one class with a multiplicity. Spherical k-means is fitted on at most ``SAMPLE``
classes (those with the smallest hash of their id); centroids closer than ``SPREAD`` to an earlier one are
dropped, so a large group of near copies is one cell, not many. Every class belongs to the cell of its
nearest centroid and visits all cells before it whose members can lie within the angle of a link. Within
a cell, members meet members and visitors in blocks of about ``BLOCK`` rows a side, by matrix products of
``TILE`` rows a side in double precision. A pair meets in the earlier of its two cells only. A block pair
gives sums of links by vector and one edge a vector to the smallest of its group, never the pairs. A
component keeps its smallest vector.

No link is lost, at any size: members of a cell lie on its side of the plane halfway between its centroid
and that of any other cell, so a vector further than the angle from that plane links with none of them.

Cases: vectors that are null, empty, all zero or hold null or non-finite components link with nothing;
vectors of different lengths don't link; repeated rows are equal vectors. Null ids link like others but
name no component: it has its smallest id that isn't null, and only a component of null ids alone has
null, where all rows are kept. Classes are numbered apart from ids. Other columns play no part.

Scale: cells hold about ``CELL`` classes up to ``MOST_CELLS`` cells; beyond that cells grow and are split
into more block pairs. Centroids (MOST_CELLS x length) are the only thing sent to all tasks. Vectors in
groups visit few cells. Those without any (in many dimensions no plane is far from them) visit most, so
that their work grows with the square of their number: an exact answer has no less to compare here.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.kernel import tidy, tidy_group
from corvane.runtime import Workspace, arrow_rows, ship_package, table

COSINE = 0.9
SAMPLE = 16384
CELL = 4096
MOST_CELLS = 4096
SPREAD = 0.8
BLOCK = 16384
TILE = 2048
ROUNDS = 12


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, length)


def pack_vectors(column: pa.Array) -> pa.Array:
    """Lists of numbers as bytes of doubles; null for those that link with nothing."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(pc.list_flatten(column).cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    within = lambda test: np.diff(np.concatenate([[0], np.cumsum(test)])[bounds])
    good = (within(np.isfinite(values)) == sizes) & (within(values != 0) > 0)
    with np.errstate(over="ignore", invalid="ignore"):
        squares = np.add.reduceat(np.append(values * values, 0.0), bounds[:-1]) if len(sizes) else np.zeros(0)
    for i in np.flatnonzero(good & ((squares == np.inf) | (squares < 1e-280))).tolist():  # squares leave the range of doubles
        own = values[bounds[i] : bounds[i + 1]]
        own /= np.abs(own).max()
    packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds * 8), pa.py_buffer(np.ascontiguousarray(values, "<f8"))])
    return pc.if_else(pa.array(good), packed, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def _packed(vectors: DataFrame, id: str, embedding: str) -> DataFrame:
    """(vec_id, packed binary of doubles or null)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pack_vectors(batch.column(1))], names=["vec_id", "packed"])

    return vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).mapInArrow(tidy(run), "vec_id long, packed binary")


def fit_cells(sample: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of spherical k-means."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    k = max(1, min(k, len(unit)))
    centre = unit[np.random.Generator(np.random.PCG64(3)).choice(len(unit), k, replace=False)]
    for _ in range(ROUNDS):
        centre = _apart(centre)
        best = np.argmax(unit @ centre.T, axis=1)
        order = np.argsort(best, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(best[order]) > 0]))
        sums = np.add.reduceat(unit[order], first, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = (sums / np.maximum(norm, 1e-12))[norm[:, 0] > 1e-12]
    return _apart(centre)


def _apart(centre: np.ndarray) -> np.ndarray:
    """Without centroids that are close to an earlier one."""
    close = np.triu(centre @ centre.T > SPREAD, 1)
    gone = np.zeros(len(centre), bool)
    for i in np.flatnonzero(close.any(axis=1)):
        if not gone[i]:
            gone |= close[i]
    return centre[~gone]


def _assigned(classes: DataFrame, centres: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """(length, cell, rep, weight, home, packed): every class in its cell and in those before it that may hold links."""
    reach = np.sqrt(1 - cosine * cosine) + 1e-9 if cosine > 0 else 2.0  # how far beyond a plane a link goes; 2: anywhere

    def run(batches):
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                x = _matrix(batch.column(3).take(pa.array(at)), length)
                centre = centres[int(length)]
                near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ centre.T
                home = np.argmax(near, axis=1)
                gap = np.sqrt(np.maximum(2 - 2 * (centre[home] @ centre.T), 0.0))
                cell = np.arange(len(centre))
                row, cell = np.nonzero((cell == home[:, None]) | ((cell < home[:, None]) & (near[np.arange(len(at)), home][:, None] - near <= reach * gap + 1e-9)))
                take = pa.array(at[row])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), length, np.int32)), pa.array(cell.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array(home[row].astype(np.int32)), batch.column(3).take(take)], names=["length", "cell", "rep", "weight", "home", "packed"])

    return classes.select("rep", "weight", "length", "packed").mapInArrow(tidy(run), "length int, cell int, rep long, weight long, home int, packed binary")


def _blocks(assigned: DataFrame, block: int) -> DataFrame:
    """Rows dealt to block pairs: left blocks hold members and visitors, right blocks members.

    side: 1 left, 2 right, 3 both (a cell of one block pair).
    """
    inside = F.col("home") == F.col("cell")
    cells = assigned.groupBy("length", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nl"), F.greatest(F.lit(1), F.ceil(F.count_if(inside) / block)).cast("int").alias("nr"))
    dealt = assigned.join(F.broadcast(cells), ["length", "cell"])  # at most MOST_CELLS rows a vector length
    here = lambda n: F.pmod(F.xxhash64("rep", F.col("packed")), F.col(n)).cast("int")
    one = (F.col("nl") == 1) & (F.col("nr") == 1)
    lefts = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda r: F.struct(here("nl").alias("l"), r.alias("r"), F.when(one & inside, 3).otherwise(1).alias("side")))
    rights = F.when(inside & ~one, F.transform(F.sequence(F.lit(0), F.col("nl") - 1), lambda left: F.struct(left.alias("l"), here("nr").alias("r"), F.lit(2).alias("side"))))
    return dealt.select("length", "cell", "rep", "weight", "home", "packed", F.explode(F.concat(lefts, F.coalesce(rights, F.array().cast("array<struct<l:int,r:int,side:int>>")))).alias("b")).select("length", "cell", "b.l", "b.r", "b.side", "rep", "weight", "home", "packed")


def _compare(dealt: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, root): links that a block pair gives a class, and the smallest class of its group there."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side, rep, weight, home = (t.column(c).to_numpy() for c in ("side", "rep", "weight", "home"))
        cell, length = t.column("cell")[0].as_py(), t.column("length")[0].as_py()
        x = np.frombuffer(b"".join(t.column("packed").to_pylist()), dtype="<f8").reshape(-1, length)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        for i in range(0, len(left), TILE):
            for j in range(0, len(right), TILE):
                a, b = np.nonzero(x[left[i : i + TILE]] @ x[right[j : j + TILE]].T >= cosine)
                a, b = left[i : i + TILE][a], right[j : j + TILE][b]
                member = home[a] == cell
                keep = ~(member & (rep[a] == rep[b]))
                a, b, member = a[keep], b[keep], member[keep]
                links += np.bincount(a, weights=weight[b], minlength=len(rep)).astype(np.int64)
                links += np.bincount(b[~member], weights=weight[a[~member]], minlength=len(rep)).astype(np.int64)
                while (root[a] != root[b]).any():
                    ra, rb = root[a], root[b]
                    low = np.minimum(ra, rb)
                    np.minimum.at(root, ra, low)
                    np.minimum.at(root, rb, low)
                    while (root[root] != root).any():
                        root = root[root]
        some = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, root, rep)
        return pa.table({"rep": pa.array(rep[some], pa.int64()), "links": pa.array(links[some], pa.int64()), "root": pa.array(least[root[some]], pa.int64())})

    return dealt.groupBy("length", "cell", "l", "r").applyInArrow(tidy_group(run), "rep long, links long, root long")


def near_vectors(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, block: int = BLOCK, label: str = "vectordup") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    work = Workspace(spark, label)
    packed = work.write(_packed(vectors, id, embedding), "packed")
    grouped = packed.where(F.col("packed").isNotNull()).groupBy("packed").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"))
    length = F.floor(F.octet_length("packed") / 8).cast("int").alias("length")
    classes = work.write(grouped.select(F.monotonically_increasing_id().alias("rep"), "low", "weight", length, "packed"), "classes")  # written once, so numbers stay
    centres: dict[int, np.ndarray] = {}
    for row in classes.groupBy("length").count().collect():
        picked = classes.where(F.col("length") == row["length"]).orderBy(F.xxhash64("packed"), "packed").limit(SAMPLE).select("packed").collect()
        sample = np.stack([np.frombuffer(r["packed"], dtype="<f8") for r in picked])
        centres[row["length"]] = fit_cells(sample, int(min(MOST_CELLS, max(4, row["count"] // CELL), max(1, len(sample) // 4))))
    found = work.write(_compare(_blocks(_assigned(classes, centres, cosine), block), cosine), "found")
    components = work.write(connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), work), "of")
    numbered = components.join(classes.select("rep", "low"), F.col("id") == F.col("rep"))
    named = components.join(numbered.groupBy("component").agg(F.min("low").alias("name")), "component").select("id", "name")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("packed", "rep", "low", "weight").join(links, "rep", "left").join(named, F.col("rep") == F.col("id"), "left")
    rows = packed.join(known, "packed", "left")
    out = rows.select("vec_id", F.coalesce(F.col("weight") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("name", "low", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_embedding_neardup(spark, sf_dir):
    """Contract query over all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
