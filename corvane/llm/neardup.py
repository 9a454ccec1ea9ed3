"""MinHash near-duplicates with tensored banding.

A document is the set of its five-word shingles. Two small hash collections U and V have ``GROUPS``
groups of ``ROWS`` minhash values each; the key of table (i, j) combines group i of U with group j of V.
``GROUPS`` squared tables of 2 * ``ROWS`` values each so cost 2 * GROUPS * ROWS minhashes (48 instead of
576 for 144 tables). A pair with similarity s is found unless no group of U or none of V agrees: at s =
0.75 that is 2 * (1 - s**2)**12 or 1e-4, at 0.8 9e-6, at 0.9 4e-9.

Steps: documents with equal sets become one class first. Only groups that two classes share go into
tables. Each bucket links its members to its hub, the one that meets most others over all tables (a
star, never all pairs); a sketch drops hopeless pairs; the rest is confirmed on full sets, read again
from the texts. Buckets that then still hold several components are compared once more, in blocks of
sketches, for links between different components only, each pair in its first common table. So a link
is lost only where no table or a sketch far below its similarity (5 standard errors) loses it; members
and candidates have no cap. A sketch is the smallest hash in each of ``BINS`` bins, one byte each.

Cases: null or empty text, or no words: empty set, linked with nothing; fewer than five words: the whole
sequence is one shingle; repeated rows and equal ids collapse in the class of their set (a repeated id
is reported once per row); null ids are left out of links and are their own component (null). Shingles
are 52-bit hashes: two different ones of a document coincide with a chance of 1e-7 for 20,000 words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.llm.kernel import mix, shingle_hashes, slices, text_buffer, tidy, tidy_group, word_hashes, word_spans
from corvane.runtime import Workspace, arrow_rows, ship_package, table

WIDTH = 5
PERCENT = 75
GROUPS = 12
ROWS = 2
HASHES = 2 * GROUPS * ROWS
BINS = 512
ERRORS = 5.0  # standard errors below the similarity asked for at which a sketch drops a pair
BLOCK = 512
DEALT = 2048  # members of a bucket that are compared in one group, at most about twice
SMALL = 1_000_000  # rows of four numbers that may be broadcast

_seeds = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASH_BITS = np.uint64((1 << 52) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 52-bit shingle hashes, ascending within each text, and the bounds of the texts."""
    starts, ends, bounds = word_spans(data, offsets)
    h, owner = shingle_hashes(word_hashes(data, starts, ends), bounds, width)
    keys = np.sort((owner.astype(np.uint64) << np.uint64(52)) | (h >> np.uint64(12)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    at = np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(52))
    return keys & _HASH_BITS, at


def minhashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES minhash values (32 bits) of every non-empty set: rows of int32; zeros for empty sets."""
    out = np.zeros((len(bounds) - 1, HASHES), dtype=np.int32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k in range(HASHES):
            h = (values + _seeds[k]) * (_seeds[k] ^ np.uint64(0x9E3779B97F4A7C14))
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[full, k] = np.minimum.reduceat(h >> np.uint64(32), bounds[:-1][full]).astype(np.uint32).view(np.int32)
    return out


def sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """BINS bytes for every set: of the smallest hash in each bin, 0 for an empty bin."""
    n = len(bounds) - 1
    h = mix(values * np.uint64(0x9E3779B97F4A7C15))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    least = np.full(n * BINS, 0xFFFFFFFF, dtype=np.uint32)
    np.minimum.at(least, owner * BINS + (h >> np.uint64(55)).astype(np.int64), (h & np.uint64(0x7FFFFFFF)).astype(np.uint32))
    return np.where(least == 0xFFFFFFFF, 0, least % 255 + 1).astype(np.uint8).reshape(n, BINS)


def hopeful(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether pairs of sketches (rows) of sets with na and nb members allow the similarity asked for.

    The bins in use are a sample, without replacement, of the union of a pair.
    """
    used = ((a | b) > 0).sum(axis=1)
    agree = ((a == b) & (a > 0)).sum(axis=1)
    s = PERCENT / 100
    left_out = np.maximum(1 - used * (1 + s) / (na + nb), 0)
    return agree >= used * s - ERRORS * np.sqrt(used * s * (1 - s) * left_out) - 1


def signatures(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, set_key binary, sig array<int>, sketch binary); set_key is null for an empty set."""
    ship_package(docs.sparkSession)
    arrow_rows(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in slices(offsets):
                values, at = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
                raw, sig = values.astype("<u8").tobytes(), minhashes(values, at)
                keys = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, HASHES, dtype=np.int32)), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(np.diff(at), pa.int64()), pa.array(keys, pa.binary()), rows, pa.array([x.tobytes() for x in sketches(values, at)], pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig", "sketch"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, n_shingles long, set_key binary, sig array<int>, sketch binary")


def tables(classes: DataFrame) -> DataFrame:
    """(key, table, rep): entries of the tensored tables, for groups of U and V that at least two classes share."""
    group = [F.xxhash64(F.lit(g), *[F.col("sig")[g * ROWS + r] for r in range(ROWS)]) for g in range(2 * GROUPS)]
    each = classes.select("rep", F.posexplode(F.array(*group)).alias("g", "h"))
    shared = each.groupBy("h").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low != high").select("h")
    group = F.struct("g", "h")
    kept = each.join(shared, "h").groupBy("rep").agg(F.collect_list(F.when(F.col("g") < GROUPS, group)).alias("u"), F.collect_list(F.when(F.col("g") >= GROUPS, group)).alias("v"))
    half = kept.where((F.size("u") > 0) & (F.size("v") > 0)).select("rep", F.explode("u").alias("x"), "v")
    both = half.select("rep", "x", F.explode("v").alias("y"))
    return both.select(F.xxhash64("x.h", "y.h").alias("key"), (F.col("x.g") * GROUPS + F.col("y.g") - GROUPS).cast("int").alias("table"), "rep")


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and sketches allow the similarity asked for."""
    side = classes.select("rep", "n_shingles", "sketch")
    joined = pairs.join(side.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa")), "a").join(side.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb")), "b")
    sized = joined.where((F.col("na") * 100 >= F.col("nb") * PERCENT) & (F.col("nb") * 100 >= F.col("na") * PERCENT)).select("a", "b", "sa", "sb", "na", "nb")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(hopeful(x, y, batch.column(4).to_numpy(), batch.column(5).to_numpy())))

    return sized.mapInArrow(tidy(run), "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, work: Workspace, name: str, text: str = "text", id: str = "doc_id", width: int = WIDTH, spread: int = 64) -> DataFrame:
    """The pairs (a, b) that reach the similarity on full sets, computed from the texts.

    Each centre a comes once for every salt of its members and its members follow it in one sorted
    stream, so a centre with very many members is many streams and none is held in memory.
    """
    spark = docs.sparkSession
    ship_package(spark)
    members = pairs.select("a", F.col("b").alias("need"), F.pmod(F.xxhash64("b"), F.lit(spread)).alias("salt"))
    few = members.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    members = members.join(few, "a").select("a", F.pmod("salt", F.ceil(F.col("n") / spread)).alias("salt"), "need")
    needs = members.withColumn("member", F.lit(1)).unionByName(members.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("need"), F.lit(0).alias("member")))
    needs = work.write(needs, f"{name}-needs")
    if needs.count() <= SMALL:  # else texts and needs are shuffled by id
        needs = F.broadcast(needs)
    texts = docs.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("need"), F.col(text).alias("text"))
    rows = needs.join(texts, "need").repartition("a", "salt").sortWithinPartitions("a", "salt", "member").select("a", "need", "member", "text")

    def run(batches):
        centre, centre_set = None, None
        for batch in batches:
            a, need, member = (batch.column(i).to_numpy() for i in range(3))
            data, offsets = text_buffer(batch.column(3))
            found: list[tuple[int, int]] = []
            for first, last in slices(offsets):
                values, at = shingle_sets(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
                for i in range(first, last):
                    own = values[at[i - first] : at[i - first + 1]]
                    if not member[i]:
                        centre, centre_set = a[i], own.copy()
                    elif centre == a[i]:
                        both = np.sort(np.concatenate([centre_set, own]))
                        common = int((both[1:] == both[:-1]).sum())
                        if 100 * common >= PERCENT * (len(both) - common) and common:
                            found.append((int(a[i]), int(need[i])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long").distinct()


def _cross_pairs(mixed: DataFrame) -> DataFrame:
    """Hopeful pairs of different components within a bucket: (key, table, n, rep, label, n_shingles, sig, sketch) -> (a, b).

    n: members of the bucket. A bucket is dealt to blocks of about ``DEALT`` members, and every pair of
    blocks is a group of its own, so a bucket of any size is many bounded tasks.
    """
    blocks = F.ceil(F.col("n") / DEALT).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    sides = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("l"), F.greatest(own, o).alias("r"), own.alias("own")))
    dealt = mixed.withColumn("b", F.explode(sides)).select("key", "b.l", "b.r", "b.own", "table", "rep", "label", "n_shingles", "sig", "sketch")

    def run(t: pa.Table) -> pa.Table:
        rep, label, n, at, own = (t.column(c).to_numpy() for c in ("rep", "label", "n_shingles", "table", "own"))
        sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, 2 * GROUPS, ROWS)
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        u, v = divmod(int(at[0]), GROUPS)
        one = t.column("l")[0].as_py() == t.column("r")[0].as_py()
        left = np.flatnonzero(own == t.column("l")[0].as_py())
        right = left if one else np.flatnonzero(own == t.column("r")[0].as_py())
        a, b = [], []
        for first in range(0, len(left), BLOCK):
            rows = left[first : first + BLOCK]
            for second in range(first if one else 0, len(right), BLOCK):
                cols = right[second : second + BLOCK]
                ok = label[rows, None] != label[None, cols]
                if one and second == first:
                    ok = np.triu(ok, 1)
                ok &= (n[rows, None] * 100 >= n[None, cols] * PERCENT) & (n[None, cols] * 100 >= n[rows, None] * PERCENT)
                x, y = np.nonzero(ok)
                for start in range(0, len(x), 32768):
                    i, j = rows[x[start : start + 32768]], cols[y[start : start + 32768]]
                    same = (sig[i] == sig[j]).all(axis=2)
                    here = (same[:, :GROUPS].argmax(axis=1) == u) & (same[:, GROUPS:].argmax(axis=1) == v)  # else it meets in an earlier table
                    i, j = i[here], j[here]
                    keep = hopeful(sketch[i], sketch[j], n[i], n[j])
                    a.append(rep[i[keep]])
                    b.append(rep[j[keep]])
        a, b = np.concatenate([*a, np.zeros(0, np.int64)]), np.concatenate([*b, np.zeros(0, np.int64)])
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("key", "l", "r").applyInArrow(tidy_group(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", label: str = "neardup") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept. Other columns of docs play no part."""
    spark = docs.sparkSession
    work = Workspace(spark, label)
    sig = work.write(signatures(docs, text, id), "signatures")
    named = sig.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    firsts = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    low = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "sketch")).alias("x"))
    classes = work.write(low.select(F.col("x.doc_id").alias("rep"), "x.n_shingles", "x.sig", "x.sketch"), "classes")
    entries = work.write(tables(classes), "entries")
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = work.write(entries.join(several, "key").select("key", "table", "rep", "n"), "met")
    work.drop("entries")
    degree = met.groupBy("rep").agg(F.sum("n").alias("degree"))
    hub = met.join(degree, "rep").groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("less"))).alias("x")).select("key", (-F.col("x.less")).alias("hub"))
    pairs = met.join(hub, "key").where("hub != rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    first = work.write(confirm(work.write(_close(pairs, classes), "pairs"), docs, work, "first", text, id), "links")
    labels = work.write(connected_components(first, work, "early"), "labels")
    labelled = met.join(labels, F.col("rep") == F.col("id"), "left").where("n > 2").select("key", "table", "n", "rep", F.coalesce("component", "rep").alias("label"))  # a pair has met its hub
    mixed_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("key")
    mixed = labelled.join(mixed_keys, "key").join(classes, "rep").select("key", "table", "n", "rep", "label", "n_shingles", "sig", "sketch")
    tried = work.read("pairs").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = work.write(_cross_pairs(mixed).join(tried, ["a", "b"], "left_anti"), "cross")
    work.drop("met")
    links = first
    if not cross.isEmpty():
        links = first.unionByName(work.write(confirm(cross, docs, work, "more", text, id), "more-links"))
    final = connected_components(links, work, "final")
    of_set = firsts.join(final, F.col("rep") == F.col("id"), "left").select("set_key", F.coalesce("component", "rep").alias("found"))
    whole = sig.join(of_set, "set_key", "left").withColumn("component_id", F.coalesce("found", "doc_id"))
    return whole.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op3_minhash_neardup(spark, sf_dir):
    """Contract query over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
