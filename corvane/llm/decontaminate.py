"""Benchmark decontamination by latent semantic retrieval.

Every document is cut into blocks of ``BLOCK`` words; a passage is two blocks that follow each other, so
that any span of up to ``BLOCK`` words lies whole in a passage. Case and ASCII punctuation are ignored.
Terms are the words of the benchmark.

1. Document frequencies of the terms over all blocks of all documents.
2. Distributed randomised SVD: for the TF-IDF matrix A of all blocks (rows of unit length, and the
   benchmark items with ``QUERY_MASS`` of the whole mass, so that the latent space can tell items apart)
   tasks add up A'(A G) for a fixed Gaussian G; an orthonormal basis of it spans the latent space.
3. Candidates are passages and items that share words of at least ``LOOSE`` of the item's weight by
   inverse document frequency, which no match can do without, and either ``PARAPHRASE`` of it or a
   cosine of ``COSINE`` in the latent space. An inverted index over the rarest words of every item, all
   but ``REST`` of its weight, bounds the shared weight from above (the rest counts as shared), so that
   no passage is missed, whatever else it holds; cosines are computed for those that remain.
4. Candidates are checked with a longest common subsequence of words, weighted the same way. From
   ``NEAR`` of the item's weight it is a copy; from ``PARAPHRASE`` it is one if the answer (the
   benchmark's answer column, else the last quarter of the piece, below) is in the passage too; from
   ``LOOSE`` it is a paraphrase if the answer is there and the cosine is reached.

Items of over ``BLOCK`` words are searched in pieces of ``BLOCK`` words, of which the last one ends with
the item (and overlaps the one before); an item is found where any piece is.

Cases: null or empty texts and items match nothing; repeated rows are found alike; null ids keep their
rows; an empty benchmark finds nothing. Other columns play no part.

Scale: three maps over the texts; only term counts, the V x k sums of the SVD (V: words of a block of
``ITEMS`` benchmark items) and the matches leave the tasks. The sums are made by at most ``SUMMING`` tasks
(each of which reads more as the data grow) and added up as streams of ``ROWS`` terms each, so no task
holds more than its own. Items beyond ``ITEMS`` are handled in further rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.kernel import IS_PUNCTUATION, slices, text_buffer, tidy, word_hashes, word_spans
from corvane.runtime import arrow_rows, ship_package, table

BLOCK = 64
RANK = 96
QUERY_MASS = 0.5
NEAR = 0.65
PARAPHRASE = 0.55
LOOSE = 0.40
COSINE = 0.75
ANSWER = 0.75
REST = 0.10  # of an item's weight: its most common words, which the index leaves out; decides the cost, not the result
COMMON = 0.05  # terms in more blocks than this share carry no weight in the latent space
ITEMS = 4096
_TABLE = 1 << 18
SUMMING = 8192
ROWS = 64
_CELLS = 1 << 20  # (block, item) sums, and postings, held at a time


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(pc.utf8_lower(pa.scalar(text)).as_py().encode(), dtype=np.uint8)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), IS_PUNCTUATION)
    return word_hashes(raw, starts, ends)


class _Terms:
    """Looks up the sorted term hashes; a bit table turns most other words away."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.bits = np.zeros(_TABLE, bool)
        self.bits[(terms & np.uint64(_TABLE - 1)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in words that hold terms, and the terms."""
        at = np.flatnonzero(self.bits[(words & np.uint64(_TABLE - 1)).astype(np.int64)])
        index = np.searchsorted(self.terms, words[at])
        index[index == len(self.terms)] = 0
        ok = self.terms[index] == words[at]
        return at[ok], index[ok]


def _blocked(data, offsets, first, last, terms: _Terms):
    """Words of a slice of texts, their bounds, the first block of each text, and (block, term) of all terms."""
    lo = offsets[first]
    part = data[lo : offsets[last]]
    starts, ends, bounds = word_spans(part, offsets[first : last + 1] - lo, IS_PUNCTUATION)
    words = word_hashes(part, starts, ends)
    blocks = -(-np.diff(bounds) // BLOCK)
    base = np.concatenate([[0], np.cumsum(blocks)])
    at, term = terms.find(words)
    owner = np.searchsorted(bounds, at, side="right") - 1
    return words, bounds, base, base[owner] + (at - bounds[owner]) // BLOCK, term


def _sparse(block, term, size):
    """Distinct (block, term) in order, with their counts."""
    keys, counts = np.unique(block * size + term, return_counts=True)
    return keys // size, keys % size, counts


def _rows(block, term, counts, weight):
    """TF-IDF entries with rows of unit length, and where rows start."""
    value = counts * weight[term]
    start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    norm = np.sqrt(np.add.reduceat(value * value, start))
    return value / np.repeat(np.maximum(norm, 1e-12), np.diff(np.append(start, len(block)))), start


def _map(docs: DataFrame, make, schema: str) -> DataFrame:
    ship_package(docs.sparkSession)
    arrow_rows(docs.sparkSession)
    return docs.mapInArrow(tidy(make), schema)


def _frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    def run(batches):
        look, df, total = _Terms(terms), np.zeros(len(terms), np.int64), 0
        for batch in batches:
            data, offsets = text_buffer(pc.utf8_lower(batch.column(1)))
            for first, last in slices(offsets):
                _, _, base, block, term = _blocked(data, offsets, first, last, look)
                total += int(base[-1])
                df += np.bincount(_sparse(block, term, len(terms))[1], minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.flatnonzero(df), -1)), pa.array(np.append(df[df > 0], total))], names=["term", "n"])

    found = _map(docs, run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(terms), np.int64)
    for row in found:
        if row["term"] >= 0:
            df[row["term"]] = row["n"]
    return df, next((row["n"] for row in found if row["term"] < 0), 0)


def _latent(docs: DataFrame, terms: np.ndarray, weight: np.ndarray, items: list[np.ndarray], total: int, rank: int) -> np.ndarray:
    """Orthonormal basis (V x k) of the latent space."""
    v = len(terms)
    k = max(1, min(rank, v))
    gauss = np.random.Generator(np.random.PCG64(11)).standard_normal((v, k)).astype(np.float32)
    used = np.flatnonzero(weight > 0)

    def run(batches):
        look, z = _Terms(terms[used]), np.zeros((v, k), np.float32)
        for batch in batches:
            data, offsets = text_buffer(pc.utf8_lower(batch.column(1)))
            for first, last in slices(offsets):
                _, _, _, block, term = _blocked(data, offsets, first, last, look)
                if len(block):
                    block, term, counts = _sparse(block, used[term], v)
                    _add(z, gauss, block, term, *_rows(block, term, counts, weight))
        yield _pieces({p: piece for p in range(0, v, ROWS) if (piece := z[p : p + ROWS]).any()})

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                piece = np.frombuffer(raw.as_buffer(), np.float32)
                held[p] = held[p] + piece if p in held else piece.astype(np.float64)
        yield _pieces({p: x.astype(np.float32) for p, x in held.items()})

    few = docs.coalesce(SUMMING)  # no effect on fewer partitions
    summed = _map(_map(few, run, "part long, z binary").repartition("part"), add, "part long, z binary").toArrow()
    z = np.zeros((v, k))
    for p, raw in zip(summed.column("part").to_pylist(), summed.column("z").to_pylist()):
        z[p : p + ROWS] = np.frombuffer(raw, np.float32).reshape(-1, k)
    own = np.zeros((v, k), np.float32)
    for item in items:
        _, term, counts = _sparse(np.zeros(len(item), np.int64), item, v)
        value, start = _rows(np.zeros(len(term), np.int64), term, counts, weight)
        _add(own, gauss, np.zeros(len(term), np.int64), term, value, start)
    z = z * (1 - QUERY_MASS) / max(total, 1) + own * QUERY_MASS / max(len(items), 1)
    return np.linalg.svd(z, full_matrices=False)[0].astype(np.float32)


def _pieces(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["part", "z"])


def _add(z, gauss, block, term, value, start):
    """z += A'(A gauss) for the rows given."""
    value = value.astype(np.float32)
    y = np.add.reduceat(gauss[term] * value[:, None], start, axis=0)
    row = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(block))))
    order = np.argsort(term, kind="stable")
    term, row, value = term[order], row[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    z[term[first]] += np.add.reduceat(y[row] * value[:, None], first, axis=0)


class _Index:
    """Postings of the rarest words of every item: (word, item, share of the item's weight)."""

    def __init__(self, items: list[np.ndarray], idf: np.ndarray):
        piece, term, share, need = [], [], [], []
        for q, item in enumerate(items):
            own, counts = np.unique(item, return_counts=True)
            order = np.argsort(-idf[own], kind="stable")
            part = (counts * idf[own])[order]
            part /= part.sum()
            rest = 1 - np.cumsum(part)
            kept = int(np.argmax(rest <= REST)) + 1
            piece.append(np.full(kept, q))
            term.append(own[order[:kept]])
            share.append(part[:kept])
            need.append(LOOSE - max(rest[kept - 1], 0.0) - 1e-9)
        term, order = np.concatenate(term), np.argsort(np.concatenate(term), kind="stable")
        self.terms, self.count = np.unique(term, return_counts=True)
        self.start = np.cumsum(self.count) - self.count
        self.piece, self.share, self.need = np.concatenate(piece)[order], np.concatenate(share)[order], np.array(need)

    def near(self, block: np.ndarray, term: np.ndarray, rows: np.ndarray, joined: np.ndarray):
        """(index into rows, item) of all passages that may share enough with an item.

        block, term: distinct, by block, terms as places in self.terms. rows: first blocks of passages,
        ascending; joined: whether the next block belongs to it as well.
        """
        q = len(self.need)
        step = max(2, _CELLS // q)
        upto = np.concatenate([[0], np.cumsum(self.count[term])])
        first = 0
        while first < len(rows):
            low = rows[first]
            a = np.searchsorted(block, low)
            most = np.searchsorted(upto, upto[a] + _CELLS, side="right") - 1  # whole blocks of postings up to here
            high = min(low + step, int(block[most]) if most < len(block) else low + step)
            high = max(high, low + 2)
            last = int(np.searchsorted(rows, high - 1))  # passages whose second block lies below high
            last = max(last, first + 1)
            b = np.searchsorted(block, high)
            size = self.count[term[a:b]]
            at = np.repeat(self.start[term[a:b]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            sums = np.bincount((np.repeat(block[a:b], size) - low) * q + self.piece[at], weights=self.share[at], minlength=(high - low) * q).reshape(-1, q)
            own = rows[first:last] - low
            shared = sums[own]
            shared[joined[first:last]] += sums[own[joined[first:last]] + 1]
            r, p = np.nonzero(shared >= self.need)
            yield from zip((r + first).tolist(), p.tolist())
            first = last


def weighted_lcs(item: np.ndarray, weight: np.ndarray, passage: np.ndarray) -> float:
    """Weight of the heaviest common subsequence of two word sequences."""
    best = np.zeros(len(passage) + 1)
    for word, w in zip(item, weight):
        hit = passage == word
        if hit.any():
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(hit, best[:-1] + w, 0)))
    return float(best[-1])


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", item: str = "item_id", rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, overlap, answer_overlap): the documents that hold benchmark items.

    benchmark: item ids and texts under the names item and "text", and maybe "answer".
    """
    spark = docs.sparkSession
    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    answers = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    listed = benchmark.where(F.col("text").isNotNull()).select(F.col(item).cast("long").alias("item_id"), "text", answers.alias("answer")).orderBy("item_id")
    found, known, block = None, 0, []
    for row in listed.toLocalIterator():
        block.append(row)
        if len(block) == ITEMS:
            part = _search(picked, block, rank)
            found, block = part if found is None else found.unionByName(part), []
    if block or found is None:
        part = _search(picked, block, rank) if block else spark.createDataFrame([], "doc_id long, item_id long, cosine double, overlap double, answer_overlap double")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("overlap", "answer_overlap", "cosine")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.cosine", "x.overlap", "x.answer_overlap")


def _search(docs: DataFrame, items: list, rank: int) -> DataFrame:
    empty = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, overlap double, answer_overlap double")
    texts = [(r["item_id"], _words(r["text"]), _words(r["answer"]) if r["answer"] else None) for r in items]
    starts = lambda n: [*range(0, n - BLOCK, BLOCK), max(n - BLOCK, 0)] if n else []
    pieces = [(i, w[a : a + BLOCK], ans) for i, w, ans in texts for a in starts(len(w))]
    if not pieces:
        return empty
    terms = np.unique(np.concatenate([w for _, w, _ in pieces]))
    df, total = _frequencies(docs, terms)
    idf = np.log((total + 1) / (df + 1)) + 0.05
    weight = np.where(df <= max(1, COMMON * total), idf, 0.0)
    in_terms = [np.searchsorted(terms, w) for _, w, _ in pieces]
    rare = [t[weight[t] > 0] for t in in_terms]
    weight = weight if all(len(t) for t in rare) else idf  # an item of common words only needs them
    rare = [t[weight[t] > 0] for t in in_terms]
    basis = _latent(docs, terms, weight, rare, total, rank)
    latent = (basis * weight[:, None]).astype(np.float32)
    queries = np.stack([np.bincount(t, minlength=len(terms)).astype(np.float32) @ latent for t in rare])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
    checks = []
    for (i, w, answer), t in zip(pieces, in_terms):
        tail = w[-max(4, len(w) // 4) :] if answer is None else answer
        checks.append((i, w, idf[t], tail))
    index = _Index(in_terms, idf)
    smallest = float(idf.min())

    def run(batches):
        look = _Terms(terms[index.terms])
        for batch in batches:
            data, offsets = text_buffer(pc.utf8_lower(batch.column(1)))
            out: list[tuple] = []
            for first, last in slices(offsets):
                words, bounds, base, block, term = _blocked(data, offsets, first, last, look)
                if not len(block):
                    continue
                block, term, _ = _sparse(block, term, len(index.terms))
                owner = np.repeat(np.arange(last - first), np.diff(base))
                second = np.zeros(len(owner), bool)
                second[:-1] = owner[1:] == owner[:-1]
                alone = np.diff(base)[owner] == 1
                rows = np.flatnonzero(second | alone)
                for r, q in index.near(block, term, rows, second[rows]):
                    d = owner[rows[r]]
                    a = bounds[d] + (rows[r] - base[d]) * BLOCK
                    passage = words[a : min(a + 2 * BLOCK, bounds[d + 1])]
                    i, w, weights, answer = checks[q]
                    whole = float(weights.sum())
                    has = weights[np.isin(w, passage)].sum() / whole
                    if has < LOOSE:
                        continue
                    place = np.minimum(np.searchsorted(terms, passage), len(terms) - 1)
                    vector = latent[place[terms[place] == passage]].sum(axis=0)
                    cosine = float(vector @ queries[q] / max(np.linalg.norm(vector), 1e-9))
                    if has < PARAPHRASE and cosine < COSINE:
                        continue
                    share = weighted_lcs(w, weights, passage) / whole
                    if share < (PARAPHRASE if cosine < COSINE else LOOSE):
                        continue
                    said = weighted_lcs(answer, np.ones(len(answer)), passage) / max(1, len(answer))
                    if share >= NEAR or said >= ANSWER:
                        out.append((first + int(d), i, cosine, share, said))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([o[0] for o in out], pa.int64())), *(pa.array([o[c] for o in out], kind) for c, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.float64()), (4, pa.float64())))], names=["doc_id", "item_id", "cosine", "overlap", "answer_overlap"])

    assert smallest > 0
    return _map(docs, run, "doc_id long, item_id long, cosine double, overlap double, answer_overlap double")


def op7_decontaminate(spark, sf_dir):
    """Every document that holds benchmark items, with the items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
