"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Words are factored into classes: the ``OWN`` most frequent words are classes of their own, all others
fall into ``ORTHO`` classes by their first and last letters, and the end of a text is a class. The
probability of a word is that of its class after the two words before it, times (c + 0.1) / Z within a
class of many words, Z = the sum of (c + 0.1) over its training words and one unseen word.

The class model is log-bilinear: a prediction r = C1 R[w-1] + C2 R[w-2] from vectors of the two context
classes, scored by r . Q[class] + b[class]. It is trained in numpy by noise-contrastive estimation with
the class frequencies as noise, on the counts of all (context, context, class) triples of all training
texts. Batched matrix products give its scores and exact normalisers for all pairs of contexts at once.
A step draws ``BATCH`` triples in proportion to their counts; there are ``STEPS`` steps up to ``UNIT``
training tokens, and beyond that as many more as the cube root of the tokens. The model's own size (classes
and contexts) is fixed: what grows with the corpus are the counts of words and triples and the steps.

Learning texts: crc32(id as text) mod 10 is not 0. Cases: null text counts as empty (its end alone is
scored); null ids count as the empty text for the split; repeated rows are scored alike (each is
counted in training); without learning texts all counts are 0 and the class model is uniform.

Scale: word counts are summed in tasks and shuffled by word. The ``HEAD`` most frequent words and the
triple counts (bounded by the numbers of classes) go to the driver and to tasks; all other words of a
text are looked up by a join on the word, once a text and word. Three maps over the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.frames import id_crc
from corvane.llm.kernel import LOWER, mix, slices, text_buffer, tidy, word_hashes, word_spans
from corvane.runtime import Workspace, arrow_rows, ship_package, table

HEAD = 1 << 16
OWN = 160
ORTHO = 351
CLASSES = OWN + ORTHO + 1  # the last is the end of a text
END = CLASSES - 1
CONTEXT_OWN = 31
CONTEXTS = 64  # 0: nothing before, then frequent words, then last letters
FLUSH = 4_000_000
STEPS, BATCH = 1500, 2048
UNIT = 8_000_000  # training tokens that STEPS are for


def _letters(data, starts, ends):
    """Class by first and last letters, and context class by last letters, of every word."""
    last = ends - 1
    mark = (data[last] == 0x2E) | (data[last] == 0x2C)
    last = np.where(mark & (last > starts), last - 1, last)
    tail = LOWER[data[last]].astype(np.uint64) | (LOWER[data[np.maximum(last - 1, starts)]].astype(np.uint64) << np.uint64(8))
    both = tail | (LOWER[data[starts]].astype(np.uint64) << np.uint64(16))
    return OWN + (mix(both) % np.uint64(ORTHO)).astype(np.int64), 1 + CONTEXT_OWN + (mix(tail) % np.uint64(CONTEXTS - 1 - CONTEXT_OWN)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, cls, n) of all words of (id, text) rows; the row with a null h counts the texts."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = texts = 0

        def summed():
            h, cls, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.argsort(h)
            h, cls, n = h[order], cls[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(cls[first].astype(np.int32)), pa.array(np.add.reduceat(n, first))], names=["h", "cls", "n"])

        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            texts += batch.num_rows
            for first, last in slices(offsets):
                part = data[offsets[first] : offsets[last]]
                starts, ends, _ = word_spans(part, offsets[first : last + 1] - offsets[first])
                if len(starts):
                    h, at, n = np.unique(word_hashes(part, starts, ends), return_index=True, return_counts=True)
                    held.append((h, _letters(part, starts[at], ends[at])[0], n))
                    size += len(h)
                    if size > FLUSH:
                        yield summed()
                        held, size = [], 0
        if held:
            yield summed()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([END], pa.int32()), pa.array([texts], pa.int64())], names=["h", "cls", "n"])

    return docs.mapInArrow(tidy(run), "h long, cls int, n long").groupBy("h", "cls").agg(F.sum("n").alias("n"))


class _Vocabulary:
    """The most frequent words: hashes in order, counts, and their own classes (-1: none)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, own: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.own = hashes[order], counts[order], own[order]

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places of words, -1 for all others."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == words, at, -1)


def _tokens(data, offsets, vocabulary: _Vocabulary):
    """All tokens of a slice of texts, ends included: text, word (or 0), place in the vocabulary, class, and the contexts before."""
    starts, ends, bounds = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    place = vocabulary.find(words)
    cls, ctx = _letters(data, starts, ends)
    own = np.where(place >= 0, vocabulary.own[place] if len(vocabulary.own) else -1, -1)
    cls = np.where(own >= 0, own, cls)
    ctx = np.where((own >= 0) & (own < CONTEXT_OWN), own + 1, ctx)
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    at = bounds[1:]
    owner, words, place, cls, ctx = (np.insert(x, at, y) for x, y in ((owner, np.arange(n)), (words, np.uint64(0)), (place, -1), (cls, END), (ctx, 0)))
    one, two = np.zeros(len(ctx), np.int64), np.zeros(len(ctx), np.int64)
    one[1:], two[2:] = ctx[:-1], ctx[:-2]
    first = bounds[:-1] + np.arange(n)
    one[first] = 0
    two[first] = 0
    second = first + 1
    two[second[second < len(two)]] = 0  # an end's context is 0, so no text sees the one before
    return owner, words, place, cls, one, two


def triple_counts(docs: DataFrame, vocabulary: _Vocabulary) -> DataFrame:
    """(code, n): how often a class follows two contexts; code = (context before the last, last context, class)."""

    def run(batches):
        total = np.zeros(CONTEXTS * CONTEXTS * CLASSES, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in slices(offsets):
                _, _, _, cls, one, two = _tokens(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], vocabulary)
                total += np.bincount((two * CONTEXTS + one) * CLASSES + cls, minlength=len(total))
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], names=["code", "n"])

    return docs.mapInArrow(tidy(run), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def training_steps(tokens: int) -> int:
    return round(STEPS * max(1.0, tokens / UNIT) ** (1 / 3))


class LogBilinear:
    """The class model."""

    def __init__(self, size: int = 32, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.context = rng.normal(0, 0.1, (CONTEXTS, size))
        self.first, self.second = np.eye(size), np.eye(size) * 0.5
        self.target = rng.normal(0, 0.1, (CLASSES, size))
        self.bias = np.full(CLASSES, -np.log(CLASSES))

    def train(self, code: np.ndarray, n: np.ndarray, steps: int = STEPS, batch: int = BATCH, noise: int = 100, rate: float = 0.03, seed: int = 6) -> None:
        """Noise-contrastive estimation; every step draws triples in proportion to their counts (Adam updates)."""
        if not len(code):
            return
        rng = np.random.Generator(np.random.PCG64(seed))
        two, one, cls = code // CLASSES // CONTEXTS, code // CLASSES % CONTEXTS, code % CLASSES
        share = np.bincount(cls, weights=n, minlength=CLASSES) + 0.5
        share /= share.sum()
        self.bias = np.log(share)
        log_noise = np.log(noise * share)
        upto, cumulative = np.cumsum(n), np.cumsum(share)
        names = ("context", "first", "second", "target", "bias")
        moments = {k: (np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))) for k in names}
        for step in range(1, steps + 1):
            pick = np.searchsorted(upto, rng.integers(0, upto[-1], batch), side="right")
            a, b = one[pick], two[pick]
            fakes = np.minimum(np.searchsorted(cumulative, rng.random((1, noise))), CLASSES - 1)
            w = np.concatenate([cls[pick][:, None], np.repeat(fakes, batch, axis=0)], axis=1)
            ra, rb = self.context[a], self.context[b]
            r = ra @ self.first + rb @ self.second
            shared = self.target[fakes[0]]
            score = np.concatenate([np.einsum("ij,ij->i", r, self.target[cls[pick]])[:, None], r @ shared.T], axis=1) + self.bias[w] - log_noise[w]
            error = -1 / (1 + np.exp(-np.clip(score, -30, 30)))
            error[:, 0] += 1  # of the log-likelihood, upwards
            error /= batch
            grad = {k: np.zeros_like(getattr(self, k)) for k in names}
            grad["bias"] = np.bincount(w.ravel(), weights=error.ravel(), minlength=CLASSES)
            grad["target"] += _scatter(cls[pick], error[:, :1] * r, CLASSES) + _scatter(fakes[0], error[:, 1:].T @ r, CLASSES)
            gr = error[:, :1] * self.target[cls[pick]] + error[:, 1:] @ shared
            grad["first"], grad["second"] = ra.T @ gr, rb.T @ gr
            grad["context"] = _scatter(a, gr @ self.first.T, CONTEXTS) + _scatter(b, gr @ self.second.T, CONTEXTS)
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in names:
                m, v = moments[k]
                m += 0.1 * (grad[k] - m)
                v += 0.01 * (grad[k] ** 2 - v)
                setattr(self, k, getattr(self, k) + now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by last context and class, by the one before and class, and normalisers by both: log10 P = a + b - z."""
        a = (self.context @ self.first) @ self.target.T + self.bias
        b = (self.context @ self.second) @ self.target.T
        whole = b[:, None, :] + a[None, :, :]
        top = whole.max(axis=2, keepdims=True)
        z = np.log(np.exp(whole - top).sum(axis=2)) + top[:, :, 0]
        return a / np.log(10), b / np.log(10), z / np.log(10)


def _scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((size, values.shape[1]))
    np.add.at(out, rows, values)
    return out


def _scored(docs: DataFrame, vocabulary: _Vocabulary, model: LogBilinear, log_z: np.ndarray, log_base: float) -> DataFrame:
    """Rows of texts (h null) with sums over frequent words, and rows (row, h, times) of all other words."""
    a, b, z = model.tables()
    log_head = np.log10(vocabulary.counts + 0.1) if len(vocabulary.counts) else np.zeros(1)

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for first, last in slices(offsets):
                n = last - first
                owner, words, place, cls, one, two = _tokens(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], vocabulary)
                head, end = place >= 0, cls == END
                log_c = np.where(head, log_head[place], 0.0)
                log_c[end] = log_z[END]  # (c + 0.1) of ends
                many = (cls >= OWN) & ~end
                in_class = np.where(many, log_c - log_z[cls], 0.0)
                tokens = np.bincount(owner, minlength=n)
                base = np.bincount(owner, weights=log_c, minlength=n) - tokens * log_base
                score = np.bincount(owner, weights=a[one, cls] + b[two, cls] - z[two, one] + in_class, minlength=n)
                known = np.bincount(owner, weights=head, minlength=n).astype(np.int64)
                rest = np.flatnonzero(~head & ~end)
                order = rest[np.lexsort((words[rest], owner[rest]))]
                new = np.flatnonzero(np.concatenate([[True], (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])])) if len(order) else order
                m = len(new)
                nothing = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["text"] * n + ["word"] * m),
                        pa.array(np.concatenate([row + np.arange(n), row + owner[order][new]])),
                        pa.concat_arrays([batch.column(0).slice(first, n), pa.nulls(m, pa.int64())]),
                        pa.concat_arrays([batch.column(2).slice(first, n), pa.nulls(m, pa.bool_())]),
                        pa.concat_arrays([nothing, pa.array(words[order][new].view(np.int64))]),
                        pa.array(np.concatenate([tokens, np.diff(np.append(new, len(order)))])),
                        pa.array(np.concatenate([known, np.zeros(m, np.int64)])),
                        pa.array(np.concatenate([base, np.zeros(m)])),
                        pa.array(np.concatenate([score, np.zeros(m)])),
                    ],
                    names=["kind", "row", "doc_id", "held_out", "h", "n", "known", "base", "score"],
                )
                row += n

    return docs.mapInArrow(tidy(run), "kind string, row long, doc_id long, held_out boolean, h long, n long, known long, base double, score double")


def score_texts(docs: DataFrame, text: str = "text", id: str = "doc_id", folds: int = 10, label: str = "lmscore") -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    work = Workspace(spark, label)
    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"), (id_crc(id) % folds == 0).alias("held_out"))
    learning = picked.where(~F.col("held_out"))
    counts = work.write(word_counts(learning), "counts")
    head = counts.where(F.col("h").isNotNull()).orderBy(F.desc("n"), "h").limit(HEAD).toArrow()
    hashes, n = head.column("h").to_numpy().view(np.uint64), head.column("n").to_numpy()
    order = np.lexsort((hashes, -n))[:OWN]
    own = np.full(len(hashes), -1)
    own[order] = np.arange(len(order))
    vocabulary = _Vocabulary(hashes, n, own)
    by_class = {r["cls"]: (r["n"], r["v"]) for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    total = sum(x for x, _ in by_class.values())
    distinct = sum(v for c, (_, v) in by_class.items() if c != END) + (by_class.get(END, (0, 0))[0] > 0)
    mass = np.full(CLASSES, 0.1)  # one unseen word in each class
    for c, (x, v) in by_class.items():
        mass[c] += x + 0.1 * v if c != END else x
    classes_of_own = head.column("cls").to_numpy()[order]
    np.subtract.at(mass, classes_of_own, n[order] + 0.1)
    triples = triple_counts(learning, vocabulary).toArrow()
    model = LogBilinear()
    by_code = np.argsort(triples.column("code").to_numpy())
    model.train(triples.column("code").to_numpy()[by_code].astype(np.int64), triples.column("n").to_numpy()[by_code], training_steps(total))
    scored = _scored(picked, vocabulary, model, np.log10(mass), float(np.log10(total + 0.1 * (distinct + 1))))
    scored.write.mode("overwrite").partitionBy("kind").option("compression", "zstd").parquet(work.path("scored"))
    rows = work.read("scored", "row long, doc_id long, held_out boolean, h long, n long, known long, base double, score double, kind string")
    texts = rows.where("kind = 'text'")
    words = rows.where("kind = 'word'").select("row", "h", "n").join(counts.select("h", F.col("n").alias("c")), "h", "left")
    c = F.coalesce("c", F.lit(0))
    sums = words.groupBy("row").agg(F.sum(F.col("n") * F.log10(c + 0.1)).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("found"))
    ends_known = F.lit(1 if by_class.get(END, (0, 0))[0] > 0 else 0)
    more = F.coalesce("more", F.lit(0.0))
    return texts.join(sums, "row", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("found", F.lit(0)) + ends_known).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score")
    )


def op5_lm_score(spark, sf_dir):
    """Contract query over all documents."""
    return score_texts(table(spark, sf_dir, "documents"))
