"""Language identification by rank-order n-gram profiles (out-of-place distance).

A language's profile is its ``K`` most frequent letter n-grams (1 to 3 letters, words delimited by one
space) over all labelled training texts. A text is ranked in the same way over its whole length; its
distance to a profile is the sum over its ``K`` most frequent n-grams of the difference of ranks, ``K``
for one that the profile lacks. The nearest profile wins, the first in code-point order on ties.

Cases: null text, empty text or no letters: ``und`` with score 0. No labelled text at all: everything
is ``und``. Null ids are kept and count as the empty text for the split. Repeated rows are predicted
alike. Columns named like the results are replaced. Texts of over ``LONG`` bytes are counted in pieces,
with the same counts.

Scale: training sums n-gram counts in each task before one shuffle whose size depends on alphabets, not
on the corpus; the profiles (languages x K rows) are the only thing sent to executors; prediction is a
map without any shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.frames import append_columns, id_crc
from corvane.llm.kernel import slices, text_buffer, tidy
from corvane.runtime import arrow_rows, ship_package

K = 300
LONG = 4 << 20  # bytes of a text from which it is read in pieces
PIECE = 1 << 20
_POINTS = 0x110000
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Lower-case letter of every code point, 0 for what is no letter."""
    if "letters" not in _tables:
        table = np.zeros(_POINTS, dtype=np.uint32)
        for point in range(_POINTS):
            c = chr(point)
            if c.isalpha():
                low = c.lower()
                table[point] = ord(low) if len(low) == 1 else point
        _tables["letters"] = table
    return _tables["letters"]


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters as dense indexes with 0 for a gap between words, their texts, and the letters by index."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    bounds = before[offsets]
    letters = _letters()[points]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keep = letters != 0
    if len(keep):
        first = np.zeros(len(keep), dtype=bool)
        first[bounds[:-1][bounds[:-1] < len(keep)]] = True
        keep[1:] |= keep[:-1] & ~first[1:]  # one gap after each word, within its text
    letters, owner = letters[keep], owner[keep]
    present = np.zeros(_POINTS, dtype=bool)
    present[letters] = True
    present[0] = False
    alphabet = np.concatenate([[0], np.flatnonzero(present)]).astype(np.uint32)
    dense = np.zeros(_POINTS, dtype=np.int64)
    dense[alphabet] = np.arange(len(alphabet))
    return dense[letters], owner, alphabet


def _grams(symbols: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams (base ``size`` + 1, ``size`` for no letter) and their texts."""
    base, n = size + 1, len(symbols)
    codes, owners = [], []
    one = symbols > 0
    codes.append((symbols[one] * base + size) * base + size)
    owners.append(owner[one])
    if n > 1:
        two = owner[1:] == owner[:-1]
        codes.append(((symbols[:-1] * base + symbols[1:]) * base + size)[two])
        owners.append(owner[:-1][two])
    if n > 2:
        three = (owner[2:] == owner[:-2]) & one[1:-1]
        codes.append(((symbols[:-2] * base + symbols[1:-1]) * base + symbols[2:])[three])
        owners.append(owner[:-2][three])
    return np.concatenate(codes), np.concatenate(owners)


def _text_of(code: int, alphabet: np.ndarray) -> str:
    base = len(alphabet) + 1
    parts = [code // base // base, code // base % base, code % base]
    return "".join(chr(alphabet[p]) if p else " " for p in parts if p < len(alphabet))


def _code_of(gram: str, dense: dict[int, int], size: int) -> int | None:
    parts = [0 if c == " " else dense.get(ord(c), -1) for c in gram]
    if -1 in parts:
        return None
    a, b, c = (*parts, size, size)[:3]
    return (a * (size + 1) + b) * (size + 1) + c


def _pieces(data: np.ndarray):
    """A text in pieces of about PIECE bytes, each of which ends with an ASCII character that is no letter."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data):
            part = data[end : end + PIECE]
            gaps = np.flatnonzero((part < 0x80) & ~(((part | 0x20) >= 0x61) & ((part | 0x20) <= 0x7A)))
            if len(gaps):
                end += int(gaps[0]) + 1
                break
            end += PIECE
        yield data[at:end]
        at = end


def _long_counts(data: np.ndarray) -> dict[str, int]:
    """N-gram counts of one text, from its pieces.

    A piece after the first word begins after a gap: it is read behind a word of one letter, which is taken
    off again.
    """
    total: dict[str, int] = {}
    before = False
    for piece in _pieces(data):
        raw = np.concatenate([np.frombuffer(b"a ", np.uint8), piece]) if before else piece
        symbols, owner, alphabet = _symbols(raw, np.array([0, len(raw)]))
        if len(symbols):
            keys, counts = np.unique(_grams(symbols, owner, len(alphabet))[0], return_counts=True)
            for key, count in zip(keys.tolist(), counts.tolist()):
                gram = _text_of(key, alphabet)
                total[gram] = total.get(gram, 0) + count
            if before:
                total["a"] -= 1
                total["a "] -= 1
            before = True
    return {gram: n for gram, n in total.items() if n}


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): n-gram counts over all texts of each language; null languages are left out."""
    ship_package(docs.sparkSession)
    arrow_rows(docs.sparkSession)

    def run(batches):
        total: dict[tuple[str, str], int] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            data, offsets = text_buffer(batch.column(0))
            for first, last in slices(offsets):
                if offsets[first] == offsets[last]:
                    continue
                if offsets[last] - offsets[first] > LONG:
                    for gram, count in _long_counts(data[offsets[first] : offsets[last]]).items():
                        total[str(langs[first]), gram] = total.get((str(langs[first]), gram), 0) + count
                    continue
                symbols, owner, alphabet = _symbols(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                codes, owner = _grams(symbols, owner, len(alphabet))
                names, which = np.unique(langs[first:last].astype(str), return_inverse=True)
                cells = (len(alphabet) + 1) ** 3
                keys, counts = np.unique(which[owner] * cells + codes, return_counts=True)
                texts: dict[int, str] = {}
                for key, count in zip(keys.tolist(), counts.tolist()):
                    at, code = divmod(key, cells)
                    if code not in texts:
                        texts[code] = _text_of(code, alphabet)
                    k = (names[at], texts[code])
                    total[k] = total.get(k, 0) + count
                if len(total) > 500_000:
                    yield _counts(total)
                    total = {}
        yield _counts(total)

    return (
        docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
        .mapInArrow(tidy(run), "lang string, gram string, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


def _counts(total: dict[tuple[str, str], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])


def train_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", k: int = K) -> DataFrame:
    """(lang, gram, rank): the k most frequent n-grams of each language, rank from 0, ties by the n-gram."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram"))
    return gram_counts(docs, text, lang).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("lang", "gram", "rank")


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """docs with lang_pred (string) and score (double, 1 for a text ranked like its profile).

    The profiles are collected: languages x k short rows.
    """
    learned: dict[str, dict[str, int]] = {}
    for row in profiles.collect():
        learned.setdefault(row["lang"], {})[row["gram"]] = row["rank"]
    names = sorted(learned)
    union = sorted({g for p in learned.values() for g in p})
    ranks = np.full((len(union) + 1, len(names)), -1, dtype=np.int64)
    for j, name in enumerate(names):
        for i, gram in enumerate(union):
            ranks[i, j] = learned[name].get(gram, -1)
    column = docs.columns.index(text)

    def make():
        def function(batch):
            data, offsets = text_buffer(batch.column(column))
            best, score = np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1)
            for first, last in slices(offsets):
                if names and offsets[last] - offsets[first] > LONG:
                    best[first], score[first] = _nearest_of_long(data[offsets[first] : offsets[last]], union, ranks, k)
                elif names and offsets[first] < offsets[last]:
                    best[first:last], score[first:last] = _nearest(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], union, ranks, k)
            return [pa.array([names[i] if i >= 0 else "und" for i in best.tolist()], pa.string()), pa.array(score, pa.float64())]

        return function

    return append_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def _nearest(data, offsets, union, ranks, k):
    n = len(offsets) - 1
    symbols, owner, alphabet = _symbols(data, offsets)
    if not len(symbols):
        return np.full(n, -1), np.zeros(n)
    codes, owner = _grams(symbols, owner, len(alphabet))
    cells = (len(alphabet) + 1) ** 3
    keys = np.sort(owner * cells + codes)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    owner, codes = np.divmod(keys, cells)
    order = np.lexsort((codes, -counts, owner))  # the stated order: count, then the n-gram
    owner, codes = owner[order], codes[order]
    position = np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner]
    top = position < k
    owner, codes, position = owner[top], codes[top], position[top]
    dense = {int(p): i for i, p in enumerate(alphabet.tolist())}
    known = [(_code_of(g, dense, len(alphabet)), i) for i, g in enumerate(union)]
    known = sorted((c, i) for c, i in known if c is not None)
    table = np.array([c for c, _ in known] or [-1], dtype=np.int64)
    index = np.array([i for _, i in known] or [len(union)], dtype=np.int64)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    row = np.where(table[at] == codes, index[at], len(union))
    size = np.bincount(owner, minlength=n)
    best, least = np.full(n, -1), np.full(n, np.inf)
    for j in range(ranks.shape[1]):
        rank = ranks[row, j]
        distance = np.bincount(owner, weights=np.where(rank < 0, k, np.abs(rank - position)), minlength=n)
        nearer = (distance < least) & (size > 0)
        best[nearer], least[nearer] = j, distance[nearer]
    return best, np.where(size > 0, 1 - np.where(size > 0, least, 0) / (k * np.maximum(size, 1)), 0.0)


def _nearest_of_long(data, union, ranks, k):
    """The same for one long text."""
    counts = _long_counts(data)
    order = lambda gram: tuple(0 if c == " " else ord(c) for c in gram) + (_POINTS,) * (3 - len(gram))  # noqa: E731  as codes are
    top = sorted(counts, key=lambda gram: (-counts[gram], order(gram)))[:k]
    if not top:
        return -1, 0.0
    at = {gram: i for i, gram in enumerate(union)}
    rank = ranks[[at.get(gram, len(union)) for gram in top]]
    distance = np.where(rank < 0, k, np.abs(rank - np.arange(len(top))[:, None])).sum(axis=0)
    best = int(distance.argmin())
    return best, 1 - distance[best] / (k * len(top))


def op9_language_id(spark, sf_dir):
    """Contract query: profiles from texts with crc32(doc_id) mod 5 != 0, prediction for every document."""
    from corvane.runtime import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", id_crc() % 5 == 0)
    profiles = train_profiles(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
