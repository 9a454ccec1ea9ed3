"""Vectorised byte kernels over Arrow text columns.

Texts come as one contiguous UTF-8 buffer with offsets; everything here works on whole slices of that
buffer with numpy, so no Python object is made for a word. A slice holds whole texts of about
``SLICE_BYTES`` in all (a longer text is a slice of its own), which bounds the working memory.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word's identity is a 64-bit hash: a
polynomial over random byte values modulo 2**64, then mixed.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SLICE_DOCS = 4095

_rng = np.random.Generator(np.random.PCG64(20240601))
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INV = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_VALUE = BYTE_VALUE[LOWER]
#: For words without punctuation: every ASCII character that is no letter or digit parts words.
IS_PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: list[np.ndarray] = []


def _power(base: int, n: int) -> np.ndarray:
    t = np.full(n, base, dtype=np.uint64)
    t[:1] = 1
    return np.multiply.accumulate(t)


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse; those for up to SLICE_BYTES are kept."""
    if n > SLICE_BYTES:
        return _power(_BASE, n + 1), _power(_BASE_INV, n + 1)
    if not _powers:
        _powers.extend((_power(_BASE, SLICE_BYTES + 1), _power(_BASE_INV, SLICE_BYTES + 1)))
    return _powers[0], _powers[1]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A map over Arrow batches that returns freed memory to the system at its end: a worker lives on for later tasks."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def tidy_group(run):
    """The same for a function of one group's table."""

    @functools.wraps(run)
    def tidied(table):
        try:
            return run(table)
        finally:
            if table.nbytes > SLICE_BYTES:
                _give_back()

    return tidied


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (bijective)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1, from 0) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.large_string()), np.int64
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, docs: int = SLICE_DOCS):
    """(first, last) row ranges of about ``limit`` bytes and at most ``docs`` rows."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + docs, n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and words before each text (len(offsets)). A word never spans two texts.

    gap: which bytes part words.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = gap[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = space[:-1]
    inner = offsets[1:-1]
    edge[inner[inner < len(data)]] = True
    starts = np.flatnonzero(~space & edge[:-1])
    edge[1:-1] = space[1:]
    edge[inner] = True
    ends = np.flatnonzero(~space & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(data) > 2 * SLICE_BYTES:  # a very long text: in parts, so that memory follows the slice
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(int(np.searchsorted(ends, starts[i] + SLICE_BYTES, side="right")), i + 1)
            lo = starts[i]
            out[i:j] = _word_hashes(data[lo : ends[j - 1]], starts[i:j] - lo, ends[i:j] - lo)
            i = j
        return out
    return _word_hashes(data, starts, ends)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = power_table(len(data))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(LOWER_VALUE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def hash_word(word: str) -> int:
    """The hash that word_hashes gives a single word."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


_SHINGLE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, and the text each belongs to.

    A text with fewer than ``width`` words, but one at least, has its whole sequence as its only shingle.
    """
    counts = np.diff(bounds)
    out = np.maximum(counts - width + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), out)
    if not len(owner):
        return np.zeros(0, np.uint64), owner
    first = np.repeat(bounds[:-1] - (np.cumsum(out) - out), out) + np.arange(len(owner))
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    h = np.zeros(len(owner), np.uint64)
    short = counts[owner] < width
    for j in range(width):
        part = padded[first + j] * _SHINGLE[j]
        if short.any():
            part[short & (counts[owner] <= j)] = 0
        h += part
    h += np.minimum(counts[owner], width).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(h), owner
