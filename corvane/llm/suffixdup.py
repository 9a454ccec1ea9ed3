"""Repeated passages by a suffix array of sampled suffixes, sorted deep-shallow.

A byte goes if a string of ``SPAN`` bytes that covers it also starts in a document with a smaller id.
Matches never cross documents and are judged on the input.

Sampling: every window of SPAN bytes has a canonical suffix: the one at its smallest hash of ``GRAM``
bytes (a winnowing anchor; two equal windows have it at the same place, in whatever documents they are).
So the suffixes at anchors that several documents share decide all windows: about one in fourteen bytes,
and of these only the shared ones.

1. Texts are packed into blocks of about ``BLOCK_BYTES`` and written to the shared folder.
2. Blocks deal their distinct anchor hashes to buckets; a bucket tells each block which ones are shared.
3. Blocks deal the contexts of shared anchors (SPAN bytes from the anchor on, SPAN - GRAM before it),
   each distinct one once with its smallest and largest document id. A bucket sorts the suffixes with
   deep-shallow sorting: multikey quicksort on 8-byte words to ``GRAM`` bytes, blind tries below that for
   the groups left, and likewise the reversed left contexts. Longest common prefixes of neighbours give,
   for each offset of a window around its anchor, which contexts agree, and their smallest document id.
4. Blocks mark the windows that have a smaller id and measure what goes and what stays.

Cases: null text counts as empty; texts under SPAN bytes keep all; a null id is larger than all others
and two equal ids don't remove each other's bytes; repeated rows with different ids keep the smallest.

Scale: a hash, or a context, leaves a block once however many of its documents hold it, so a passage that
a third of all documents share brings a bucket one row a block. Blocks and buckets both grow with the
root of the data (within the bounds below), so their (block, bucket) rows grow in proportion to it: 256 to
16384 hashes each up to 8 TB. Nothing is capped or dropped.
"""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.kernel import BYTE_VALUE, mix, slices, text_buffer, tidy, tidy_group
from corvane.runtime import Workspace, ship_package, table

SPAN = 50
GRAM = 24
REACH = SPAN - GRAM  # a window starts at most so many bytes before its anchor
BLOCK_BYTES = 2 << 20, 16 << 20  # of a block, at least and at most
BUCKET_BLOCKS = 4  # bytes of text whose anchors a bucket holds, in blocks
UNIT_BYTES = 1 << 29  # up to here blocks are smallest
PIECE_BYTES = 1 << 17
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_NULL_ID = np.iinfo(np.int64).max


def _pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def _unpack(raw: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=dtype)


@contextmanager
def _few_rows(spark, rows: int):
    """Arrow batches of a few rows: each row here is a block of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over values[i : i + width], for every i where that fits."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = pick(out[: len(out) - (width - have)], out[width - have :])
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position on (fewer positions by GRAM - 1)."""
    value = BYTE_VALUE[data]
    eight, base, width = value, 0xC2B2AE3D27D4EB4F, 1
    while width < 8:
        eight = eight[:-width] * np.uint64(pow(base, width, 1 << 64)) + eight[width:]
        width *= 2
    step = np.uint64(pow(base, 8, 1 << 64))
    n = len(data) - GRAM + 1
    return mix((eight[:n] * step + eight[8 : 8 + n]) * step + eight[16 : 16 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all anchors, ascending, and their hashes; in pieces that fit a processor's cache."""
    found = [(offsets[a], *_anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in slices(offsets, PIECE_BYTES)]
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([none[0], *(at + lo for lo, at, _ in found)]), np.concatenate([none[1], *(h for _, _, h in found)])


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(data) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(data)
    least = _sliding(h, REACH + 1, np.minimum)
    for end, size in zip(offsets[1:].tolist(), np.diff(offsets).tolist()):
        h[end - min(size, GRAM - 1) : end] = _NEVER
        least[end - min(size, SPAN - 1) : end] = 0
    most = _sliding(np.concatenate([np.zeros(REACH, np.uint64), least, np.zeros(REACH, np.uint64)]), REACH + 1, np.maximum)
    found = np.flatnonzero((h == most[: len(h)]) & (h != _NEVER) & (h != 0))
    return found, mix(h[found] ^ np.uint64(0x9E3779B97F4A7C15))  # smallest hashes are small: spread them anew


def block_bytes(size: int) -> int:
    """Bytes of a block: as the root of the size of all texts, within BLOCK_BYTES."""
    return int(min(max(BLOCK_BYTES[0] * (size / UNIT_BYTES) ** 0.5, BLOCK_BYTES[0]), BLOCK_BYTES[1]))


def _blocks(docs: DataFrame, limit: int) -> DataFrame:
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        bodies: list[np.ndarray] = []
        held = 0

        def block():
            nonlocal number
            number += 1
            body = np.concatenate(bodies)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number], pa.int64()), pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()), pa.array([np.concatenate(lengths).astype("<i8").tobytes()], pa.binary()), pa.array([_pack(body)], pa.binary()), pa.array([len(body)], pa.int64())], names=["block", "ids", "lengths", "body", "bytes"])

        for batch in batches:
            own = batch.column(0)
            own_ids = own.fill_null(_NULL_ID).to_numpy()
            data, offsets = text_buffer(batch.column(1))
            first = 0
            while first < len(own_ids):
                last = int(np.searchsorted(offsets, offsets[first] + limit - held, side="right")) - 1
                last = min(max(last, first + 1), len(own_ids))
                ids.append(own_ids[first:last])
                lengths.append(np.diff(offsets[first : last + 1]))
                bodies.append(data[offsets[first] : offsets[last]].copy())
                held += int(offsets[last] - offsets[first])
                first = last
                if held >= limit * 0.9:
                    yield block()
                    ids, lengths, bodies, held = [], [], [], 0
        if ids:
            yield block()

    return docs.mapInArrow(tidy(run), "block long, ids binary, lengths binary, body binary, bytes long")


def _opened(batch: pa.RecordBatch, row: int):
    ids = np.frombuffer(batch.column(1)[row].as_py(), "<i8")
    lengths = np.frombuffer(batch.column(2)[row].as_py(), "<i8")
    return ids, np.concatenate([[0], np.cumsum(lengths)]), _unpack(batch.column(3)[row].as_py(), np.uint8)


class _Anchored:
    """The anchors of a block: hashes in order, and for every distinct hash where its occurrences are."""

    def __init__(self, data, offsets, ids):
        self.at, h = anchors(data, offsets)
        order = np.argsort(h, kind="stable")
        self.at, h = self.at[order], h[order]
        self.first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        self.hash = h[self.first]
        self.which = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(h))))
        self.doc = np.searchsorted(offsets, self.at, side="right") - 1
        self.id = ids[self.doc]
        if len(h):
            self.several = np.minimum.reduceat(self.id, self.first) != np.maximum.reduceat(self.id, self.first)
        else:
            self.several = np.zeros(0, bool)

    def buckets(self, bits: int):
        """(bucket, first, last) ranges of the distinct hashes."""
        bucket = (self.hash >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.hash), np.int64)
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        return list(zip(bucket[edge].tolist(), edge.tolist(), np.append(edge[1:], len(bucket)).tolist()))

    def short(self, bits: int) -> np.ndarray:
        return ((self.hash << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _deal_hashes(blocks: DataFrame, bits: int) -> DataFrame:
    """(bucket, block, hashes, several): 32 bits of each distinct anchor hash below the bucket's bits."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, offsets, data = _opened(batch, row)
                found = _Anchored(data, offsets, ids)
                short, parts = found.short(bits), found.buckets(bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in parts], pa.int64()),
                        pa.array([batch.column(0)[row].as_py()] * len(parts), pa.int64()),
                        pa.array([_pack(np.diff(short[lo:hi], prepend=np.uint32(0))) for _, lo, hi in parts], pa.binary()),
                        pa.array([_pack(np.packbits(found.several[lo:hi])) for _, lo, hi in parts], pa.binary()),
                    ],
                    names=["bucket", "block", "hashes", "several"],
                )

    return blocks.mapInArrow(tidy(run), "bucket long, block long, hashes binary, several binary")


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    """Which values are in an ascending set."""
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _answer_hashes(t: pa.Table) -> pa.Table:
    """For each block of a bucket, the bits of its hashes that several documents share."""
    lists = [np.cumsum(_unpack(x, np.uint32), dtype=np.uint32) for x in t.column("hashes").to_pylist()]
    several = [np.unpackbits(_unpack(x, np.uint8))[: len(h)].astype(bool) for x, h in zip(t.column("several").to_pylist(), lists)]
    once = [h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h for h in lists]  # a list ascends; 32 bits may repeat
    everything = np.sort(np.concatenate(once))
    twice = everything[1:][everything[1:] == everything[:-1]]
    shared = np.unique(np.concatenate([twice, *(h[s] for h, s in zip(lists, several))]))
    bits = [_pack(np.packbits(_among(h, shared))) for h in lists]
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "answer": pa.array(bits, pa.binary())})


def _contexts(data, offsets, found: _Anchored, shared: np.ndarray):
    """Occurrences of shared anchors, their distinct contexts, and which one each occurrence has.

    A context is SPAN + REACH bytes around the anchor, zero outside the document, and how many of its
    bytes there are to the left and right.
    """
    keep = np.flatnonzero(shared[found.which])
    at, doc = found.at[keep], found.doc[keep]
    left = np.minimum(at - offsets[doc], REACH)
    right = np.minimum(offsets[doc + 1] - at, SPAN)
    padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(SPAN, np.uint8)])
    rows = np.empty((len(keep), REACH + SPAN + 2 + 4), np.uint8)
    if len(keep):
        rows[:, 4:-2] = np.lib.stride_tricks.sliding_window_view(padded, REACH + SPAN)[at]
        span = np.arange(-REACH, SPAN)
        rows[:, 4:-2][(span < -left[:, None]) | (span >= right[:, None])] = 0
    rows[:, -2], rows[:, -1] = left, right
    rows[:, :4] = found.which[keep].astype(">u4").view(np.uint8).reshape(-1, 4)  # keeps the order of hashes
    kind = np.dtype((np.void, rows.shape[1]))
    distinct, which = np.unique(np.ascontiguousarray(rows).view(kind).ravel(), return_inverse=True)
    table = distinct.view(np.uint8).reshape(-1, rows.shape[1])
    owner = table[:, :4].copy().view(">u4").ravel().astype(np.int64)
    return keep, which.ravel(), table[:, 4:], owner


def _bits_of(answers: list[dict], parts) -> np.ndarray:
    by = {a["bucket"]: a["answer"] for a in answers or []}
    return np.concatenate([np.unpackbits(_unpack(by[b], np.uint8))[: hi - lo].astype(bool) for b, lo, hi in parts] + [np.zeros(0, bool)])


def _deal_contexts(blocks: DataFrame, bits: int) -> DataFrame:
    """(bucket, block, contexts, low, high) of a bucket's distinct contexts in a block, with document ids."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, offsets, data = _opened(batch, row)
                found = _Anchored(data, offsets, ids)
                parts = found.buckets(bits)
                keep, which, contexts, owner = _contexts(data, offsets, found, _bits_of(batch.column(5)[row].as_py(), parts))
                low, high = np.full(len(contexts), _NULL_ID), np.full(len(contexts), np.iinfo(np.int64).min)
                np.minimum.at(low, which, found.id[keep])
                np.maximum.at(high, which, found.id[keep])
                cuts = [(b, *np.searchsorted(owner, [lo, hi]).tolist()) for b, lo, hi in parts]
                cuts = [c for c in cuts if c[2] > c[1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in cuts], pa.int64()),
                        pa.array([batch.column(0)[row].as_py()] * len(cuts), pa.int64()),
                        *(pa.array([_pack(x[a:z]) for _, a, z in cuts], pa.binary()) for x in (contexts, low, high)),
                    ],
                    names=["bucket", "block", "contexts", "low", "high"],
                )

    return blocks.mapInArrow(tidy(run), "bucket long, block long, contexts binary, low binary, high binary")


def _multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of big-endian words, and for each place whether its row equals the one before.

    All segments of a round are split at once: a pivot (the middle of three) for each, less, equal and
    greater rows; the equal ones go on with the next word.
    """
    n, depth_max = words.shape
    order = np.arange(n)
    starts, ends, depth = (np.array([0]), np.array([n]), np.array([0])) if n > 1 else (np.zeros(0, np.int64),) * 3
    equal = np.zeros(n, bool)
    while len(starts):
        sizes = ends - starts
        rows = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        seg = np.repeat(np.arange(len(starts)), sizes)
        value = words[order[rows], depth[seg]]
        three = np.sort(np.stack([words[order[starts], depth], words[order[(starts + ends) // 2], depth], words[order[ends - 1], depth]]), axis=0)
        pivot = three[1][seg]
        side = (value >= pivot).astype(np.int64) + (value > pivot)
        move = np.argsort(seg * 3 + side, kind="stable")
        order[rows] = order[rows][move]
        counts = np.bincount(seg * 3 + side, minlength=3 * len(starts))
        lo = np.repeat(starts, 3) + (np.cumsum(counts) - counts) - np.repeat(np.cumsum(sizes) - sizes, 3)
        hi, level = lo + counts, np.repeat(depth, 3)
        level[1::3] += 1
        done = (level == depth_max) & (counts > 1)
        for a, b in zip(lo[done].tolist(), hi[done].tolist()):
            equal[a + 1 : b] = True
        go = (counts > 1) & (level < depth_max)
        starts, ends, depth = lo[go], hi[go], level[go]
    return order, equal


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of strings of one length, and the common prefix of each with the one before it (0 for the first).

    A node knows only the place where its strings part and their next byte; to insert a string, go down
    blindly to any leaf, compare with that one string, and branch where they part.
    """
    length = len(strings[0])
    leaves: list[list[int]] = [[0]]
    root: list | int = 0  # a leaf's number, or [place, {byte: child}]
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        other = strings[leaves[node][0]]
        if s == other:
            leaves[node].append(i)
            continue
        part = 0
        while s[part] == other[part]:
            part += 1
        above, node = None, root
        while not isinstance(node, int) and node[0] < part:
            above, node = node, node[1][s[node[0]]]
        leaves.append([i])
        if not isinstance(node, int) and node[0] == part:
            node[1][s[part]] = len(leaves) - 1
            continue
        new = [part, {s[part]: len(leaves) - 1, other[part]: node}]
        if above is None:
            root = new
        else:
            above[1][s[above[0]]] = new
    order, common = [], []
    stack: list = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, int):
            for k, i in enumerate(leaves[node]):
                order.append(i)
                common.append(length if k else shared)
        else:
            kids = sorted(node[1].items())
            stack.extend((kid, node[0] if k else shared) for k, (_, kid) in reversed(list(enumerate(kids))))
    return order, common


def deep_shallow(strings: np.ndarray, shallow: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and the common prefix of each place with the place before."""
    n, width = strings.shape
    head = np.zeros((n, -(-shallow // 8) * 8), np.uint8)
    head[:, : min(shallow, width)] = strings[:, :shallow]
    order, equal = _multikey_quicksort(head.view(">u8").astype(np.uint64))
    lcp = np.zeros(n, np.int64)
    sorted_rows = strings[order]
    differs = sorted_rows[1:] != sorted_rows[:-1]
    lcp[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    if width > shallow and equal.any():
        edge = np.flatnonzero(~equal)
        sizes = np.diff(np.append(edge, n))
        tails = np.ascontiguousarray(sorted_rows[:, shallow:])
        raw, w = tails.tobytes(), width - shallow
        for a, size in zip(edge[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            inside, common = blind_trie([raw[w * i : w * (i + 1)] for i in range(a, a + size)])
            order[a : a + size] = order[a : a + size][inside]
            lcp[a + 1 : a + size] = np.array(common[1:]) + shallow
    return order, lcp


def _classes(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth)
    return out


def _answer_contexts(t: pa.Table) -> pa.Table:
    """For each block of a bucket, the contexts that a smaller document shares at some offset, and its id by offset."""
    width = REACH + SPAN + 2
    rows = [_unpack(x, np.uint8).reshape(-1, width) for x in t.column("contexts").to_pylist()]
    sizes = [len(r) for r in rows]
    high = np.concatenate([_unpack(x, np.int64) for x in t.column("high").to_pylist()])
    low = np.concatenate([_unpack(x, np.int64) for x in t.column("low").to_pylist()])
    distinct, which = np.unique(np.ascontiguousarray(np.concatenate(rows)).view(np.dtype((np.void, width))).ravel(), return_inverse=True)
    which, contexts = which.ravel(), distinct.view(np.uint8).reshape(-1, width)
    first = np.full(len(contexts), _NULL_ID)
    np.minimum.at(first, which, low)
    left, right = contexts[:, -2].astype(np.int64), contexts[:, -1].astype(np.int64)
    by_right = deep_shallow(np.ascontiguousarray(contexts[:, REACH : REACH + SPAN]))
    by_left = deep_shallow(np.ascontiguousarray(contexts[:, :REACH][:, ::-1]))
    least = np.full((len(contexts), REACH + 1), _NULL_ID)
    for back in range(REACH + 1):
        valid = np.flatnonzero((left >= back) & (right >= SPAN - back))
        if len(valid):
            key = _classes(*by_right, SPAN - back)[valid] * (len(contexts) + 1) + (_classes(*by_left, back)[valid] if back else 0)
            _, group = np.unique(key, return_inverse=True)
            lowest = np.full(group.max() + 1, _NULL_ID)
            np.minimum.at(lowest, group, first[valid])
            least[valid, back] = lowest[group]
    bounds, answers = np.concatenate([[0], np.cumsum(sizes)]), []
    for a, b in zip(bounds[:-1], bounds[1:]):
        mine = which[a:b]
        useful = np.flatnonzero((least[mine] < high[a:b, None]).any(axis=1))
        answers.append((_pack(useful.astype(np.int32)), _pack(least[mine[useful]])))
    return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "which": pa.array([x for x, _ in answers], pa.binary()), "least": pa.array([x for _, x in answers], pa.binary())})


def _measured(blocks: DataFrame, bits: int, with_text: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                ids, offsets, data = _opened(batch, row)
                gone = _gone(data, offsets, ids, bits, batch.column(5)[row].as_py(), batch.column(6)[row].as_py())
                total = np.concatenate([[0], np.cumsum(gone)])
                removed = total[offsets[1:]] - total[offsets[:-1]]
                edge = np.concatenate([[False], gone, [False]]).astype(np.int8)
                rises = gone & ~edge[:-2].astype(bool)
                inner = offsets[:-1][np.diff(offsets) > 0]
                rises[inner] = gone[inner]
                runs = np.concatenate([[0], np.cumsum(rises)])
                spans = runs[offsets[1:]] - runs[offsets[:-1]]
                kept = [data[a:b][~gone[a:b]].tobytes() if r else data[a:b].tobytes() for a, b, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), removed.tolist())]
                columns = [pa.array(ids, mask=ids == _NULL_ID), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    starts = np.flatnonzero(rises)
                    stops = np.flatnonzero(gone & (~edge[2:].astype(bool) | np.isin(np.arange(1, len(gone) + 1), inner))) + 1
                    owner = np.searchsorted(offsets, starts, side="right") - 1
                    lists = [[] for _ in ids]
                    for d, a, b in zip(owner.tolist(), starts.tolist(), stops.tolist()):
                        lists[d].append({"start": a - int(offsets[d]), "end": b - int(offsets[d])})
                    columns += [pa.array(kept, pa.binary()), pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                    names += ["kept", "spans"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return blocks.mapInArrow(tidy(run), schema + (", kept binary, spans array<struct<start:bigint,end:bigint>>" if with_text else ""))


def _gone(data, offsets, ids, bits, shared, answers) -> np.ndarray:
    """Which bytes of a block go."""
    gone = np.zeros(len(data), bool)
    if not answers:
        return gone
    found = _Anchored(data, offsets, ids)
    parts = found.buckets(bits)
    keep, which, contexts, owner = _contexts(data, offsets, found, _bits_of(shared, parts))
    least = np.full((len(contexts), REACH + 1), _NULL_ID)
    by = {a["bucket"]: a for a in answers}
    for b, lo, hi in parts:
        if b in by:
            first = np.searchsorted(owner, lo)
            least[first + _unpack(by[b]["which"], np.int32)] = _unpack(by[b]["least"], np.int64).reshape(-1, REACH + 1)
    hit, back = np.nonzero(least[which] < found.id[keep][:, None])
    start = found.at[keep][hit] - back
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + SPAN, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", with_text: bool = True, label: str = "suffixdup") -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept (bytes), spans (in bytes)]."""
    spark = docs.sparkSession
    ship_package(spark)
    work = Workspace(spark, label)
    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = picked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    limit = block_bytes(size)
    with _few_rows(spark, 500):
        blocks = work.write(_blocks(picked, limit), "blocks", compression="none")
    bits = max(0, int(size // (BUCKET_BLOCKS * limit)).bit_length())
    with _few_rows(spark, max(1, 4 * BLOCK_BYTES[0] // limit)):
        hashes = _deal_hashes(blocks, bits).repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(tidy_group(_answer_hashes), "block long, bucket long, answer binary")
        shared = work.write(hashes.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias("shared")), "shared")
        each = blocks.count()  # a partition a block: bodies and answers of a few blocks in a task
        dealt = lambda rows: rows.repartition(max(each, 1), "block")
        told = dealt(blocks).join(dealt(shared), "block", "left")
        contexts = _deal_contexts(told, bits).repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(tidy_group(_answer_contexts), "block long, bucket long, which binary, least binary")
        answers = work.write(contexts.groupBy("block").agg(F.collect_list(F.struct("bucket", "which", "least")).alias("answers")), "answers")
        result = work.write(_measured(told.join(dealt(answers), "block", "left"), bits, with_text), "result")
    work.drop("blocks", "shared", "answers")
    return result


def op2_suffix_dedup(spark, sf_dir):
    """Contract query over all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
