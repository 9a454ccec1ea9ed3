"""Token ids in a content-addressed store.

Every text becomes a stream of token ids with an end id. A rolling hash over 16 ids cuts the stream into
chunks (content-defined: an insertion moves only the cuts around it); a chunk's address is the BLAKE2b
hash of its ids as little-endian unsigned 32-bit integers. The store in the shared folder has

* ``objects/kind=chunk``: (key, n, payload): each distinct chunk once, ids packed in 16 or 32 bits,
* ``index/kind=recipe``: (shard, row, doc_id, n, key = Merkle root of the document, payload = addresses
  of its chunks); shards and rows ascend by doc_id,
* ``index/kind=manifest``: one row a shard: documents, ids, and the Merkle root over its documents.

Reading goes through the files only: every chunk is decoded once and must hash to its address, every
recipe must hash to its root, every shard to its manifest.

Cases: null text counts as empty (the end id alone); null ids come first; rows that repeat an id follow
each other, ordered by content; an empty table gives an empty store. Other columns play no part.

Scale: texts are read and encoded once, in a map; the one large shuffle moves packed ids, of which each
task sends a chunk once; recipes, a few hundredths of the ids, are sorted by range. Reading moves only
(address, length, checksum) rows: checksums of documents are combined from those of their chunks.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.kernel import BYTE_VALUE, mix, power_table, slices, text_buffer, tidy
from corvane.runtime import Workspace, arrow_rows, ship_package, table

END_ID = 2
CUT_WINDOW = 16
_CUT_BASE = 0xD6E8FEB86659FD93
CUT_MASK = np.uint64(1023)  # a cut every 1024 ids in the mean
LEAST, MOST = 128, 4096
PLACES = 1 << 20  # of parts remembered, twice
MOST_IDS = 1 << 23  # of parts remembered
ENCODE_BYTES = 1 << 19
_ID_VALUE = mix(np.arange(1, 1 << 17, dtype=np.uint64))

_state: dict = {}


def load_tokenizer(path: str) -> str:
    """The tokenizer's file as text; the driver reads it, executors get the text."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def _wide_space(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space beyond ASCII: U+0085, U+00A0, U+1680, U+180E, U+2000 to 200B, U+2028, U+2029, U+202F, U+205F, U+3000."""
    out = np.zeros(len(raw), bool)
    at = np.flatnonzero((raw >= 0xC2) & (raw <= 0xE3))
    at = at[(raw[at] == 0xC2) | (raw[at] >= 0xE1)]
    a, b, c = raw[at], raw[np.minimum(at + 1, len(raw) - 1)], raw[np.minimum(at + 2, len(raw) - 1)]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    three = (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
    three |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    three |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    for j in range(3):
        out[at[three if j == 2 else two | three] + j] = True
    return out


def _segments(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets at which texts start or every byte-level pre-tokenizer of this kind cuts as well, ascending.

    The latter are a single space between two characters that are no white space (in Unicode's sense, as
    the pre-tokenizer's is), and a full stop or comma after an ASCII letter. Encoding the parts gives the same ids as encoding the whole.
    """
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 2:
        solid = (raw > 0x20) & ~_wide_space(raw)
        cut[1:-2] = (raw[1:-1] == 0x20) & solid[:-2] & solid[2:]
        folded = raw[:-1] | 0x20
        cut[1:-1] |= ((raw[1:] == 0x2E) | (raw[1:] == 0x2C)) & (folded >= 0x61) & (folded <= 0x7A) & (raw[:-1] < 0x80)
    cut[offsets] = True
    return np.flatnonzero(cut)


def _part_hashes(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every part between two cuts, and its first eight bytes mixed with its length."""
    power, inverse = power_table(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUE[raw] * power[: len(raw)], out=total[1:])
    size = np.diff(cuts).astype(np.uint64)
    head = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)[cuts[:-1]].copy().view("<u8").ravel()
    head &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(size, np.uint64(8)))
    return mix((total[cuts[1:]] - total[cuts[:-1]]) * inverse[cuts[:-1]] + size), head * np.uint64(0x9E3779B97F4A7C15) + size


def _cuts_alike(spec: str) -> bool:
    """Whether a tokenizer's file describes one for which parts between _segments' cuts encode like the whole."""
    said = json.loads(spec)
    pre = said.get("pre_tokenizer") or {}
    added = said.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not said.get("normalizer")
    return bool(plain) and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or set(" ,.") & set(t["content"]) for t in added)


class Encoder:
    """Whole texts to ids; parts that recur are encoded once and remembered.

    A part is known by 64 bits of hash, its first bytes and its length. The memory is a table of two places
    a part, in which a new one takes the place of an old one, so its size is fixed.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core

        self.tokenizer = Tokenizer.from_str(spec)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # every part comes once, so the library's own cache is in the way
        self.whole = not _cuts_alike(spec)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.wide = max(vocabulary.values(), default=0) > 65535
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # a byte-level token has a character a byte
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes[i] = len(token.content.encode())
        self.forget()

    def forget(self) -> None:
        self.key, self.check = np.zeros((2, PLACES), np.uint64), np.zeros((2, PLACES), np.uint64)  # key 0: free
        self.start, self.size = np.zeros((2, PLACES), np.int32), np.zeros((2, PLACES), np.int32)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _learn(self, raw: bytes, lo: np.ndarray, hi: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode parts raw[lo:hi]; where their ids start in self.ids, and how many they are.

        Parts that need not stand alone are encoded as one text, with a letter before those that start with
        a full stop or comma; the bytes that every id stands for tell where a part's ids end.
        """
        start, size = np.zeros(len(lo), np.int32), np.zeros(len(lo), np.int32)
        both = np.flatnonzero(~alone)
        if len(both):
            parts = [raw[x:y] for x, y in zip(lo[both].tolist(), hi[both].tolist())]
            led = [p[0] != 0x20 for p in parts]
            ends = np.cumsum(hi[both] - lo[both] + 2 * np.array(led))
            begins = ends - (hi[both] - lo[both])
            joined = b"".join([b" a" + p if x else p for p, x in zip(parts, led)])
            ids = np.array(self.tokenizer.encode_batch_fast([joined.decode("utf-8")], add_special_tokens=False)[0].ids, np.uint32)
            before = np.concatenate([[0], np.cumsum(self.bytes[ids])])
            at, upto = np.searchsorted(before, begins), np.searchsorted(before, ends)
            top = len(before) - 1
            fits = (before[np.minimum(at, top)] == begins) & (before[np.minimum(upto, top)] == ends)
            start[both], size[both] = self.used + at, upto - at
            self._store(ids)
            alone = alone.copy()
            alone[both[~fits]] = True
        each = np.flatnonzero(alone)
        if len(each):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([raw[x:y].decode("utf-8") for x, y in zip(lo[each].tolist(), hi[each].tolist())], add_special_tokens=False)]
            size[each] = np.fromiter(map(len, found), np.int32, len(found))
            start[each] = self.used + np.cumsum(size[each]) - size[each]
            self._store(np.fromiter(chain.from_iterable(found), np.uint32, int(size[each].sum())))
        return start, size

    def _store(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(self.used, len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END_ID, and the bounds of the texts."""
        cuts = np.unique(offsets) if self.whole else _segments(data, offsets)
        if self.used > MOST_IDS:
            self.forget()
        key, check = _part_hashes(data, cuts)
        key |= np.uint64(1)
        one, two = (key >> np.uint64(1)).astype(np.int64) & (PLACES - 1), (key >> np.uint64(32)).astype(np.int64) & (PLACES - 1)
        start, size = self.start[0][one], self.size[0][one]
        rest = np.flatnonzero((self.key[0][one] != key) | (self.check[0][one] != check))
        there = two[rest]
        start[rest], size[rest] = self.start[1][there], self.size[1][there]
        new = rest[(self.key[1][there] != key[rest]) | (self.check[1][there] != check[rest])]
        if len(new):
            new = new[np.lexsort((check[new], key[new]))]
            head = np.concatenate([[True], (key[new][1:] != key[new][:-1]) | (check[new][1:] != check[new][:-1])])
            first = new[head]
            last = np.zeros(len(cuts), bool)  # the last part of a text may end with white space
            last[np.searchsorted(cuts, offsets[1:]) - 1] = True
            lead = data[cuts[first]]
            solid = data[np.minimum(cuts[first] + 1, len(data) - 1)] > 0x20
            alone = self.whole | last[first] | ~(((lead == 0x20) & solid) | (lead == 0x2E) | (lead == 0x2C)) | np.isin(cuts[first], offsets)
            at, n = self._learn(data.tobytes(), cuts[first], cuts[first + 1], alone)
            which = np.cumsum(head) - 1
            start[new], size[new] = at[which], n[which]
            free = self.key[0][one[first]] == 0
            for way, pick, place in ((0, free, one), (1, ~free, two)):
                slot = place[first[pick]]
                self.key[way][slot], self.check[way][slot], self.start[way][slot], self.size[way][slot] = key[first[pick]], check[first[pick]], at[pick], n[pick]
        upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        kind = np.int32 if max(self.used, upto[-1]) < 1 << 31 else np.int64
        flat = self.ids[np.repeat((start - upto[:-1]).astype(kind), size) + np.arange(upto[-1], dtype=kind)]
        before = upto[np.searchsorted(cuts, offsets)]
        return np.insert(flat, before[1:], END_ID), before + np.arange(len(before))


def cut_points(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Ends of all chunks: where the rolling hash of the last CUT_WINDOW ids says so, within LEAST and MOST ids, and at each text's end."""
    value = _ID_VALUE[ids % len(_ID_VALUE)]
    h, width = value, 1
    while width < CUT_WINDOW:  # of the last 2, 4, 8 .. ids
        before, h = h, h.copy()
        h[width:] += before[:-width] * np.uint64(pow(_CUT_BASE, width, 1 << 64))
        width *= 2
    marks = np.flatnonzero((mix(h) & CUT_MASK) == 0) + 1
    ends: list[int] = []
    for first, last, lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), np.searchsorted(marks, bounds[:-1] + CUT_WINDOW).tolist(), np.searchsorted(marks, bounds[1:]).tolist()):
        at = first
        for mark in marks[lo:hi].tolist():
            while mark - at > MOST:
                at += MOST
                ends.append(at)
            if mark - at >= LEAST and mark < last:
                ends.append(mark)
                at = mark
        while last - at > MOST:
            at += MOST
            ends.append(at)
        ends.append(last)
    return np.array(ends, dtype=np.int64)


def _address(raw) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [_address(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return _address(b"\x02" + len(leaves).to_bytes(8, "little") + level[0])


_STORED = pa.schema([("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()), ("once", pa.binary())])


def _stored(batches, encoder: Encoder, part: int):
    """Batches of (doc_id, text) as rows of chunks and recipes; a chunk is sent once a task."""
    row, width = 0, "<u4" if encoder.wide else "<u2"
    sent: set[bytes] = set()
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for first, last in slices(offsets, ENCODE_BYTES):
            ids, bounds = encoder.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            ends = cut_points(ids, bounds)
            raw, packed = memoryview(ids.astype("<u4").tobytes()), ids.astype(width).tobytes()
            step, keys, new, at = 2 if width == "<u2" else 4, [], [], 0
            for end in ends.tolist():
                key = _address(raw[4 * at : 4 * end])
                keys.append(key)
                if key not in sent:
                    sent.add(key)
                    new.append((key, at, end))
                at = end
            upto = np.searchsorted(ends, bounds, side="right").tolist()
            listed = [keys[a:b] for a, b in zip(upto, upto[1:])]
            m, n = len(new), last - first
            once = [b"%d.%d" % (part, i) for i in range(row, row + n)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["chunk"] * m + ["recipe"] * n),
                    pa.array([k for k, _, _ in new] + [merkle_root(x) for x in listed], pa.binary()),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), batch.column(0).slice(first, n)]),
                    pa.array([b - a for _, a, b in new] + np.diff(bounds).tolist(), pa.int64()),
                    pa.array([packed[step * a : step * b] for _, a, b in new] + [b"".join(x) for x in listed], pa.binary()),
                    pa.array([k for k, _, _ in new] + once, pa.binary()),
                ],
                schema=_STORED,
            )
            row += n


def _encoded(docs: DataFrame, spec: str) -> DataFrame:
    """Rows of chunks and recipes. once: what a row is unique by."""
    spec_of = docs.sparkSession.sparkContext.broadcast(spec)  # one vocabulary file

    def run(batches):
        name = hashlib.blake2b(spec_of.value.encode(), digest_size=8).digest()
        if _state.get("name") != name:
            _state.update(name=name, encoder=Encoder(spec_of.value))
        yield from _stored(batches, _state["encoder"], TaskContext.get().partitionId())

    return docs.mapInArrow(tidy(run), "kind string, key binary, doc_id long, n long, payload binary, once binary")


def write_store(docs: DataFrame, tokenizer: str, work: Workspace, text: str = "text", id: str = "doc_id") -> None:
    """Write all texts of docs into the store of work."""
    spark = docs.sparkSession
    ship_package(spark)
    arrow_rows(spark)
    picked = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    stored = _encoded(picked, load_tokenizer(tokenizer)).dropDuplicates(["once"])
    stored.drop("once").write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", 0).partitionBy("kind").parquet(work.path("objects"))
    schema = "key binary, doc_id long, n long, payload binary, kind string"
    recipes = spark.read.schema(schema).parquet(work.path("objects")).where("kind = 'recipe'").select("doc_id", "n", "key", "payload")

    def shards(batches):
        shard, row, total, roots = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            m = batch.num_rows
            roots += batch.column(2).to_pylist()
            total += int(np.sum(batch.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * m), pa.array([shard] * m, pa.int64()), pa.array(np.arange(row, row + m)), *(batch.column(i) for i in range(4))], names=["kind", "shard", "row", "doc_id", "n", "key", "payload"])
            row += m
        if row:
            yield pa.RecordBatch.from_arrays([pa.array(["manifest"]), pa.array([shard], pa.int64()), pa.array([row], pa.int64()), pa.nulls(1, pa.int64()), pa.array([total], pa.int64()), pa.array([merkle_root(roots)], pa.binary()), pa.nulls(1, pa.binary())], names=["kind", "shard", "row", "doc_id", "n", "key", "payload"])

    ranged = recipes.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "key")
    ranged.mapInArrow(tidy(shards), "kind string, shard long, row long, doc_id long, n long, key binary, payload binary").write.mode("overwrite").partitionBy("kind").parquet(work.path("index"))
    work.drop("objects/kind=recipe")  # they are in the index now


def _index(work: Workspace, kind: str) -> DataFrame:
    schema = "shard long, row long, doc_id long, n long, key binary, payload binary, kind string"
    return work.spark.read.schema(schema).parquet(work.path("index")).where(F.col("kind") == kind).drop("kind")


def read_chunks(work: Workspace, wide: bool, with_ids: bool = False) -> DataFrame:
    """(key, n, crc[, ids]): every stored chunk, decoded and held against its address; fails on a damaged one."""
    stored = work.spark.read.schema("key binary, doc_id long, n long, payload binary, kind string").parquet(work.path("objects")).where("kind = 'chunk'").select("key", "payload")
    width = "<u4" if wide else "<u2"

    def run(batches):
        for batch in batches:
            n, crc, lists = [], [], []
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(payload, dtype=width).astype("<u4")
                raw = ids.tobytes()
                if _address(raw) != key:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                n.append(len(ids))
                crc.append(zlib.crc32(raw))
                if with_ids:
                    lists.append(ids.astype(np.int32))
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(lists, pa.list_(pa.int32()))] if with_ids else []), names=["key", "n", "crc"] + ["ids"] * with_ids)

    return stored.mapInArrow(tidy(run), "key binary, n long, crc long" + ", ids array<int>" * with_ids)


def _recipe_chunks(work: Workspace) -> DataFrame:
    """(shard, row, doc_id, root, at, key): the chunks of every document in order."""
    recipes = _index(work, "recipe").select("shard", "row", "doc_id", F.col("key").alias("root"), "payload")
    count = F.floor(F.octet_length("payload") / 16).cast("int")
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("payload"), i * 16 + 1, F.lit(16)))
    return recipes.select("shard", "row", "doc_id", "root", F.posexplode(each).alias("at", "key"))


_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in GF(2)[x] modulo the crc32 polynomial (bit-reversed)."""
    a, b = np.broadcast_arrays(a.astype(np.uint32), b.astype(np.uint32))
    out, b = np.zeros(a.shape, np.uint32), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def combine_crc(crc: np.ndarray, n_after: np.ndarray) -> np.ndarray:
    """What a part with this crc32 adds (by xor) to the crc32 of a whole in which n_after 4-byte ids follow it."""
    out = crc.astype(np.uint32)
    power = np.array([0x80000000], np.uint32)  # 1
    x = np.array([0x40000000], np.uint32)  # x
    for _ in range(32):  # x ** 32: one id
        power = _times(power, x)
    left = n_after.astype(np.int64).copy()
    while left.any():
        odd = (left & 1).astype(bool)
        if odd.any():
            out[odd] = _times(out[odd], power)
        power = _times(power, power)
        left >>= 1
    return out


def read_documents(work: Workspace, wide: bool) -> DataFrame:
    """(shard, row, doc_id, n_tokens, ids_crc32): documents rebuilt from recipes and chunks.

    Fails where a recipe names a chunk that the store lacks or doesn't hash to its root.
    """
    joined = _recipe_chunks(work).join(read_chunks(work, wide), "key", "left")
    rows = joined.groupBy("shard", "row", "doc_id", "root").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(-1)).alias("n"), F.coalesce("crc", F.lit(0)).alias("crc"), "key"))).alias("parts"))

    def run(batches):
        for batch in batches:
            parts = batch.column(4)
            flat = parts.flatten()
            sizes = np.diff(parts.offsets.to_numpy())
            n, crc, keys = flat.field("n").to_numpy(), flat.field("crc").to_numpy(), flat.field("key").to_pylist()
            if (n < 0).any():
                raise ValueError("a recipe names a chunk that is not stored")
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            for a, b, root in zip(bounds[:-1].tolist(), bounds[1:].tolist(), batch.column(3).to_pylist()):
                if merkle_root(keys[a:b]) != root:
                    raise ValueError("a recipe does not hash to its root")
            upto = np.cumsum(n)
            after = np.repeat(upto[bounds[1:] - 1], sizes) - upto
            crcs = np.bitwise_xor.reduceat(combine_crc(crc, after), bounds[:-1]) if len(sizes) else np.zeros(0, np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.add.reduceat(n, bounds[:-1]) if len(sizes) else n, pa.int64()), pa.array(crcs.astype(np.int64))], names=["shard", "row", "doc_id", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(tidy(run), "shard long, row long, doc_id long, n_tokens long, ids_crc32 long")


def read_ids(work: Workspace, wide: bool) -> DataFrame:
    """(shard, row, doc_id, ids): the full id stream of every document."""
    joined = _recipe_chunks(work).join(read_chunks(work, wide, with_ids=True), "key")
    return joined.groupBy("shard", "row", "doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))


def verify_manifests(work: Workspace) -> DataFrame:
    """(shard, documents, ok): whether each shard's recipes hash, in number and roots, to its manifest."""
    listed = _index(work, "recipe").groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "key"))), lambda x: x["key"]).alias("roots"))

    def run(batches):
        for batch in batches:
            ok = [r is not None and m is not None and merkle_root(r) == m for r, m in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ok)], names=["shard", "documents", "ok"])

    manifests = _index(work, "manifest").select("shard", F.col("row").alias("documents"), F.col("key").alias("root"))
    return listed.join(manifests, "shard", "full").mapInArrow(tidy(run), "shard long, documents long, ok boolean")


def check_manifests(work: Workspace) -> None:
    """Fail if a shard's recipes are not those of its manifest."""
    bad = [r["shard"] for r in verify_manifests(work).where(~F.col("ok")).limit(10).collect()]
    if bad:
        raise ValueError(f"shards {bad} do not match their manifests")


def token_output(docs: DataFrame, tokenizer: str | None = None, text: str = "text", id: str = "doc_id", label: str = "tokens") -> DataFrame:
    """Write docs to a new store and return, from its files, doc_id, start, n_tokens, ids_crc32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    work = Workspace(docs.sparkSession, label)
    write_store(docs, tokenizer, work, text, id)
    check_manifests(work)
    found = work.write(read_documents(work, Encoder(load_tokenizer(tokenizer)).wide), "found")
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = found.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shard_at"))
    inside = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return found.join(shards, "shard").select("doc_id", (F.col("shard_at") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).cast("long").alias("start"), "n_tokens", "ids_crc32")


def op1_token_store(spark, sf_dir):
    """Contract query over all documents."""
    return token_output(table(spark, sf_dir, "documents"))
