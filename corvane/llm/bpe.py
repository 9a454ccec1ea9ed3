"""Byte-pair encoding and decoding as streaming transducers.

A merge list allows bounded lookahead. Let a part of a text end after n bytes, and compare its merges with
those of any longer text: they can differ only because some rule took a symbol at the end, then a rule of
higher rank the symbol before it, and so on to the left. Rule (u, v) moves the place where the two differ
by the bytes of u, and v must begin with the symbol that the rule before it took. The longest such chain of
rising ranks is the *sufficient lookahead* L: tokens that end L bytes or more before the end of what has
been read are final. ``Merges`` computes L from the list in one pass (it demands that rules build on earlier
rules only, which makes the chains finite), and the ``Encoder`` emits tokens as soon as they are final.

The encoder reads a text in pieces of ``PIECE`` characters. The pattern that parts words needs three
characters of lookahead; a word that goes on beyond that (a run of one class of characters) is passed to
the window of the merges while it is still open, so what is held is ``WINDOW + L`` bytes and a piece of
text, whatever the length of a text or of its words. Short words are remembered with their ids, in two
tables of a fixed number of words.

The decoder maps ids to bytes and bytes to text by an incremental UTF-8 machine: bytes of a character that
isn't complete wait for the next ids; those that can't be completed become U+FFFD.

Special tokens of the file (``added_tokens``) are found in texts as the library finds them; what follows
one is encoded afresh. Other normalisers, pre-tokenizers or models than byte-level pairs are an error.

Cases: null text counts as empty and has no ids; null and repeated doc_ids are rows like others; unknown
ids decode to nothing; an empty table gives an empty result. Other columns play no part.

Scale: maps only, no shuffle; memory does not grow with texts, as the ids of a document leave in parts of
at most ``PART``.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.frames import append_columns
from corvane.llm.kernel import tidy
from corvane.runtime import arrow_rows, ship_package, table

PIECE = 1 << 16  # characters read at a time
PART = 1 << 16  # ids in a row
WINDOW = 1 << 12  # bytes of an open word that are merged at a time
LONGEST = 48  # characters of a word that is remembered
REMEMBERED = 1 << 17  # words, twice
SHORT = 64  # bytes that are merged without a heap
_NEVER = (1 << 62, -1)

#: The pattern that parts words before the merges of byte-level vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
RUNS = {"letters": regex.compile(r"\p{L}*"), "numbers": regex.compile(r"\p{N}*"), "spaces": regex.compile(r"\s*"), "others": regex.compile(r"[^\s\p{L}\p{N}]*")}
AHEAD = 3  # characters after a match that can still change it
LEAST_RUN = 64  # characters of a word that is passed on while it is open, at least

_state: dict = {}


def byte_letters() -> dict[str, int]:
    """The character by which such files write each byte: itself if it prints, else the next one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(rules: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Bytes by which later text can reach back, from rules (u, v, uv) in the order of their ranks."""
    first: dict[int, int] = {}  # the part that a symbol begins with
    reach: dict[int, int] = {}  # bytes that a chain whose last rule took u on its left goes back
    for u, v, uv in rules:
        before, symbol = 0, v
        while symbol is not None:
            before = max(before, reach.get(symbol, 0))
            symbol = first.get(symbol)
        reach[u] = max(reach.get(u, 0), before + size[u])
        first[uv] = u
    return max(reach.values(), default=0)


class Merges:
    """A byte-level vocabulary: ids, ranked rules, special tokens, bytes of ids, and the sufficient lookahead."""

    def __init__(self, spec: str):
        said = json.loads(spec)
        model, pre = said["model"], said.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not said.get("normalizer")
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        self.special = {t["content"]: t["id"] for t in said.get("added_tokens") or []}
        if not plain or odd or any(t.get(k) for t in said.get("added_tokens") or [] for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("not a plain byte-level pair vocabulary")
        letters, vocabulary = byte_letters(), model["vocab"]
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items()}
        self.bytes |= {i: content.encode() for content, i in self.special.items()}
        self.of_byte = [vocabulary[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        made, listed = set(self.of_byte), []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            u, v, uv = vocabulary[left], vocabulary[right], vocabulary[left + right]
            if u not in made or v not in made or uv in made:
                raise ValueError(f"rule {rank} doesn't build on earlier rules only: the lookahead would have no bound")
            made.add(uv)
            listed.append((u, v, uv))
            self.rules[u, v] = (rank, uv)
        self.lookahead = sufficient_lookahead(listed, {i: len(b) for i, b in self.bytes.items()})
        self.found = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.tails = {s[:k] for s in self.special for k in range(1, len(s))}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of bytes: lowest rank first, then leftmost. Few bytes: by looking at all pairs each time; many: by a heap."""
        ids: list = [self.of_byte[b] for b in raw]
        n, rules = len(ids), self.rules
        if n <= SHORT:
            due = [rules.get(pair, _NEVER) for pair in zip(ids, ids[1:])]
            while due and (rule := min(due)) is not _NEVER:
                i = due.index(rule)
                ids[i : i + 2] = [rule[1]]
                del due[i]
                if i < len(due):
                    due[i] = rules.get((ids[i], ids[i + 1]), _NEVER)
                if i:
                    due[i - 1] = rules.get((ids[i - 1], ids[i]), _NEVER)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [(rank[0], i) for i in range(n - 1) if (rank := rules.get((ids[i], ids[i + 1])))]
        heapq.heapify(due)
        while due:
            rank, i = heapq.heappop(due)
            j = after[i]
            if ids[i] is None or j >= n or (rule := rules.get((ids[i], ids[j]))) is None or rule[0] != rank:
                continue  # one of the two has been merged since
            ids[i], ids[j] = rule[1], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rule := rules.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(due, (rule[0], i))
            if (h := before[i]) >= 0 and (rule := rules.get((ids[h], ids[i]))) is not None:
                heapq.heappush(due, (rule[0], h))
        return [i for i in ids if i is not None]


class _Words(dict):
    """Ids of short words as packed bytes, computed when first asked for.

    When the table is full, it becomes the one before, from which words that are asked for again are taken
    over: so frequent words stay, whatever comes between.
    """

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges, self.before = merges, {}

    def __missing__(self, word: str) -> bytes:
        if len(word) > LONGEST:
            raw = word.encode()
            window = _Window(self.merges)
            return window.feed(raw) + window.close()
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[word] = found = self.before.get(word) or array("I", self.merges.merge(word.encode())).tobytes()
        return found


class _Window:
    """Merges over a word that arrives bit by bit: holds the bytes whose tokens aren't final."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""

    def feed(self, raw: bytes) -> bytes:
        out = []
        for at in range(0, len(raw), WINDOW):
            self.held += raw[at : at + WINDOW]
            final = len(self.held) - self.merges.lookahead
            if final >= WINDOW:
                end, ids = 0, []
                for i in self.merges.merge(self.held):
                    if end + len(self.merges.bytes[i]) > final:
                        break
                    end += len(self.merges.bytes[i])
                    ids.append(i)
                self.held = self.held[end:]
                out.append(array("I", ids).tobytes())
        return b"".join(out)

    def close(self) -> bytes:
        raw, self.held = self.held, b""
        return array("I", self.merges.merge(raw)).tobytes()


class Encoder:
    """Text in pieces to packed ids (unsigned 32-bit, little-endian), each emitted when it is final."""

    def __init__(self, merges: Merges, words: _Words | None = None):
        self.merges, self.words = merges, _Words(merges) if words is None else words
        self.held, self.open = "", None  # text that isn't parted yet; class of the run that the window holds
        self.window = _Window(merges)

    def feed(self, text: str, last: bool = False) -> bytes:
        text, out = self.held + text, []
        while self.merges.found is not None and (hit := self.merges.found.search(text)):
            out += [self._part(text[: hit.start()], True), array("I", [self.merges.special[hit.group()]]).tobytes()]
            text = text[hit.end() :]
        keep = 0 if last else max((k for k in range(1, min(len(text), max(map(len, self.merges.tails), default=0)) + 1) if text[-k:] in self.merges.tails), default=0)
        out.append(self._part(text[: len(text) - keep], last))
        self.held += text[len(text) - keep :]
        return b"".join(out)

    def _part(self, text: str, last: bool) -> bytes:
        """Parts text into words; what may still change is left in ``held``."""
        out, at, self.held = [], 0, ""
        if self.open is not None:
            at = RUNS[self.open].match(text).end()
            ended = last or at < len(text)
            if self.open == "spaces" and at < len(text) or (not ended and self.open == "spaces"):
                at = max(at - 1, 0)  # the last space may belong to the next word
            out.append(self.window.feed(text[:at].encode()))
            if not ended:
                self.held = text[at:]
                return b"".join(out)
            out.append(self.window.close())
            self.open = None
        if last:
            out += map(self.words.__getitem__, PATTERN.findall(text, at))
            return b"".join(out)
        for hit in PATTERN.finditer(text, at):
            if hit.end() > len(text) - AHEAD:
                break
            out.append(self.words[hit.group()])
            at = hit.end()
        if len(text) - at > max(PIECE, LEAST_RUN):  # one long run: pass it on while it is open
            end = PATTERN.match(text, at).end()
            self.open = next(kind for kind, run in RUNS.items() if run.match(text, at + 1).end() > at + 1)
            if self.open == "spaces":
                end = RUNS["spaces"].match(text, at).end() - 1
            out.append(self.window.feed(text[at:end].encode()))
            at = end
        self.held = text[at:]
        return b"".join(out)


class Decoder:
    """Packed ids in pieces to text, each character emitted when its bytes are complete."""

    def __init__(self, merges: Merges):
        self.bytes, self.machine = merges.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes, last: bool = False) -> str:
        known = self.bytes
        return self.machine.decode(b"".join([known.get(i, b"") for i in memoryview(ids).cast("I")]), last)


def encoded_parts(text: str, merges: Merges, words: _Words) -> Iterator[bytes]:
    """Packed ids of a text, part by part."""
    machine = Encoder(merges, words)
    for at in range(0, len(text), PIECE):
        yield machine.feed(text[at : at + PIECE], at + PIECE >= len(text))


def _merges(spec: str) -> tuple[Merges, _Words]:
    """The vocabulary in this worker, read once."""
    if _state.get("spec") != spec:
        merges = Merges(spec)
        _state.update(spec=spec, merges=merges, words=_Words(merges))
    return _state["merges"], _state["words"]


def _spec(spark, tokenizer: str | None):
    """The vocabulary's file as text, sent to all executors; the driver reads it."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    ship_package(spark)
    arrow_rows(spark)
    with open(tokenizer, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())  # one vocabulary


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def encode(docs: DataFrame, tokenizer: str | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, part, ids): ids of every text in parts of at most PART; a text without ids has one empty part."""
    spec = _spec(docs.sparkSession, tokenizer)

    def run(batches):
        merges, words = _merges(spec.value)
        for batch in batches:
            for row, value in enumerate(_texts(batch.column(1))):
                held, part = b"", 0
                for ids in encoded_parts(value, merges, words):
                    held += ids
                    while len(held) > 4 * PART:
                        yield _part_row(batch, row, part, held[: 4 * PART])
                        held, part = held[4 * PART :], part + 1
                if held or not part:
                    yield _part_row(batch, row, part, held)

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, part int, ids array<int>")


def _part_row(batch: pa.RecordBatch, row: int, part: int, ids: bytes) -> pa.RecordBatch:
    values = pa.Array.from_buffers(pa.int32(), len(ids) // 4, [None, pa.py_buffer(ids)])
    listed = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([part], pa.int32()), listed], ["doc_id", "part", "ids"])


def decode(rows: DataFrame, ids: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """rows with ``decoded``, the text of their array of ids (null: null); a column of that name is replaced."""
    spec = _spec(rows.sparkSession, tokenizer)
    at = rows.columns.index(ids)

    def make():
        merges, _ = _merges(spec.value)
        return lambda batch: [[None if x is None else Decoder(merges).feed(array("I", [i for i in x if i is not None and i >= 0]).tobytes(), True) for x in batch.column(at).to_pylist()]]

    return append_columns(rows, [T.StructField("decoded", T.StringType())], make)


def round_trips(docs: DataFrame, tokenizer: str | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids are decoded part by part, as they come."""
    spec = _spec(docs.sparkSession, tokenizer)

    def run(batches):
        merges, words = _merges(spec.value)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for value in _texts(batch.column(1)):
                count, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(merges)
                for ids in encoded_parts(value, merges, words):
                    count += len(ids) // 4
                    ids_hash.update(ids)
                    text_hash.update(decoder.feed(ids).encode())
                text_hash.update(decoder.feed(b"", True).encode())
                n.append(count)
                of_ids.append(ids_hash.hexdigest())
                of_text.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_bpe_transducer(spark, sf_dir):
    """Contract query over all documents."""
    return round_trips(table(spark, sf_dir, "documents"))
