"""WordPiece tokenisation as a Pandas UDF (Unicode decomposition has no SQL function)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SEQUENCE = 256


def read_vocabulary(lines) -> dict[str, int]:
    """Piece -> id: a line's number, but a line seen before gets the size of the map at that time."""
    vocabulary: dict[str, int] = {}
    for line in lines:
        vocabulary[line] = len(vocabulary)
    return vocabulary


def load_vocabulary(spark, path: str) -> dict[str, int]:
    """A vocabulary file of one piece a line, read by the driver through Spark's file systems."""
    return read_vocabulary(spark.read.format("binaryFile").load(path).first()["content"].decode("utf-8").splitlines())


_MARKS = regex.compile(r"[\p{Mn}\p{Mc}]+")
REMEMBERED = 1 << 17


def words(text: str) -> list[str]:
    """Lower-cased words without combining marks; punctuation stays."""
    lowered = text.lower()
    return lowered.split() if lowered.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", lowered)).split()


class WordPieces(dict):
    """Ids of a word's pieces, the longest first, in time linear in the word; one unknown id if any part has none.

    Pieces are two tries, of word beginnings and of the rest (``##``). Where a trie has no way on, the pieces
    that are certain by then are told (``tell``), and matching goes on at the node of what is left of the word
    (``fail``): so no character is looked at again. Ids of words are remembered, up to a number of words.
    """

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary, self.unknown = vocabulary, vocabulary.get("[UNK]", 100)
        self.step: list[dict[str, int]] = [{}, {}]  # children by character; node 0 begins words, node 1 the rest
        self.fail: list[int | None] = [None, None]
        self.tell: list[list[int]] = [[], []]
        ends: list[int | None] = [None, None]
        for piece, number in vocabulary.items():
            for root, body in [(0, piece)] + [(1, piece[2:])] * piece.startswith("##"):
                node = root
                for c in body:
                    if c not in self.step[node]:
                        self.step[node][c] = len(self.step)
                        self.step.append({})
                        ends.append(None)
                        self.fail.append(None)
                        self.tell.append([])
                    node = self.step[node][c]
                if body:
                    ends[node] = number
        open_ = [0, 1]
        while open_:  # shorter prefixes first
            wider = []
            for node in open_:
                for c, child in self.step[node].items():
                    wider.append(child)
                    if ends[child] is not None:
                        self.fail[child], self.tell[child] = 1, [ends[child]]
                        continue
                    at, told = self.fail[node], list(self.tell[node])
                    while at is not None and c not in self.step[at]:
                        told += self.tell[at]
                        at = self.fail[at]
                    if at is not None:
                        self.fail[child], self.tell[child] = self.step[at][c], told
            open_ = wider

    def __missing__(self, word: str) -> list[int]:
        found, node = [], 0
        for c in word:
            while c not in self.step[node]:
                if self.fail[node] is None:
                    return self._keep(word, [self.unknown])
                found += self.tell[node]
                node = self.fail[node]
            node = self.step[node][c]
        while node > 1:
            if self.fail[node] is None:
                return self._keep(word, [self.unknown])
            found += self.tell[node]
            node = self.fail[node]
        return self._keep(word, found)

    def _keep(self, word: str, ids: list[int]) -> list[int]:
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


def token_ids(text: str | None, vocabulary: dict[str, int] | WordPieces, most: int = MAX_SEQUENCE) -> list[int] | None:
    """[CLS] pieces [SEP], cut so that [SEP] stays, padded to ``most``."""
    if text is None:
        return None
    pieces = vocabulary if isinstance(vocabulary, WordPieces) else WordPieces(vocabulary)
    known, inner = pieces.vocabulary, []
    for word in words(text):
        inner += pieces[word]
        if len(inner) >= most - 2:
            break
    ids = [known.get("[CLS]", 101), *inner[: most - 2], known.get("[SEP]", 102)]
    return ids + [known.get("[PAD]", 0)] * (most - len(ids))


def normalised(text: Column) -> Column:
    """The words of a text, lower-cased and without combining marks."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else words(t))

    return split(text)


def wordpiece_ids(df: DataFrame, column: str, vocabulary: dict[str, int], most: int = MAX_SEQUENCE) -> Column:
    """Column of ids; the vocabulary (a fixed file) is broadcast once."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = WordPieces(shared.value)
        for texts in batches:
            yield texts.map(lambda t: token_ids(t, pieces, most))

    return encode(F.col(column))


def word_pieces(df: DataFrame, column: str, vocabulary: dict[str, int]) -> Column:
    """Column of the ids of all words of a text, neither cut nor padded, without marks of its ends."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = WordPieces(shared.value)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else [i for w in words(t) for i in pieces[w]])

    return encode(F.col(column))


def attention_mask(ids: Column, pad: int = 0) -> Column:
    """1 for every position up to the last that is no padding."""
    return F.transform(ids, lambda i: F.when(i == pad, 0).otherwise(1))
