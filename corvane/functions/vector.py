"""Vector, score and hash functions as columns; codecs that columns can't express as Pandas UDFs."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length, in double precision."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit vector; a zero vector as it is."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def smoothed_idf(documents: Column, frequency: Column) -> Column:
    return F.log((documents + 1.0) / (frequency + 1.0)) + 1.0


def backoff_ms(retries: Column, first_ms: int = 15000) -> Column:
    """15 s, doubled for each of the first four retries."""
    return F.lit(first_ms).cast("long") * F.pow(F.lit(2.0), F.least(retries, F.lit(4))).cast("long")


def average_hash(gray: Column) -> Column:
    """64-bit hash of 64 gray values: bit i is set where value i reaches their mean."""
    mean = F.aggregate(gray, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(gray)
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(gray, i).cast("double") >= mean, F.expr("1L")).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(F.zip_with(bits, F.sequence(F.lit(0), F.lit(63)), lambda b, i: F.call_function("shiftleft", b, i)), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


@F.pandas_udf(T.BinaryType())
def half_encode(v: pd.Series) -> pd.Series:
    """Float vectors as little-endian IEEE half floats, rounded to nearest."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").astype("<f2").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def half_decode(raw: pd.Series, dim: pd.Series) -> pd.Series:
    """Half floats back to floats; what is missing at the end is zero."""

    def one(data, n):
        if data is None or n is None or np.isnan(n):
            return None
        n = int(n)
        got = np.frombuffer(bytes(data)[: 2 * n // 2 * 2], dtype="<f2", count=min(len(data) // 2, n)).astype("<f4")
        return np.concatenate([got, np.zeros(n - len(got), "<f4")])

    return pd.Series([one(d, n) for d, n in zip(raw, dim)])
