"""Vector expressions and codecs. Expressions stay in the JVM; packing works on Arrow batches in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType, StringType


def _fold(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def l2_squared(a: Column, b: Column) -> Column:
    """Sum of squared differences, in double, from left to right; null if a side is null or the lengths differ."""
    d = _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
    return F.when(F.size(a) == F.size(b), d)


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def inner_product_u32(a: Column, b: Column) -> Column:
    """Inner product of unsigned 32-bit integers modulo 2**32."""
    m = F.lit(2**32)
    # (x * y) mod 2**32 by 16-bit halves keeps products within a long
    mul = lambda x, y: F.pmod(F.pmod(x * F.shiftright(y, 16), m) * F.lit(65536) + x * y.bitwiseAND(F.lit(65535)), m)
    return F.aggregate(F.zip_with(a.cast("array<bigint>"), b.cast("array<bigint>"), mul), F.lit(0).cast("bigint"), lambda s, v: F.pmod(s + v, m))


def pca_project(v: Column, mean: list[float], axes: list[list[float]]) -> Column:
    """Projection of a vector onto given axes after centring."""
    c = F.zip_with(v, F.array(*map(F.lit, mean)), lambda x, m: x.cast("double") - m)
    return F.array(*(_fold(F.zip_with(c, F.array(*map(F.lit, a)), lambda x, y: x * y)) for a in axes))


@pandas_udf(StringType())
def hash_floats(v: pd.Series) -> pd.Series:
    """SHA-256 (hex) of a vector's little-endian float32 bytes."""
    return v.map(lambda x: None if x is None else hashlib.sha256(np.asarray(x, "<f4").tobytes()).hexdigest())


@pandas_udf(ArrayType(LongType()))
def pack_floats(v: pd.Series) -> pd.Series:
    """float32 components as 64-bit little-endian words, two to a word, the last one padded with zero."""

    def one(x):
        if x is None:
            return None
        raw = np.asarray(x, "<f4").tobytes()
        return np.frombuffer(raw + b"\0" * (-len(raw) % 8), "<i8")

    return v.map(one)


def unpack_words(words: np.ndarray, dim: int) -> np.ndarray:
    """(n, dim) float32 vectors of an entry's words, without the zero vectors that pad its end.

    dim has to be positive and even, and the words a whole number of vectors."""
    if dim <= 0 or dim % 2 or len(words) == 0 or len(words) % (dim // 2):
        raise ValueError(f"{len(words)} words are no vectors of dimension {dim}")
    x = np.ascontiguousarray(words, "<i8").view("<f4").reshape(-1, dim)
    used = np.flatnonzero(x.any(1))
    return x[: used[-1] + 1 if len(used) else 0]


def pack_vertex(vector: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """Words of a vertex: float32 vector, then uint32 neighbours; their number together has to be even."""
    if (len(vector) + len(neighbours)) % 2:
        raise ValueError("vector and neighbours have an odd length together")
    return np.frombuffer(np.asarray(vector, "<f4").tobytes() + np.asarray(neighbours, "<u4").tobytes(), "<i8")


def unpack_vertex(words: np.ndarray, dim: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.ascontiguousarray(words, "<i8").tobytes()
    return np.frombuffer(raw[: 4 * dim], "<f4"), np.frombuffer(raw[4 * dim : 4 * (dim + m)], "<u4").astype(np.int64)
