"""Vector arithmetic on array columns, and the deterministic embedders."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# Seeds of the generator where the text's digest gives none.
SEED_64, SEED_32 = 0x9E3779B97F4A7C15, 0x7F4A7C15


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; 0 for vectors of unequal length or without direction."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(F.greatest(F.least(F.try_divide(dot(a, b), n), F.lit(1.0)), F.lit(-1.0)))


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance_score(distance: Column) -> Column:
    return 1 / (1 + distance)


def cosine_similarity_of_distance(distance: Column) -> Column:
    return F.greatest(F.least(1 - distance, F.lit(1.0)), F.lit(0.0))


def unit_cosine_of_l2(distance: Column) -> Column:
    return F.greatest(F.least(1 - distance / 2, F.lit(1.0)), F.lit(0.0))


def fit_dims(v: Column, dims: int) -> Column:
    """The first ``dims`` values, zeros appended where there are fewer."""
    return F.concat(F.slice(v, 1, dims), F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dims) - F.size(v), F.lit(0))))


def pack(v: Column) -> Column:
    """32-bit floats in little-endian order as bytes."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(v)


def unpack(v: Column) -> Column:
    """The inverse of ``pack``; null for bytes that are no whole floats."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or len(x) % 4 else np.frombuffer(x, "<f4").tolist())

    return run(v)


def _unit_rows(v: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.sum(v * v, axis=1, keepdims=True, dtype=np.float32))
    return np.divide(v, n, out=v, where=n > 0)


def _digests(texts: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(t.encode()).digest() for t in texts), np.uint8).reshape(-1, 32)


def hash_embeddings(texts: list[str], dims: int) -> np.ndarray:
    """Unit vectors drawn by 32-bit xorshift generators that the texts' SHA-256 seed, one step of all texts at a time."""
    seed = _digests(texts)[:, :8].copy().view("<u8").ravel()
    seed[seed == 0] = SEED_64
    state = ((seed ^ (seed >> np.uint64(32))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    state[state == 0] = SEED_32
    bits = np.empty((dims, len(texts)), np.uint32)
    for row in bits:
        state ^= state << np.uint32(13)
        state ^= state >> np.uint32(17)
        state ^= state << np.uint32(5)
        row[:] = 0x3F800000 | (state & np.uint32(0x7FFFFF))
    return _unit_rows(np.ascontiguousarray((bits.view(np.float32) * np.float32(2) - np.float32(3)).T))


def digest_embeddings(texts: list[str], dims: int) -> np.ndarray:
    """The 32 bytes of each text's SHA-256 summed into ``dims`` buckets, as unit vectors."""
    v = np.zeros((dims, len(texts)), np.float32)
    np.add.at(v, np.arange(32) % dims, _digests(texts).T.astype(np.float32))
    return _unit_rows(np.ascontiguousarray(v.T))


def embed(text: Column, dims: int = 384, method: str = "hash") -> Column:
    """Embedding of a text without a model; null for null."""
    many = hash_embeddings if method == "hash" else digest_embeddings

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        has = s.notna()
        out[has] = pd.Series(list(many(s[has].tolist(), dims)), index=s.index[has], dtype=object)
        return out

    return run(text)
