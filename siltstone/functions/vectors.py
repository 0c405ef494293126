"""Vector functions: distances and padding in the JVM, half-precision codec in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    """A query vector as one constant, not an expression per element."""
    return F.from_json(F.lit(str([float(x) for x in vector])), "array<double>")


def l2_distance(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def pad(v: Column, dimension: int) -> Column:
    """Exactly ``dimension`` elements: cut, or filled with zeros."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dimension)), 1, dimension)


def _codec(name: str, out: str, f):
    @F.pandas_udf(out)
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else f(x))

    run.__name__ = name
    return run


def encode_f16(v: Column) -> Column:
    """Little-endian half floats, two bytes an element."""
    return _codec("encode_f16", "binary", lambda x: np.asarray(x, dtype="<f4").astype("<f2").tobytes())(v)


def decode_f16(v: Column) -> Column:
    return _codec("decode_f16", "array<float>", lambda x: np.frombuffer(x, dtype="<f2").astype("<f4"))(v)


def decode_f32(v: Column) -> Column:
    return _codec("decode_f32", "array<float>", lambda x: np.frombuffer(x, dtype="<f4"))(v)


def decode(v: Column, dimension: int) -> Column:
    """Half or single floats, told apart by the length that ``dimension`` gives; other lengths are null."""

    def one(x):
        if len(x) == 2 * dimension:
            return np.frombuffer(x, dtype="<f2").astype("<f4")
        return np.frombuffer(x, dtype="<f4") if len(x) == 4 * dimension else None

    return _codec("decode", "array<float>", one)(v)


def halve(v: Column, dimension: int) -> Column:
    """Blobs of single floats of ``dimension`` become half floats; others, and nulls, stay."""
    return F.when(F.length(v) == 4 * dimension, encode_f16(decode_f32(v))).otherwise(v)
