"""Vector expressions on array columns, in double precision."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(_doubles(a), lambda x: x / n)).otherwise(_doubles(a))


def star(vector: str) -> tuple[Column, Column]:
    """x, y of a whole vector in star coordinates: each component pulls along its own direction, all spread around a circle
    (two components at a right angle)."""
    v = _doubles(F.col(vector))
    n = F.size(vector)
    pull = lambda f: _sum(F.transform(v, lambda x, i: x * f(2 * math.pi * i / F.greatest(n, F.lit(4))))) / F.sqrt(n / 2)
    return pull(F.cos), pull(F.sin)


def multimodal(image: Column, text: Column) -> Column:
    return F.concat(unit(image), unit(text))


def similarity(distance: Column) -> Column:
    return F.lit(1.0) - distance


def to_bytes(vector: Column | str) -> Column:
    """Little-endian single-precision bytes."""

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(vector)


def from_bytes(blob: Column | str) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return unpack(blob)


def to_text(vector: Column | str) -> Column:
    """A vector as a JSON list."""
    return F.to_json(F.col(vector) if isinstance(vector, str) else vector)


def from_text(text: Column | str) -> Column:
    """Null for text that is no list of numbers."""
    return F.from_json(F.col(text) if isinstance(text, str) else text, "array<float>")


def to_base64(vector: Column | str) -> Column:
    """The single-precision bytes as Base64 text."""
    return F.base64(to_bytes(vector))


def from_base64(text: Column | str) -> Column:
    return from_bytes(F.unbase64(F.col(text) if isinstance(text, str) else text))
