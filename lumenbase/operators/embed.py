"""Embedders: an interface, and a deterministic hashed-token default (no models are available offline).

Results of the default are not comparable with those of a trained model; pass another function for one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_tokens(texts: list[str], size: int) -> np.ndarray:
    """Unit vectors of signed token counts."""
    out = np.zeros((len(texts), size), np.float32)
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[i, h % size] += 1.0 if h >> 31 else -1.0
    lengths = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(lengths > 0, lengths, 1)


def embedded(rows: DataFrame, key: str, text: str, size: int = 384, model=hashed_tokens) -> DataFrame:
    """(key, embedding) of rows whose text is not empty; ``model`` maps texts and a size to a matrix."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "embedding": list(model(frame[text].tolist(), size))})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).where(F.length(F.trim(text)) > 0).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def missing(rows: DataFrame, stored: DataFrame, key: str, text: str, size: int = 384, model=hashed_tokens) -> DataFrame:
    """Embeddings of rows that the store lacks."""
    return embedded(rows.join(stored.select(key), key, "left_anti"), key, text, size, model)
