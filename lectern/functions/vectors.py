"""Vectors: hashed text embeddings and similarity."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import Text, col


def cosine(a: Text, b: Text) -> Column:
    """Cosine similarity in double precision; null where a vector is null, empty or zero."""
    dot = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    return F.when(length > 0, dot / length)


def hash_embed(texts: list[str | None], size: int = 128) -> np.ndarray:
    """Deterministic unit vectors from hashed words and word pairs; empty texts give zero vectors."""
    out = np.zeros((len(texts), size), dtype=np.float32)
    for row, text in enumerate(texts):
        tokens = (text or "").lower().split()
        for unit in [*tokens, *map(" ".join, zip(tokens, tokens[1:]))]:
            h = crc32(unit.encode())
            out[row, h % size] += 1.0 if h & 0x80000000 else -1.0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms > 0)


def embed(text: Text, size: int = 128) -> Column:
    """``hash_embed`` over a column in Arrow batches: the offline embedder, used for texts and questions alike."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(hash_embed(list(part), size)))

    return run(col(text))
