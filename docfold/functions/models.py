"""Models as functions on columns: what a remote service would answer is passed in.

A model is a function from a list of texts to a list of results, run batch by batch in tasks.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that one call of a model gets.
BATCH = 16


def embedded(text: Column, model: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> Column:
    """A vector for each text, in order; a null text counts as empty."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [t or "" for t in texts.to_pylist()]
        out = [v for at in range(0, len(rows), batch) for v in model(rows[at : at + batch])]
        return pa.array(out, pa.list_(pa.float32()))

    return run(text)


def hashed_vectors(texts: list[str], size: int = 64) -> list[list[float]]:
    """Vectors of unit length that depend on the words of a text alone; a stand-in that needs no network."""
    out = []
    for text in texts:
        v = [0.0] * size
        for word in text.lower().split():
            at, sign = struct.unpack("<IB", hashlib.blake2b(word.encode(), digest_size=5).digest())
            v[at % size] += 1.0 if sign & 1 else -1.0
        length = sum(x * x for x in v) ** 0.5
        out.append([x / length for x in v] if length else v)
    return out
