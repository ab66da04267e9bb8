"""Vector arithmetic as column expressions."""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("lodestone")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None) -> Column:
    """Cosine similarity in double arithmetic; null for lengths that differ and for zero vectors.

    norm_a: a's norm if it is stored, so that only the dot product is left to compute."""
    divided = F.try_divide(dot(a, b), (norm(a) if norm_a is None else norm_a) * norm(b))
    return F.when(F.size(a) == F.size(b), divided)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector]) if len(vector) else F.array().cast("array<double>")


def cosine_to(query: Sequence[float], column: Column) -> Column:
    """Cosine of each vector to one query, by whole Arrow batches: numpy's dot products are faster
    than expressions over elements when vectors are long. Null as for cosine."""
    q = np.asarray(query, np.float64)
    size = float(np.sqrt(q @ q))

    @F.pandas_udf("double")
    def score(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in vectors:
            fits = v.map(lambda x: x is not None and len(x) == len(q)).to_numpy(bool)
            out = np.full(len(v), np.nan)
            if fits.any():
                m = np.stack(v[fits].to_numpy()).astype(np.float64)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[fits] = (m @ q) / (np.sqrt(np.einsum("ij,ij->i", m, m)) * size)
            yield pd.Series(pd.array(out, dtype="Float64")).mask(~np.isfinite(out))

    return score(column)


@F.pandas_udf(T.ArrayType(T.FloatType(), False))
def from_blob(blobs: pd.Series) -> pd.Series:
    """Vectors from little-endian float32 bytes; null if they aren't whole floats. For imports."""
    broken = sum(b is not None and len(b) % 4 > 0 for b in blobs)
    if broken:
        log.warning("%d vectors are not whole floats", broken)
    return pd.Series([None if b is None or len(b) % 4 else np.frombuffer(b, "<f4") for b in blobs], dtype=object)
