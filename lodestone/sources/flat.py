"""Exchange with flat tables: lists as JSON text, vectors as little-endian float32 bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import from_blob
from ..schema import CHUNK

_LISTS = ("related_concepts", "usage_patterns", "dependencies")


@F.pandas_udf(T.BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else struct.pack(f"<{len(v)}f", *v))


def to_flat(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows without vectors, lists as JSON, and the vectors as (chunk_id, embedding bytes)."""
    rows = chunks.drop("embedding", "norm", "dl").withColumns({c: F.to_json(c) for c in _LISTS})
    return rows, chunks.select(F.col("id").alias("chunk_id"), to_blob("embedding").alias("embedding"))


def from_flat(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks of both tables; a vector that is no whole number of floats is null, and chunks without
    one are left out. Rows of an older form, without content_hash, get their id for it."""
    if "content_hash" not in rows.columns:
        rows = rows.withColumn("content_hash", F.lit(None).cast("string"))
    rows = rows.withColumns({c: F.from_json(c, "array<string>") for c in _LISTS})
    rows = rows.withColumn("content_hash", F.coalesce(F.nullif("content_hash", F.lit("")), F.col("id")))
    joined = rows.join(vectors.select("chunk_id", from_blob("embedding").alias("embedding")), F.col("id") == F.col("chunk_id")).where("embedding is not null")
    return joined.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CHUNK.fields])
