"""The nearest vectors of many vectors at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored_once

#: Bytes of queries, in double precision, that are sent to the vectors at a time.
SENT = 64 << 20


def _unit(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have this many dimensions and a length, and these, scaled to length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    fits = np.asarray(column.is_valid()) & (sizes == dims)
    chosen = column.filter(pa.array(fits))
    m = chosen.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    size = np.sqrt(np.einsum("ij,ij->i", m, m))
    good = np.isfinite(size) & (size > 0)
    at = np.flatnonzero(fits)[good]
    return at, m[good] / size[good, None]


def _best(keys: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of keys and similarities the k best, ties by key."""
    order = np.lexsort((keys, -sims), axis=1)[:, :k]
    return np.take_along_axis(keys, order, 1), np.take_along_axis(sims, order, 1)


def _against(q_keys: np.ndarray, q: np.ndarray, k: int, key: str, other: str):  # noqa: ANN202
    """A task of (key, vector) to its k best for each query: a heap for each, merged batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.zeros((len(q), 0), np.int64)
        sims = np.zeros((len(q), 0))
        for b in batches:
            at, m = _unit(b.column(1), q.shape[1])
            own = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(at), 1024):
                ids = own[at[i : i + 1024]].astype(np.int64)
                found = q @ m[i : i + 1024].T
                found[q_keys[:, None] == ids[None, :]] = -np.inf  # itself
                if found.shape[1] > 4 * k:  # what is surely not among the best goes before the sort
                    least = np.partition(found, -k, axis=1)[:, -k]
                    floor = np.maximum(least, sims[:, -1] if sims.shape[1] == k else -np.inf)
                    some = (found >= floor[:, None]).any(axis=0)
                    ids, found = ids[some], found[:, some]
                keys, sims = _best(np.hstack([keys, np.broadcast_to(ids, found.shape)]), np.hstack([sims, found]), k)
        there = np.isfinite(sims)
        rows = np.repeat(np.arange(len(q)), there.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(q_keys[rows]), pa.array(keys[there]), pa.array(sims[there])], [key, other, "similarity"])

    return run


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int, key: str = "id", other: str = "other", sent: int = SENT) -> DataFrame:
    """key, other, similarity, place: the k vectors most similar by cosine to each query, all of
    vectors(key, embedding) against all of queries(key, embedding), itself left out; ties by key.

    Queries are numbered and sent to the vectors in blocks of `sent` bytes at most, each block in a scan of its
    own, so what is sent doesn't grow with the tables. A task multiplies whole batches and keeps k rows for
    each query; these are ranked at the end, the best of each task first. Keys are integers. Vectors
    that are null, of length zero, or of another number of dimensions than the first query are left
    out; queries like that have no neighbours. Rows that repeat a key are vectors of their own, but a query's
    own key is left out in all of them; of queries that repeat a key the one with the greatest vector counts."""
    spark = vectors.sparkSession
    of = queries.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).groupBy(key).agg(F.max("embedding").alias("embedding"))
    first = of.orderBy(key).select(F.size("embedding").alias("n")).first()
    schema = f"{key} long, {other} long, similarity double"
    out = spark.createDataFrame([], schema)
    if first is not None and first.n:
        block = max(1, sent // (8 * first.n))
        blocks = -(-of.count() // block)
        # by a hash, so that no order of all queries is needed; a block is a little more or less than meant
        numbered = stored_once(of.withColumn("block_", F.pmod(F.xxhash64(key), F.lit(blocks))))
        own = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))
        for i in range(blocks):
            table = numbered.where(F.col("block_") == i).select(F.col(key).cast("bigint"), F.col("embedding").cast("array<double>")).toArrow().combine_chunks()
            if not table.num_rows:
                continue
            at, q = _unit(table.column(1), first.n)
            if len(at):
                out = out.unionByName(own.mapInArrow(_against(table.column(0).to_numpy()[at], q, k, key, other), schema))
    w = Window.partitionBy(key).orderBy(F.desc("similarity"), other)
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
