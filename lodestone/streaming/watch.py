"""A folder and a store: what was created, changed or deleted since the store was last brought up to date."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import Config
from ..sources.files import listed, read_files
from ..sources.providers import ContextProvider, EmbeddingProvider
from ..sources.store import Store
from .feed import apply_events

log = logging.getLogger("lodestone")

SEEN = "file_path string, length long, modified long"


def differences(indexed: DataFrame, seen: DataFrame, now: DataFrame) -> DataFrame:
    """file_path, op of what a listing now(file_path, length, modified) tells: create, change or delete.

    indexed: the file_path of each file that the store has. seen: the listing that was applied last. A
    file whose length and time are those seen is left alone; a file of the store that is listed no more
    is deleted, whatever was seen, so a lost or partial listing of before costs work and nothing else."""
    have = indexed.select(F.col("file_path").alias("have")).distinct()
    gone = have.join(now, F.col("have") == F.col("file_path"), "left_anti").select(F.col("have").alias("file_path"), F.lit("delete").alias("op"))
    was = seen.select(F.col("file_path").alias("p_"), F.col("length").alias("l_"), F.col("modified").alias("m_"))
    new = now.join(was, (F.col("file_path") == F.col("p_")) & F.col("length").eqNullSafe(F.col("l_")) & F.col("modified").eqNullSafe(F.col("m_")), "left_anti")
    op = F.when(F.col("have").isNull(), "create").otherwise("change")
    return new.join(have, F.col("file_path") == F.col("have"), "left").select("file_path", op.alias("op")).unionByName(gone)


def tasks_for(files: int, cores: int) -> int:
    """Tasks that open some files: one for each if they are few, a thousand files each if they are many."""
    return max(1, min(files, max(8 * cores, files // 1000)))


def sync_folder(store: Store, root: str, seen: str, embedder: EmbeddingProvider, config: Config = Config(), context: ContextProvider | None = None, now: int | None = None) -> dict[str, int]:
    """Brings a store up to date with the files below a folder, and tells how many it created, changed and
    deleted. Only these are opened. seen: a folder for the listing that was applied last; it is
    replaced after the store has its new version, so what is interrupted is done again. Every file of the
    store counts as one of this folder's."""
    spark = store.spark
    there = listed(spark, root, config).select("file_path", "length", "modified")
    before = spark.read.schema(SEEN).parquet(seen) if _exists(store, seen) else spark.createDataFrame([], SEEN)
    events = differences(store.chunks().select("file_path"), before, there).withColumn("ts", F.current_timestamp())
    counts = {r.op: r.n for r in events.groupBy("op").agg(F.count("*").alias("n")).collect()}
    if counts:
        tasks = tasks_for(sum(counts.values()), spark.sparkContext.defaultParallelism)
        apply_events(store, events, lambda paths: read_files(paths, tasks), embedder, config, context, now, root=root)
    there.write.mode("overwrite").parquet(seen)
    log.info("%s: %s", root, counts or "nothing new")
    return counts


def _exists(store: Store, path: str) -> bool:
    fs, p = store._fs(path)
    return fs.exists(p)


def watch_folder(store: Store, root: str, seen: str, embedder: EmbeddingProvider, every: str = "30 seconds", config: Config = Config(), context: ContextProvider | None = None) -> StreamingQuery:
    """A streaming query that brings the store up to date again and again. Its source is a clock and its
    state the listing that was applied last, so it needs no checkpoint of its own; a batch that comes
    late finds all that has happened meanwhile."""
    clock = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.trigger(processingTime=every).foreachBatch(lambda _, n: sync_folder(store, root, seen, embedder, config, context)).start()
