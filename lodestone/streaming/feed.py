"""The change feed: file events bring the store up to date, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import index_files
from ..schema import Config
from ..sources.files import indexable, with_language
from ..sources.providers import ContextProvider, EmbeddingProvider
from ..sources.store import Store


def latest(events: DataFrame, key: str = "file_path", order: str = "ts", *tie: str) -> DataFrame:
    """The last event of each key; an aggregation, so that a hot key is combined before the shuffle."""
    rest = [c for c in events.columns if c not in (key, order, *tie)]
    last = F.max(F.struct(order, *tie, *rest)).alias("last_")
    return events.groupBy(key).agg(last).select(key, *[F.col(f"last_.{c}").alias(c) for c in (order, *tie, *rest)])


def apply_events(store: Store, events: DataFrame, read: Callable[[DataFrame], DataFrame], embedder: EmbeddingProvider, config: Config = Config(), context: ContextProvider | None = None, now: int | None = None, root: str = "") -> None:
    """Applies the last event of each file: created and changed files are read and indexed, deleted
    ones and those that can't be read any more are removed. Again with the same events it changes
    nothing, so a batch that is run twice does no harm.

    read: file_path rows to file_path, length, content. root: the folder that globs are relative to."""
    last = latest(events).select("file_path", "op")
    there = with_language(indexable(read(last.where("op <> 'delete'").select("file_path")), config, root)) if config.index_on_save else None
    if there is None:
        there = with_language(read(last.limit(0).select("file_path")))
        last = last.where("op = 'delete'")
    index_files(store, there, embedder, config, context, removed=last, now=now)


#: The events that were applied: the last of each path in each batch.
APPLIED = "file_path string, ts timestamp, batch long"
#: Batches after which a feed removes what the store has no use for any more.
VACUUM = 100


def in_order(last: DataFrame, applied: DataFrame) -> DataFrame:
    """The last events(file_path, ts, ...) without those that are older than one applied to their path."""
    known = applied.groupBy(F.col("file_path").alias("k_")).agg(F.max("ts").alias("t_"))
    return last.join(known, (F.col("file_path") == F.col("k_")) & (F.col("ts") < F.col("t_")), "left_anti")


def start_feed(
    events: DataFrame, store: Store, read: Callable[[DataFrame], DataFrame], embedder: EmbeddingProvider, checkpoint: str, config: Config = Config(), context: ContextProvider | None = None, once: bool = False,
    root: str = "",
) -> StreamingQuery:
    """A streaming query over events(file_path, op, ts), op being create, change or delete.

    Events are applied in the order of ts also across batches: beside the checkpoint lies a table of
    the last event applied to each path, and one that comes late, older than that, is dropped. A batch
    replaces its own part of it and reads those of earlier batches, so it may run twice. The rest of the
    state is the store's current version; one query per store keeps commits in turn."""
    spark, applied = store.spark, f"{checkpoint.rstrip('/')}-applied"

    def take(batch: DataFrame, number: int) -> None:
        before = spark.createDataFrame([], APPLIED) if number == 0 else spark.read.schema(APPLIED).parquet(applied).where(F.col("batch") < number)
        last = in_order(latest(batch), before)
        apply_events(store, last, read, embedder, config, context, root=root)
        last.select("file_path", "ts").write.mode("overwrite").parquet(f"{applied}/batch={number}")
        if number % VACUUM == VACUUM - 1:
            store.vacuum()

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if once else writer).start()
