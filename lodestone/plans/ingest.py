"""Indexing: files to chunks, to what changed, to embeddings, to a new version of the table."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup
from ..operators.chunker import cut_files, file_hash
from ..schema import CHUNK, Config
from ..sources.providers import ContextProvider, EmbeddingProvider, context_of, embed_column, embedder_of, enrich
from ..sources.scratch import DENSE, NO_LEFTOVERS, settings, shared_dir
from ..sources.store import KEPT, Store

#: Bytes of files that Spark hands to Python at once, beside one that is larger by itself.
FEW_FILES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

log = logging.getLogger("lodestone")


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[Callable[[], list]]:
    """Jobs in the block carry the tag; calling what the block is given, from any thread, cancels them."""
    spark.addTag(tag)
    try:
        yield lambda: spark.interruptTag(tag)
    finally:
        spark.removeTag(tag)


def prepared(chunks: DataFrame, embedder: EmbeddingProvider, context: ContextProvider | None, config: Config, now: int, failed: Accumulator | None = None) -> DataFrame:
    """New chunks as rows of the table: enriched if wanted, embedded by the enriched text or else the
    content; those whose embedding fails are dropped. Both are asked once for each row: Spark takes
    them for not deterministic, so the last filter stays above."""
    if config.enable_context and context is not None:
        c = enrich(chunks, context, config.context_prompt, config.context_batch_size)
        fields = {k: F.col(f"context.{k}") for k in ("summary", "purpose", "related_concepts", "usage_patterns", "dependencies")}
        chunks = c.withColumns({"enriched_context": F.col("context.full_context"), **fields}).drop("context", "related")
    else:
        chunks = chunks.withColumn("enriched_context", F.lit(None).cast("string"))
    text = F.coalesce(F.nullif("enriched_context", F.lit("")), F.col("content"))
    out = chunks.withColumns({"embedding": embed_column(embedder, text, config.batch_size, failed), "created_at": F.lit(now), "updated_at": F.lit(now)})
    known = out.columns
    own = CHUNK.fields + ([KEPT["file_hash"]] if "file_hash" in known else [])
    return out.select(*[F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in own]).where("embedding is not null")


_busy: set[str] = set()


@contextmanager
def single_flight(name: str) -> Iterator[None]:
    """One indexing of a store at a time in this process; the store itself refuses those of others."""
    if name in _busy:
        raise RuntimeError(f"{name} is being indexed already")
    _busy.add(name)
    try:
        yield
    finally:
        _busy.discard(name)


def index_files(
    store: Store, files: DataFrame, embedder: EmbeddingProvider | None = None, config: Config = Config(), context: ContextProvider | None = None, removed: DataFrame | None = None,
    now: int | None = None, progress: Callable[[str], None] | None = None, tag: str = "lodestone-index",
) -> int:
    """Brings the store up to date with files(file_path, content, language), a row for each path, and
    without removed ones.

    The files are read once; those whose hash the store has are neither cut nor written, and if there are
    no others, there is no new version. The others are cut into a table in the shared folder; a lost
    executor doesn't make them be read again. Only chunks whose hash is new are enriched and embedded, each once; unchanged
    ones keep their rows. A file without chunks loses its old ones. Only the buckets of these files
    are rewritten. Without a provider the configured one is used. progress is told each step; jobs
    carry the tag, by which they can be cancelled, and a cancelled indexing changes nothing."""
    spark, tell = store.spark, progress or log.info
    embedder, context = embedder or embedder_of(config), context or context_of(config)
    now = int(time.time() * 1000) if now is None else now
    began, scratch = time.perf_counter(), f"{shared_dir(spark)}/lodestone-cut-{uuid.uuid4().hex}"
    with single_flight(store.root), cancellable(spark, tag):
        base = store.state()
        try:
            tell("reading and cutting files")
            if base.at:
                known = store.digests(base).select(F.col("file_path").alias("k_"), F.col("file_hash").alias("h_"))
                own = file_hash(F.col("content"), config.chunk_size, config.chunk_overlap)
                files = files.join(known, F.col("file_path") == F.col("k_"), "left").withColumn("same", own.eqNullSafe(F.col("h_"))).drop("k_", "h_")
            cut = cut_files(files, config.chunk_size, config.chunk_overlap)
            with settings(cut.sparkSession, NO_LEFTOVERS | FEW_FILES):
                cut.write.options(**DENSE).parquet(scratch)
            cut = spark.read.schema(cut.schema).parquet(scratch)
            paths = cut.where("id is null and file_hash is not null").select("file_path")
            same = cut.where("id is null and file_hash is null").select("file_path")
            gone = (paths if removed is None else paths.unionByName(removed.select("file_path").join(same, "file_path", "left_anti"))).distinct()
            touched = store.buckets_of(gone, base)
            if not touched:
                return base.number
            old, new = store.chunks(base, touched).select(*KEPT.fieldNames()), cut.where("id is not null")
            tell(f"embedding what is new in {len(touched)} of {base.buckets} buckets")
            failed = spark.sparkContext.accumulator(0)
            fresh = prepared(lookup.to_process(old.select("id", "content_hash"), new), embedder, context, config, now, failed)
            again = new.select(F.col("id").alias("n_id"), F.col("content_hash").alias("n_hash"), F.col("file_hash").alias("n_file"))
            same = old.join(again, (F.col("id") == F.col("n_id")) & (F.col("content_hash") == F.col("n_hash"))).withColumn("file_hash", F.col("n_file")).select(*KEPT.fieldNames())
            version = store.write(lookup.delete_files(old, gone).unionByName(same).unionByName(fresh), touched, base)
        finally:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if failed.value:
        log.warning("%d chunks could not be embedded and are left out until they are indexed again", failed.value)
    tell(f"indexed to version {version} in {time.perf_counter() - began:.1f} s")
    return version


def index_if_empty(store: Store, files: Callable[[], DataFrame], embedder: EmbeddingProvider | None = None, config: Config = Config(), context: ContextProvider | None = None) -> bool:
    """Indexes at first use: only if the store has no chunk, and only then are the files listed."""
    if not store.chunks().isEmpty():
        return False
    index_files(store, files(), embedder, config, context)
    return True


def reindex(store: Store, files: DataFrame, embedder: EmbeddingProvider | None = None, config: Config = Config(), context: ContextProvider | None = None) -> int:
    """Drops everything and indexes anew."""
    store.clear()
    return index_files(store, files, embedder, config, context)
