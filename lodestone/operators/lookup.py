"""Lookups, change detection and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.where(F.col("id") == chunk_id)


def hashes_of_file(chunks: DataFrame, file_path: str) -> DataFrame:
    """id, content_hash of a file's chunks."""
    return chunks.where(F.col("file_path") == file_path).select("id", "content_hash")


def exists_with_hash(chunks: DataFrame, chunk_id: str, content_hash: str) -> bool:
    return not chunks.where((F.col("id") == chunk_id) & (F.col("content_hash") == content_hash)).limit(1).isEmpty()


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, state of two versions(id, content_hash): new, changed, unchanged or removed."""
    was, now = old.select(F.col("id").alias("old_id"), F.col("content_hash").alias("old_hash")), new.select(F.col("id").alias("new_id"), F.col("content_hash").alias("new_hash"))
    met = was.join(now, F.col("old_id") == F.col("new_id"), "full_outer")
    state = F.when(F.col("old_id").isNull(), "new").when(F.col("new_id").isNull(), "removed").when(F.col("old_hash").eqNullSafe(F.col("new_hash")), "unchanged").otherwise("changed")
    return met.select(F.coalesce("new_id", "old_id").alias("id"), state.alias("state"))


def to_process(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of the new version that are not in the old one with the same content_hash."""
    known = old.select(F.col("id").alias("old_id"), F.col("content_hash").alias("old_hash"))
    return new.join(known, (new["id"] == F.col("old_id")) & new["content_hash"].eqNullSafe(F.col("old_hash")), "left_anti")


def removed_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("id").join(new.select("id"), "id", "left_anti")


def merge(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """The table after files(file_path) were indexed anew to the rows of new: unchanged rows stay as
    they are, changed and new ones are put, and rows of these files that are gone are dropped, also
    those of files without any chunk left. Applied twice it gives the same."""
    touched = old.join(files.select("file_path").distinct(), "file_path", "left_semi")
    others = old.join(files.select("file_path").distinct(), "file_path", "left_anti")
    put = to_process(touched, new)
    same = touched.join(new.select(F.col("id").alias("n_id"), F.col("content_hash").alias("n_hash")), (F.col("id") == F.col("n_id")) & F.col("content_hash").eqNullSafe(F.col("n_hash")), "left_semi")
    return others.unionByName(same).unionByName(put)


def delete_files(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files.select("file_path").distinct(), "file_path", "left_anti")


def stats(chunks: DataFrame, size: Column | None = None) -> DataFrame:
    """One row: total_chunks, total_files, last_indexed (null if never), database_size."""
    return chunks.agg(
        F.count("*").alias("total_chunks"),
        F.countDistinct("file_path").alias("total_files"),
        F.timestamp_millis(F.nullif(F.max("updated_at"), F.lit(0))).alias("last_indexed"),
    ).withColumn("database_size", (F.lit(0) if size is None else size).cast("bigint"))
