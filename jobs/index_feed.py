"""Keeps an index of line windows up to date with a growing folder of documents.

    python -m jobs.index_feed --documents PATH --target PATH --checkpoint PATH [--config FILE]

A file stream takes the Parquet files that came since the last run and ends. Of each document in a batch
whose text is new or has changed, the windows are written, below

    target/batch=<number>/kind=<file or chunk>/language=<language>

a row of kind file for the document, with the hash of its text, and one of kind chunk for each window. A
batch replaces its own folder and reads only those of earlier batches, so one that was interrupted and is
run again by Spark gives the same. `current` is the index as it stands: of each document the rows of the
last batch that had it. A document whose text is null or blank has no chunks, so it loses those it had.
Of several rows of a document in one batch the greatest text counts; rows without doc_id are left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from lodestone.functions.text import tokens
from lodestone.operators.chunker import line_windows

OUTPUT = "file_path string, id string, start_line int, end_line int, content string, content_hash string, n_tokens int, batch long, kind string, language string"


@dataclass(frozen=True)
class Settings:
    lines: int = 20
    overlap: int = 5
    files_per_batch: int = 1000


def documents_as_files(documents: DataFrame) -> DataFrame:
    """file_path, content, language of documents(doc_id, text, lang, source)."""
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none"))
    path = F.concat(F.lit("/"), named("source"), F.lit("/"), named("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.where("doc_id is not null").select(path.alias("file_path"), F.coalesce("text", F.lit("")).alias("content"), named("lang").alias("language"))


def last_files(index: DataFrame) -> DataFrame:
    """file_path, batch, content_hash of the last batch that had each document."""
    last = F.max(F.struct("batch", "content_hash")).alias("last")
    return index.where("kind = 'file'").groupBy("file_path").agg(last).select("file_path", "last.batch", "last.content_hash")


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """One row of each file whose text the known files(file_path, content_hash) have not."""
    one = files.groupBy("file_path").agg(F.max(F.struct("content", "language")).alias("f")).select("file_path", "f.content", "f.language")
    was = known.select(F.col("file_path").alias("was_path"), F.col("content_hash").alias("was"))
    hashed = one.withColumn("content_hash", F.sha2("content", 256))
    return hashed.join(was, F.col("file_path") == F.col("was_path"), "left").where(~F.col("content_hash").eqNullSafe(F.col("was"))).drop("was_path", "was")


def indexed(files: DataFrame, settings: Settings) -> DataFrame:
    """The rows of kind file and of kind chunk of changed files; both come from one shuffle."""
    whole = files.select("file_path", F.lit(None).cast("string").alias("id"), F.lit(0).alias("start_line"), (F.size(F.split("content", "\n", -1)) - 1).alias("end_line"), F.lit(None).cast("string").alias("content"), "content_hash", F.size(tokens(F.col("content"))).alias("n_tokens"), F.lit("file").alias("kind"), "language")
    parts = line_windows(files.select("file_path", "content", "language"), settings.lines, settings.overlap)
    return whole.unionByName(parts.select("file_path", "id", "start_line", "end_line", "content", "content_hash", F.size(tokens(F.col("content"))).alias("n_tokens"), F.lit("chunk").alias("kind"), "language"))


def output(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """All rows, or those of batches before one; none if nothing is written yet."""
    if before == 0:
        return spark.createDataFrame([], OUTPUT)
    rows = spark.read.schema(OUTPUT).parquet(target)
    return rows if before is None else rows.where(F.col("batch") < before)


def current(spark: SparkSession, target: str) -> DataFrame:
    """The index as it stands."""
    rows = output(spark, target)
    last = last_files(rows).select(F.col("file_path").alias("last_path"), F.col("batch").alias("last_batch"))
    return rows.join(last, (F.col("file_path") == F.col("last_path")) & (F.col("batch") == F.col("last_batch")), "left_semi")


def take(batch: DataFrame, number: int, target: str, settings: Settings) -> None:
    """Writes what a batch of documents brings."""
    spark = batch.sparkSession
    todo = changed(documents_as_files(batch), last_files(output(spark, target, number)))
    folder = f"{target}/batch={number}"
    indexed(todo, settings).write.mode("overwrite").partitionBy("kind", "language").parquet(folder)
    own = output(spark, target).where(F.col("batch") == number)
    counts = {r.kind: r.n for r in own.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    log.info("batch %d: %d changed documents, %d chunks written to %s", number, counts.get("file", 0), counts.get("chunk", 0), folder)


def run(spark: SparkSession, documents: str, target: str, checkpoint: str, settings: Settings = Settings()) -> None:
    """Takes what is new in the folder, or file, of documents, and returns when it is written."""
    table = spark.read.parquet(documents)
    log.info("reading %s from %s", table.schema.simpleString(), documents)
    only = f"{documents[:-1]}[{documents[-1]}]"  # a pattern that only it matches: a stream takes no single file by its plain path
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", settings.files_per_batch).parquet(only)
    own = stream.select("doc_id", "text", "lang", "source")
    feed = own.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, n: take(b, n, target, settings)).start()
    try:
        feed.awaitTermination()
    finally:
        feed.stop()
    read = sum(p.numInputRows for p in feed.recentProgress)
    log.info("%d rows of documents were new; the index is in %s", read, target)


if __name__ == "__main__":
    command_line("index_feed", __doc__, ("documents", "target", "checkpoint"), Settings, run)
