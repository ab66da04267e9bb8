"""Answers a table of saved searches: for each item, the documents that hold its most telling words.

    python -m jobs.saved_searches --documents PATH --items PATH --target PATH --work PATH [--config FILE]

documents(doc_id, text, lang), items(item_id, text). The words of an item's text that are rarest in the
documents make its search; documents in which all of them occur are ranked as keyword search ranks
them, and the best are written below

    target/language=<language of the document>

with their place. The dictionary of the documents' terms, the searches that are made of it and the places
of their words are written to the work folder. All folders are replaced as a whole, so running again
gives the same. Null texts have no words; rows without an id are left out; rows that repeat
a doc_id are one document to the ranking, with the greatest language and length, and rows to the dictionary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, log
from lodestone.operators.bulk import bulk_keyword, frequencies, telling_terms, term_counts

OUTPUT = "item_id long, place int, doc_id long, rank double, language string"


@dataclass(frozen=True)
class Settings:
    terms: int = 2
    limit: int = 10


def placed(best: DataFrame, documents: DataFrame) -> DataFrame:
    """The answers with the language of their documents."""
    of = documents.select(F.col("doc_id").alias("of"), F.coalesce(F.nullif("lang", F.lit("")), F.lit("none")).alias("own"))
    met = best.join(of, F.col("doc_id") == F.col("of"))
    return met.groupBy("item_id", "place", "doc_id", "rank").agg(F.max("own").alias("language"))


def run(spark: SparkSession, documents: str, items: str, target: str, work: str, settings: Settings = Settings()) -> None:
    """Writes the answers to all items. What each step finds is written to the work folder for the next."""
    docs, asked = spark.read.parquet(documents), spark.read.parquet(items)
    log.info("read %d documents from %s, %d items from %s", docs.count(), documents, asked.count(), items)
    docs, asked = docs.where("doc_id is not null").select("doc_id", "text", "lang"), asked.select("item_id", "text")

    def step(name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{work}/{name}")
        out = spark.read.schema(rows.schema).parquet(f"{work}/{name}")
        log.info("%s/%s has %d rows", work, name, out.count())
        return out

    known = step("dictionary", frequencies(docs))
    searches = step("searches", telling_terms(asked, known, settings.terms))
    counts = step("counts", term_counts(docs, searches))
    best = bulk_keyword(counts, searches, known.where("term is null"), settings.limit)
    placed(best, docs).write.mode("overwrite").partitionBy("language").parquet(target)
    found = output(spark, target).agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items")).first()
    log.info("wrote %d answers to %d items to %s", found.n, found.items, target)


def output(spark: SparkSession, target: str) -> DataFrame:
    """The answers that were written."""
    return spark.read.schema(OUTPUT).parquet(target)


if __name__ == "__main__":
    command_line("saved_searches", __doc__, ("documents", "items", "target", "work"), Settings, run)
