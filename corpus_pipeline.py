"""A corpus pipeline of the training-data operators: toxicity, exact and near copies, benchmark
passages, mixing. Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents.

Rows are judged, not ids: a row goes by its own text, also if other rows have its doc_id or none. A row
with a null doc_id is judged by its text where texts are judged, and never dropped as a copy. Rows that
repeat a doc_id and its text share a verdict. Other columns pass through, whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, exact_dedup, mixing, simhash, toxicity
from lodestone.llm.common import table, written
from lodestone.shipping import shipped


def _without(docs: DataFrame, key: Column, dropped: DataFrame, by_id: bool = True) -> DataFrame:
    """docs without the rows whose doc_id and key, or key alone, are among the dropped(doc_id, key).

    Never by a broadcast: files of copies, which repeat their keys, are many times smaller than their rows."""
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"))
    gone = dropped.select(*([F.col("doc_id").alias("gone_id")] if by_id else []), F.col("key").alias("gone_key")).distinct()
    same = F.col("key") == F.col("gone_key")
    return own.join(gone.hint("merge"), same & (F.col("row.doc_id") == F.col("gone_id")) if by_id else same, "left_anti").select("row.*")


def _text_key(docs: DataFrame) -> Column:
    return F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)


@shipped
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.5 or more go."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(model)(docs["text"]) < 0.5)


@shipped
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    gone = exact_dedup.exact_dedup(docs).where("not kept and doc_id is not null").withColumnRenamed("text_sha256", "key")
    return _without(docs, exact_dedup.normalised_sha256(docs["text"]), gone)


@shipped
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, at 3 bits and over shingles of 3 words as the contract
    of the operator says, the one with the smallest doc_id stays; of several texts of that id the one
    with the smallest fingerprint."""
    judged = written(simhash.near_duplicates(docs.select("doc_id", "text", _text_key(docs).alias("key")), carry=["key"]).where("doc_id is not null"))
    heads = judged.where("doc_id = component_id").select("doc_id", "key", F.struct("fingerprint", "key").alias("rank"))
    ties = heads.groupBy("doc_id").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).where("least <> most").select(F.col("doc_id").alias("of"), "least")
    beaten = heads.join(ties.hint("merge"), (F.col("doc_id") == F.col("of")) & (F.col("rank") > F.col("least"))).select("doc_id", "key")
    return _without(docs, _text_key(docs), judged.where("doc_id <> component_id").select("doc_id", "key").unionByName(beaten))


@shipped
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of whose words a twentieth or more lies in benchmark windows go."""
    found = decontaminate.decontaminate(docs.select(_text_key(docs).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, _text_key(docs), found.where("contaminated").withColumnRenamed("doc_id", "key"), by_id=False)


@shipped
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the weights of their sources draw them, with the pass and the place in it."""
    return mixing.draw(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("decontaminate", drop_contaminated), ("mix", mix)]
#: The scores of the first stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
