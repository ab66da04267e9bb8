"""Exact deduplication by distributed MSD radix partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SQL_LOWER, UPPER, narrow, table, written

#: Bytes of the first digit, and by how much each following digit is longer.
FIRST_DIGIT, GROWTH = 64, 8


def normalised_sha256(text: Column) -> Column:
    """The sha256 that exact_dedup gives, of a column of texts."""

    @F.pandas_udf("string")
    def sha(texts: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256((t or "").encode().lower()).hexdigest() for t in texts], dtype=object)

    return sha(text)


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, sha, rest): the text with A-Z lower-cased, as bytes."""
    for b in batches:
        low = pc.ascii_lower(pc.fill_null(b.column(1).cast(pa.large_string()), "")).cast(pa.large_binary())
        sha = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in low], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), sha, low.cast(pa.binary())], ["doc_id", "sha", "rest"])


def _split(rows: DataFrame, digit: int) -> DataFrame:
    """rows(parent, rest, ...) with the digit, the first bytes of rest, and whether rest ends in it."""
    return rows.withColumns({"digit": F.substring("rest", 1, digit), "ended": F.length("rest") <= digit})


def _groups(rows: DataFrame) -> DataFrame:
    """The groups of more than one of rows(parent, digit, ended, doc_id), numbered, as a table of its own:
    so the join with them has a shuffle on either side, which Spark splits at a hot digit."""
    found = rows.groupBy("parent", "digit", "ended").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where("n > 1")
    return written(found.select(*[F.col(c).alias(f"g_{c}") for c in ("parent", "digit", "ended")], "n", "last", F.monotonically_increasing_id().alias("group")))


def exact_dedup(docs: DataFrame, first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is empty. Groups are split
    by successive digits of their bytes, from the most significant: a group of one row is finished,
    and so are the rows whose text ends within the digit, as all they share is all they have. The
    others go on with the next, longer digit, under the number of their group; a level costs one
    aggregation of digits, combined before the shuffle, and one join that Spark may split at a hot
    digit. The first level's digits come from the first characters alone. Equality rests on the bytes;
    the sha256 is an output and nothing else. Texts of any length take as many levels as it needs to
    tell them apart, or their log.

    Of equal texts the row with the largest doc_id stays; a null doc_id is the smallest. Rows that
    repeat a doc_id and its text are the same document: each counts in group_size, and all carry
    the same verdict. Empty tables give no rows; other columns are not read, whatever their names."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = narrow(docs, "doc_id", "text")
    # Bytes of the first characters hold the first digit, and are longer than it if the text is.
    start = F.translate(F.substring(F.coalesce("text", F.lit("")), 1, first_digit + 1), UPPER, UPPER.lower()).cast("binary")
    heads = _split(own.select("doc_id", F.lit(0).cast("bigint").alias("parent"), start.alias("rest")), first_digit).drop("rest")
    now = own.mapInArrow(_normalised, f"doc_id {kind}, sha string, rest binary").withColumn("parent", F.lit(0).cast("bigint"))
    digit, out = first_digit, None
    while True:
        groups = _groups(heads)
        split = _split(now, digit)
        on = (F.col("parent") == F.col("g_parent")) & (F.col("digit") == F.col("g_digit")) & (F.col("ended") == F.col("g_ended"))
        met = split.join(groups.hint("merge"), on, "left")
        going = F.col("group").isNotNull() & ~F.col("ended")
        level = met.select("doc_id", "sha", "n", "last", "group", going.alias("going"), F.when(going, F.expr(f"substring(rest, {digit + 1})")).alias("rest"))
        level = written(level)
        alone = F.col("group").isNull()
        done = level.where("not going").select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("last")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), F.col("sha").alias("text_sha256"))
        out = done if out is None else out.unionByName(done)
        now = level.where("going").select("doc_id", "sha", "rest", F.col("group").alias("parent"))
        if now.isEmpty():
            break
        digit *= growth
        heads = _split(now, digit)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact_dedup over documents, all rows and whole texts."""
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = f"""
with n as (select doc_id, {SQL_LOWER} as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""
