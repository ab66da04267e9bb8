"""Searches for many queries at once: a dictionary of terms, and BM25 led by each query's rarest term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folded, found, tokens
from .fulltext import K1, LEAST_IDF, B


#: Terms up to which they are sent to the texts, so that tokens of others are not shuffled.
SENT = 1_000_000


def dictionary(texts: DataFrame, text: str = "text") -> DataFrame:
    """term, df, cf of the unstemmed tokens of a column: in how many rows a term occurs, and how often.

    The row without a term holds the corpus: its df is the rows that have tokens, its cf their tokens.
    One scan and one aggregation, combined before the shuffle; a frequent term is one row of each task."""
    found = texts.select(tokens(F.col(text)).alias("ts"))
    entry = lambda term, df, cf: F.struct(term.alias("term"), F.lit(df).cast("bigint").alias("df"), cf.cast("bigint").alias("cf"))
    every = F.array(entry(F.lit(None).cast("string"), 1, F.size("ts")))
    rows = F.concat(every, F.transform(F.array_distinct("ts"), lambda t: entry(t, 1, F.lit(0))), F.transform("ts", lambda t: entry(t, 0, F.lit(1))))
    each = found.select(F.size("ts").alias("dl"), F.explode(rows).alias("e")).where("dl > 0")
    return each.select("e.*").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def frequencies(texts: DataFrame, text: str = "text") -> DataFrame:
    """The dictionary with cf in the row of the corpus only, at half the work: each term once for a row."""
    own = texts.select(tokens(F.col(text)).alias("ts"))
    terms = F.when(F.size("ts") > 0, F.array_append(F.array_distinct("ts"), F.lit(None)))
    each = own.select(F.size("ts").cast("bigint").alias("dl"), F.explode(terms).alias("term"))
    sums = each.groupBy("term").agg(F.count("*").alias("df"), F.sum("dl").alias("dl"))
    return sums.select("term", "df", F.when(F.col("term").isNull(), F.col("dl")).alias("cf"))


def telling_terms(items: DataFrame, known: DataFrame, most: int, key: str = "item_id", text: str = "text") -> DataFrame:
    """key, term, df of the `most` rarest tokens of each item's text that the dictionary has; ties by
    term. Items without a key, and words that occur nowhere, give nothing."""
    words = items.where(F.col(key).isNotNull()).select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).distinct()
    met = words.join(known.where("term is not null").select(F.col("term").alias("t_"), "df"), F.col("term") == F.col("t_"))
    w = Window.partitionBy(key).orderBy("df", "term")
    return met.select(key, "term", "df").withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= most).drop("n_")


def term_counts(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf, dl of the rows that hold some of terms(term), dl being the row's tokens.

    Terms are counted first: up to SENT they are sent to the texts, and tokens of others are dropped before
    the shuffle; more than that are many enough for a shuffle of all tokens."""
    wanted = terms.select(F.col("term").alias("t_")).distinct()
    few = wanted.limit(SENT + 1).count() <= SENT
    every = texts.where(F.col(key).isNotNull()).select(key, found(F.col(text)).alias("ts"))
    each = every.select(key, F.size("ts").cast("bigint").alias("dl"), F.explode("ts").alias("t")).select(key, "dl", folded(F.col("t")).alias("term"))
    return each.join(F.broadcast(wanted) if few else wanted, F.col("term") == F.col("t_"), "left_semi").groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def inverse_frequency(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(LEAST_IDF)).otherwise(raw)


def bulk_keyword(counts: DataFrame, queries: DataFrame, corpus: DataFrame, limit: int, query_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """query_key, key, rank, place of the `limit` best rows in which all terms of a query occur, for all
    queries at once; smaller ranks are better, ties by key. The ranks are those of bm25.

    counts: key, term, tf, dl. queries: query_key, term, df, each term once. corpus: the one row df, cf of
    the whole. A query's candidates are the rows with its rarest term, so a frequent term costs what the
    rare one beside it leaves. Joins on a hot term are split by AQE; the best of each query are found
    within tasks first."""
    figures = corpus.select(F.col("df").cast("double").alias("n"), (F.col("cf").cast("double") / F.col("df")).alias("avgdl"))
    told = queries.select(query_key, "term", F.col("df").cast("double").alias("df"))
    lead = told.groupBy(query_key).agg(F.min(F.struct("df", "term")).alias("lead"), F.count("*").alias("terms")).select(F.col(query_key).alias("q_"), F.col("lead.term").alias("lead"), "terms")
    begun = counts.select(key, F.col("term").alias("t_")).join(lead, F.col("t_") == F.col("lead")).select("q_", key, "terms")
    wanted = begun.withColumnRenamed(key, "k_").join(told, F.col("q_") == F.col(query_key)).select(query_key, "k_", "terms", F.col("term").alias("w_"), "df")
    met = wanted.join(counts, (F.col("w_") == F.col("term")) & (F.col("k_") == F.col(key))).crossJoin(F.broadcast(figures))  # one row
    part = inverse_frequency(F.col("n"), F.col("df")) * ((F.col("tf") * (K1 + 1.0)) / (F.col("tf") + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("dl") / F.col("avgdl"))))
    every = met.groupBy(query_key, key).agg(F.array_sort(F.collect_list(F.struct("term", part.alias("part")))).alias("parts"), F.max("terms").alias("terms")).where("size(parts) = terms")
    ranked = every.select(query_key, key, (-F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"])).alias("rank"))
    w = Window.partitionBy(query_key).orderBy("rank", key)
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
