"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import forget_at_exit, shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: SQL that lower-cases A-Z and nothing else.
SQL_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones can neither clash nor be read."""
    return df.select(*[df[c] for c in columns])


def written(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: this cuts the lineage, and what
    is written outlives the executors that wrote it. Removed when the process ends."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(spark, root)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


#: Rows of a file of edges.
EDGES_PER_FILE = 500_000
#: Most edges whose minima are broadcast: some megabytes. Of more none are, however small Spark takes their file to be.
EDGES_BROADCAST = 100_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(u, v) as (node, component), component the smallest node.

    Alternates large-star and small-star steps until the edges are stars; each round ends in a
    written table, in as many files as the first count of edges asks for, and removes the one before. No node's edges meet in one task: minima are pre-aggregated, and the joins that
    hand them back are sort-merge joins that Spark may split at a hot node, or broadcasts if the edges were
    counted and are few. Edges with a null end and loops are ignored; repeated edges count once."""
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = written(now.where("u is not null and v is not null and u <> v").distinct())
    n = now.count()
    files = 1 + n // EDGES_PER_FILE
    before = None
    while True:
        few = n <= EDGES_BROADCAST
        handed = lambda df, few=few: F.broadcast(df) if few else df.hint("merge")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(handed(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(handed(least), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        last, now = now, written(hung.select("e.u", "e.v").where("u <> v").distinct().coalesce(files))
        forget(last)
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before, n = sign, sign[0]
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
