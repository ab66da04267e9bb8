"""Rank fusion and score normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The arms in the order in which their ids are met and their scores added.
ARMS = ("semantic", "keyword", "fuzzy")


def ranked(hits: DataFrame, arm: str, *order: Column, carry: Sequence[str] = ()) -> DataFrame:
    """arm, id, rank from 1 of an arm's limited hits, and columns that belong to the id."""
    return hits.select(F.lit(ARMS.index(arm)).alias("arm"), "id", *carry, F.row_number().over(Window.orderBy(*order)).alias("rank"))


def rrf(arms: DataFrame, k: int = 60, limit: int | None = None) -> DataFrame:
    """id, score, met of arms(arm, id, rank): the sum of 1 / (k + rank), semantic first.

    met orders equal scores: the arm that has the id first, and its rank there. Takes a union and
    one aggregation instead of outer joins. Only limited hits come here. Other columns belong to the id."""
    rest = [c for c in arms.columns if c not in ("arm", "id", "rank")]
    parts = F.array_sort(F.collect_list(F.struct("arm", "rank")))
    fused = arms.groupBy("id").agg(parts.alias("parts"), *[F.max(c).alias(c) for c in rest])
    score = F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.lit(1.0) / (F.lit(float(k)) + p["rank"]))
    out = fused.select("id", *rest, score.alias("score"), F.col("parts")[0].alias("met"))
    return out.orderBy(F.desc("score"), "met").limit(limit) if limit else out


def min_max(hits: DataFrame, score: str = "score") -> DataFrame:
    """similarity of limited hits: 0 for the least score, 1 for the most; 0 if all are equal."""
    every = Window.partitionBy()
    low, high = F.min(score).over(every), F.max(score).over(every)
    return hits.withColumn("similarity", (F.col(score) - low) / F.when(high == low, 1.0).otherwise(high - low))


def from_best(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """similarity of limited keyword hits: 1 for the best rank, 0 for the worst; 1 if all are equal."""
    every = Window.partitionBy()
    best, worst = F.min(rank).over(every), F.max(rank).over(every)
    return hits.withColumn("similarity", F.when(best == worst, 1.0).otherwise(1.0 - F.abs(F.col(rank) - best) / F.abs(worst - best)))
