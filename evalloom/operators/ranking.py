"""Ranks of positives among candidates, and recall tables over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECALL_AT = (1, 5, 10, 50, 100, 200, 300, 400, 500)


def optimistic_ranks(scored: DataFrame, query: Sequence[str], score: str = "score", positive: str = "is_positive", candidate: str = "candidate_id") -> DataFrame:
    """0-based rank of each query's positive: how many distinct negatives score strictly higher.

    One aggregation without a window: the positive's score is a max over a flag, and negatives are counted by
    comparing a sorted array, so no total order over the candidates is built.
    """
    flagged = scored.dropDuplicates([*query, candidate, positive])
    best = flagged.groupBy(*query).agg(
        F.max(F.when(F.col(positive), F.col(score))).alias("_pos"),
        F.collect_list(F.when(~F.col(positive), F.col(score))).alias("_neg"),
    )
    return best.select(*query, F.size(F.filter("_neg", lambda x: x > F.col("_pos"))).cast("long").alias("rank"))


def recall_columns(rank: str = "rank", at: Sequence[int] = RECALL_AT) -> list[Column]:
    """R@K in percent for each K, the truncated median rank and the count."""
    r = F.col(rank)
    return [
        *(F.round(100 * F.avg((r < k).cast("double")), 4).alias(f"r_at_{k}") for k in at),
        F.floor(F.percentile(r, 0.5)).cast("long").alias("med_rank"),
        F.count(F.lit(1)).alias("n"),
    ]


def recall(ranks: DataFrame, by: Sequence[str] = (), at: Sequence[int] = RECALL_AT) -> DataFrame:
    return ranks.groupBy(*by).agg(*recall_columns(at=at))


def recall_rollup(ranks: DataFrame, levels: Sequence[Sequence[str]], at: Sequence[int] = RECALL_AT) -> DataFrame:
    """Recall at several levels in one pass: each level is a tuple of columns, () the overall line."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    sets = [[F.col(c) for c in level] for level in levels]
    return ranks.groupingSets(sets, *[F.col(c) for c in names]).agg(*recall_columns(at=at))


def best_ranks(scored: DataFrame, query: str, candidate: str, truth: str, score: str = "score") -> DataFrame:
    """0-based rank of the best true candidate of each query, ties by the higher candidate first; queries without one go."""
    order = F.struct(F.col(score), F.col(candidate))
    best = scored.groupBy(query).agg(F.max(F.when(F.col(truth), order)).alias("_b"), F.collect_list(order).alias("_all")).where("_b is not null")
    return best.select(query, F.size(F.filter("_all", lambda x: x > F.col("_b"))).cast("long").alias("rank"))


def dual_softmax(scored: DataFrame, by: str, score: str = "score") -> DataFrame:
    """score * softmax(score) over the rows of each ``by``."""
    w = Window.partitionBy(by)
    top = F.max(score).over(w)
    grown = F.exp(F.col(score) - top)
    return scored.withColumn(score, F.col(score) * grown / F.sum(grown).over(w))


def both_directions(ranks: DataFrame, direction: str, tier: str | None = None, tiered: str = "t2v", at: Sequence[int] = RECALL_AT) -> DataFrame:
    """R@K to two places by direction, and ``r_mean``, the mean of the rounded values; ``overall`` the mean of the directions' means.

    With a tier, rows of the direction ``tiered`` by tier as well. Ranks that are null (no truth) don't count.
    """
    columns = [F.round(100 * F.avg((F.col("rank") < k).cast("double")), 2).alias(f"r_at_{k}") for k in at]
    mean = F.round(sum((F.col(f"r_at_{k}") for k in at[1:]), F.col(f"r_at_{at[0]}")) / len(at), 2)
    known = ranks.where("rank is not null")
    each = known.groupBy(direction).agg(*columns).withColumn("r_mean", mean)
    overall = each.agg(F.lit("overall").alias(direction), *(F.lit(None).cast("double").alias(f"r_at_{k}") for k in at), F.round(F.avg("r_mean"), 2).alias("r_mean"))
    out = each.unionByName(overall).withColumn("tier", F.lit(None).cast("string"))
    if tier is None:
        return out
    by_tier = known.where(F.col(direction) == tiered).groupBy(direction, F.col(tier).cast("string").alias("tier")).agg(*columns).withColumn("r_mean", mean)
    return out.unionByName(by_tier)
