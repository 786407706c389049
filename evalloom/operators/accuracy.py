"""Accuracy roll-ups over predictions and judge scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERALL = "overall"


def rollup(rows: DataFrame, by: Sequence[str], *measures: Column) -> DataFrame:
    """Measures by group and overall in one pass; the overall line has ``OVERALL`` in the first column."""
    names = [F.col(c).cast("string").alias(c) for c in by]
    out = rows.select(*names, *[c for c in rows.columns if c not in by]).groupingSets([[F.col(c) for c in by], []], *[F.col(c) for c in by]).agg(*measures, F.grouping_id().alias("_g"))
    first = F.when(F.col("_g") != 0, F.lit(OVERALL)).otherwise(F.col(by[0])).alias(by[0])
    return out.select(first, *by[1:], *[c for c in out.columns if c not in (*by, "_g")])


def letter_accuracy(rows: DataFrame, by: Sequence[str], predicted: str, truth: str) -> DataFrame:
    """Correct, total and accuracy; rows without a readable prediction or truth don't count."""
    readable = rows.where(F.col(predicted).isNotNull() & F.col(truth).isNotNull())
    hit = F.col(predicted) == F.col(truth)
    return rollup(readable, by, F.count_if(hit).alias("correct"), F.count(F.lit(1)).alias("total"), F.round(F.avg(hit.cast("double")), 4).alias("accuracy"))


def exact_accuracy(rows: DataFrame, by: Sequence[str], predicted: str, truth: str) -> DataFrame:
    """Equality of the trimmed strings; a missing prediction is wrong."""
    hit = F.coalesce(F.trim(F.col(predicted)) == F.trim(F.col(truth)), F.lit(False))
    return rollup(rows, by, F.count_if(hit).alias("correct"), F.count(F.lit(1)).alias("total"), F.round(F.avg(hit.cast("double")), 4).alias("accuracy"))


def goal_accuracy(rows: DataFrame, by: str, correct: str) -> DataFrame:
    """Micro accuracy, and the mean of the groups' accuracies rounded to four places."""
    groups = rows.groupBy(by).agg(F.count_if(correct).alias("c"), F.count(F.lit(1)).alias("n"))
    return groups.agg((F.sum("c") / F.sum("n")).alias("micro"), F.avg(F.round(F.col("c") / F.col("n"), 4)).alias("macro"), F.sum("n").alias("n"))


def best_of(scores: Column) -> Column:
    """Best of an array of judge scores: none at all 0, all failed (null) -1."""
    return F.when(F.size(scores) == 0, F.lit(0)).otherwise(F.array_max(F.transform(scores, lambda x: F.coalesce(x, F.lit(-1)))))


def judged_mean(rows: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """Mean of the scores above -1 (none: -1), how many there are, and the total."""
    good = F.col(score) > -1
    return rollup(rows, by, F.coalesce(F.avg(F.when(good, F.col(score))), F.lit(-1.0)).alias("score"), F.count_if(good).alias("succeeded"), F.count(F.lit(1)).alias("total"))


def factual(rows: DataFrame, by: Sequence[str], got: str, total: str) -> DataFrame:
    """Mean of the samples' ratios; a sample with total 0 has none."""
    return rollup(rows, by, F.avg(F.try_divide(F.col(got), F.col(total))).alias("score"), F.count(F.try_divide(F.col(got), F.col(total))).alias("n"))


def coverage(rows: DataFrame, by: Sequence[str], got: str, total: str) -> DataFrame:
    """Ratio of the sums (``micro``), and the mean of ratios beside it (``macro``)."""
    ratio = F.try_divide(F.col(got), F.col(total))
    known = ratio.isNotNull()
    micro = F.try_divide(F.sum(F.when(known, F.col(got))), F.sum(F.when(known, F.col(total))))
    return rollup(rows, by, micro.alias("micro"), F.avg(ratio).alias("macro"), F.count(ratio).alias("n"))


def score_means(rows: DataFrame, by: Sequence[str], dimensions: Sequence[str], cost: str | None = None) -> DataFrame:
    """Mean of each judge dimension, nulls apart, and the total cost."""
    measures = [F.avg(d).alias(d) for d in dimensions] + ([F.sum(cost).alias("cost")] if cost else [])
    return rollup(rows, by, *measures)


def corpus_summary(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, median and count of the values that are there; how many aren't."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.percentile(v, 0.5).alias("median"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("failed"))


def token_cost(usage: DataFrame, prices: DataFrame, batch: bool = False) -> DataFrame:
    """Cost by model of fresh, cached and output tokens at prices for a million; a batch costs half."""
    rate = 0.5 if batch else 1.0
    joined = usage.join(prices, "model")
    fresh = F.col("input_tokens") - F.col("cached_tokens")
    cost = (fresh * F.col("input_price") + F.col("cached_tokens") * F.col("cached_price") + F.col("output_tokens") * F.col("output_price")) / 1e6 * rate
    return joined.groupBy("model").agg(F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("n"))
