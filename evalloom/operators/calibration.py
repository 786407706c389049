"""Calibration of option distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def option_samples(answers: DataFrame, probabilities: str = "probabilities", truth: str = "truth") -> DataFrame:
    """One row for each (question, option): ``p`` and whether the option is true."""
    return answers.select(F.explode(probabilities).alias("option", "p"), F.col(truth).alias("_t")).select("p", (F.col("option") == F.col("_t")).cast("int").alias("hit"))


def calibration_bins(samples: DataFrame, bins: int) -> DataFrame:
    """``bin, n, confidence, accuracy`` of the bins that have samples; p = 1 falls in the last."""
    b = F.least((F.col("p") * bins).cast("int"), F.lit(bins - 1))
    return samples.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("hit").alias("accuracy"))


def calibration_error(samples: DataFrame, bins: int) -> DataFrame:
    """``ce_unweighted`` (mean gap over all bins, empty ones 0, the primary value) and ``ce_weighted`` (by samples)."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return calibration_bins(samples, bins).agg(
        (F.sum(gap) / bins).alias("ce_unweighted"), (F.sum(gap * F.col("n")) / F.sum("n")).alias("ce_weighted"), F.sum("n").alias("n")
    )


def diagnostics(answers: DataFrame, probabilities: str = "probabilities", truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Sums of probabilities (min, max, mean, sample deviation), and the probability of the truth: over all, correct and wrong answers.

    Answers whose truth has no probability count for the sums only.
    """
    total = F.aggregate(F.map_values(probabilities), F.lit(0.0), lambda s, x: s + x)
    right = F.coalesce(F.col(predicted) == F.col(truth), F.lit(False))
    rows = answers.select(total.alias("s"), F.try_element_at(probabilities, F.col(truth)).alias("p"), right.alias("ok"))
    good, bad = F.when(F.col("ok"), F.col("p")), F.when(~F.col("ok"), F.col("p"))
    named = [("truth", F.col("p")), ("correct", good), ("wrong", bad)]
    parts = [x for name, p in named for x in (F.avg(p).alias(f"{name}_mean"), F.percentile(p, 0.5).alias(f"{name}_median"), F.count(p).alias(f"{name}_n"))]
    return rows.agg(F.min("s").alias("sum_min"), F.max("s").alias("sum_max"), F.avg("s").alias("sum_mean"), F.stddev_samp("s").alias("sum_std"), F.min("p").alias("truth_min"), F.max("p").alias("truth_max"), *parts)


def predicted_probabilities(answers: DataFrame, probabilities: str = "probabilities", truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Probability of the predicted option (min, max, mean), over all, correct and wrong answers; predictions without one don't count."""
    right = F.coalesce(F.col(predicted) == F.col(truth), F.lit(False))
    rows = answers.select(F.try_element_at(probabilities, F.col(predicted)).alias("p"), right.alias("ok")).where("p is not null")
    return rows.agg(F.min("p").alias("min"), F.max("p").alias("max"), F.avg("p").alias("mean"), F.avg(F.when(F.col("ok"), F.col("p"))).alias("correct_mean"), F.avg(F.when(~F.col("ok"), F.col("p"))).alias("wrong_mean"))


def accuracy_above(answers: DataFrame, confidence: str, correct: str, at: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Accuracy and count of the rows with at least each confidence, one row for each."""
    one = answers.agg(*(c for t in at for c in (F.count_if(F.col(confidence) >= t).alias(f"n{t}"), F.avg(F.when(F.col(confidence) >= t, F.col(correct).cast("double"))).alias(f"a{t}"))))
    rows = F.array(*(F.struct(F.lit(t).alias("at_least"), F.col(f"`n{t}`").alias("n"), F.col(f"`a{t}`").alias("accuracy")) for t in at))
    return one.select(F.inline(rows))
