"""Run hygiene: best attempts, resume, verdict caches, run statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_best(rows: DataFrame, key: str, success: str, order: str) -> DataFrame:
    """One row for each key: a success beats a failure, then the later one; rows without a key all stay.

    An aggregate over structs, so rows are combined before the shuffle.
    """
    whole = F.struct(*rows.columns)
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(whole, F.struct(F.coalesce(F.col(success).cast("int"), F.lit(0)), F.col(order))).alias("r")).select("r.*")
    return best.unionByName(rows.where(F.col(key).isNull()))


def unprocessed(rows: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key isn't done yet."""
    keys = [key] if isinstance(key, str) else list(key)
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def overlay(cached: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Cached values with newer ones on top; a new row without a value doesn't erase the old one."""
    n = new.select(key, F.col(value).alias("_new"))
    return cached.select(key, value).join(n, key, "full_outer").select(key, F.coalesce("_new", value).alias(value))


def judged(results: DataFrame, verdicts: DataFrame, key: str, verdict: str = "verdict") -> DataFrame:
    """Results with ``correct`` and ``is_judged``; a missing verdict counts as wrong."""
    v = verdicts.select(key, verdict)
    return results.join(v, key, "left").withColumn("correct", F.coalesce(F.col(verdict) == "Right", F.lit(False))).withColumn("is_judged", F.col(verdict).isNotNull())


def judged_counts(rows: DataFrame, *by: str) -> DataFrame:
    """Correct, judged, unjudged, total and accuracy over all (unjudged ones are wrong)."""
    return rows.groupBy(*by).agg(
        F.count_if("correct").alias("correct"), F.count_if("is_judged").alias("judged"), F.count_if(~F.col("is_judged")).alias("unjudged"), F.count(F.lit(1)).alias("total"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy")
    )


def run_stats(rows: DataFrame, worker: str, success: str, seconds: str, error: str) -> DataFrame:
    """Totals by worker and over all (worker null): counts, seconds, errors, seconds a row and success in percent."""
    return rows.rollup(worker).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(success).alias("successful"),
        F.count_if(~F.col(success)).alias("failed"),
        F.sum(seconds).alias("seconds"),
        F.count(error).alias("errors"),
        F.avg(seconds).alias("seconds_each"),
        (100 * F.avg(F.col(success).cast("double"))).alias("success_percent"),
    )


def distinct_ids(rows: DataFrame, *ids: str | Column) -> DataFrame:
    """How many ids, each the first of ``ids`` that isn't null."""
    return rows.agg(F.count_distinct(F.coalesce(*ids)).alias("n_ids"))


def completeness(expected: DataFrame, got: DataFrame, run: str) -> DataFrame:
    """``total, covered, complete`` of each run (``run``, ``id`` on both sides)."""
    both = expected.select(run, "id").distinct().join(got.select(run, "id").distinct().withColumn("_got", F.lit(1)), [run, "id"], "left")
    return both.groupBy(run).agg(F.count(F.lit(1)).alias("total"), F.count("_got").alias("covered")).withColumn("complete", (F.col("total") > 0) & (F.col("covered") == F.col("total")))


def upsert(state: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key."""
    both = state.unionByName(changes)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), version).alias("r")).select("r.*")


def demux(responses: DataFrame, requests: DataFrame, key: str, status: str, body: str) -> tuple[DataFrame, DataFrame]:
    """Responses joined to their requests: good ones, and those with another status than 200 or an empty body."""
    joined = requests.join(responses, key)
    good = (F.col(status) == 200) & (F.length(F.trim(F.col(body))) > 0)
    good = F.coalesce(good, F.lit(False))
    return joined.where(good), joined.where(~good)


def by_ordinal(responses: DataFrame, requests: DataFrame, custom_id: str = "custom_id", ordinal: str = "ordinal") -> DataFrame:
    """Responses ``task-<i>`` joined to the i-th request."""
    n = F.regexp_extract(custom_id, r"(\d+)$", 1).try_cast("long")
    return requests.join(responses.withColumn(ordinal, n), ordinal)
