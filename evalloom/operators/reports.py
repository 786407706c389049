"""Reports over retrieval metrics: ``sport, tier, category, attribute, n, r100, med_rank`` rows and the like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EASY, MODERATE = 40.0, 25.0


def attributes(rows: DataFrame, composition: str = "composition", sep: str = " + ") -> DataFrame:
    """One row for each attribute of a composition."""
    return rows.withColumn("attribute", F.explode(F.split(composition, sep.replace("+", r"\+"))))


def difficulty(rows: DataFrame, least_n: int = 5, least_entries: int = 3) -> DataFrame:
    """Plain mean of r100 by attribute over entries with enough rows; attributes with enough entries."""
    return rows.where(F.col("n") >= least_n).groupBy("attribute").agg(F.avg("r100").alias("mean_r100"), F.count(F.lit(1)).alias("entries")).where(F.col("entries") >= least_entries)


def ease(r100: Column) -> Column:
    return F.when(r100 >= EASY, "EASY").when(r100 >= MODERATE, "MODERATE").otherwise("HARD")


def retrievability(rows: DataFrame, by: Sequence[str] = ("sport", "attribute"), least_n: int = 5, least_total: int = 10) -> DataFrame:
    """r100 and median rank weighted by n, over entries of ``least_n`` or more rows, of attributes of ``least_total`` or more; with a verdict."""
    weighed = rows.where(F.col("n") >= least_n).groupBy(*by)
    out = weighed.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("entries"), (F.sum(F.col("r100") * F.col("n")) / F.sum("n")).alias("r100"), (F.sum(F.col("med_rank") * F.col("n")) / F.sum("n")).alias("med_rank"))
    return out.where(F.col("total") >= least_total).withColumn("verdict", ease(F.col("r100")))


def cross_group_patterns(rows: DataFrame, group: str, easy: float = 35.0, hard: float = 25.0, least_groups: int = 2) -> DataFrame:
    """Attributes that several groups know well enough: plain mean of the groups' weighted r100, and whether it is easy or hard."""
    per = retrievability(rows, (group, "attribute"))
    out = per.groupBy("attribute").agg(F.count(F.lit(1)).alias("groups"), F.avg("r100").alias("mean_r100")).where(F.col("groups") >= least_groups)
    return out.withColumn("pattern", F.when(F.col("mean_r100") >= easy, "easy").when(F.col("mean_r100") < hard, "hard").otherwise("mixed"))


def extremes(rows: DataFrame, by: Sequence[str], name: str, value: str, least_n: int = 10) -> DataFrame:
    """The hardest and easiest name of each group by the plain mean of its entries (one a sport) of ``least_n`` or more rows.

    Ties: the smaller name is harder, the larger easier.
    """
    means = rows.where(F.col("n") >= least_n).groupBy(*by, name).agg(F.avg(value).alias("_mean"))
    key = F.struct("_mean", name)
    return means.groupBy(*by).agg(F.min_by(name, key).alias("hardest"), F.min("_mean").alias("hardest_mean"), F.max_by(name, key).alias("easiest"), F.max("_mean").alias("easiest_mean"))


def ranked_extremes(rows: DataFrame, by: Sequence[str], k: int = 15) -> DataFrame:
    """The k hardest (r100 up, rank down) and easiest rows of each group."""
    w = Window.partitionBy(*by)
    hard = F.row_number().over(w.orderBy(F.asc("r100"), F.desc("med_rank"), F.asc("attribute")))
    easy = F.row_number().over(w.orderBy(F.desc("r100"), F.asc("med_rank"), F.asc("attribute")))
    both = rows.withColumn("hard", hard).withColumn("easy", easy)
    return both.where((F.col("hard") <= k) | (F.col("easy") <= k))


def bin_delta(rows: DataFrame, by: Sequence[str], bin_column: str, low: str, high: str, value: str) -> DataFrame:
    """The value in bin ``low`` less that in ``high``; null where either is missing."""
    pick = lambda b: F.max(F.when(F.col(bin_column) == b, F.col(value)))
    return rows.groupBy(*by).agg(pick(low).alias("low"), pick(high).alias("high")).withColumn("delta", F.col("low") - F.col("high"))


def wide(rows: DataFrame, by: Sequence[str], group: str, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row for each (by, metric), one column for each group."""
    long = rows.select(*by, group, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))))
    return long.groupBy(*by, "metric").pivot(group, list(groups)).agg(F.max("value"))


def in_order(rows: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rows with ``ord``: the place in a fixed order, unknown ones last."""
    table = F.create_map(*(F.lit(x) for k, name in enumerate(order) for x in (name, k)))
    return rows.withColumn("ord", F.coalesce(F.try_element_at(table, F.col(column)), F.lit(len(order))))


def ordering(rows: DataFrame, by: Sequence[str], name: str, value: str) -> DataFrame:
    """Names of each group by falling value, as one string."""
    s = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(name).alias("k"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(s, lambda x: x["k"]), " > ").alias("ordering"))


def missing_combinations(grid: Sequence[DataFrame], present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Combinations of the (small) dimension tables that aren't there."""
    all_ = grid[0]
    for more in grid[1:]:
        all_ = all_.crossJoin(more)  # dimensions of a few names each
    return all_.join(present.select(*keys).distinct(), list(keys), "left_anti")


def format_table(headers: Sequence[str], rows: Sequence[Sequence[object]], title: str = "") -> str:
    """A text table of a small collected report: the first column to the left, others to the right."""
    text = [[f"{c:.2f}" if isinstance(c, float) else "-" if c is None else str(c) for c in r] for r in rows]
    width = [max(len(x) for x in col) for col in zip(headers, *text, strict=True)]
    line = lambda r: "  ".join(c.ljust(w) if k == 0 else c.rjust(w) for k, (c, w) in enumerate(zip(r, width, strict=True))).rstrip()
    return "\n".join([*([title] if title else []), line(headers), "  ".join("-" * w for w in width), *map(line, text)])
