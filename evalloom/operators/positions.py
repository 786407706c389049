"""Positions of rows in an order, without bringing them to one task.

Rows are dealt by ranges of the order and numbered within their range; the ranges' sizes, one number a partition, give the
offsets. The dealt rows are written before they are counted: ranges come from a sample, so two jobs could deal differently.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.storage import cut, partitions

_PLACES = 1 << 33  # rows of a partition that monotonically_increasing_id numbers


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """``rows`` with their 0-based position in ``order`` (a whole order, or rows of equal order are numbered in any).

    Nulls come first, as in any Spark order. An empty frame stays empty.
    """
    columns = rows.columns
    spread = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = cut(spread.select(*columns, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one a partition
    if not sizes:
        return dealt.select(*columns, F.lit(0).cast("long").alias(name))
    counts = [sizes.get(k, 0) for k in range(max(sizes) + 1)]
    offsets = dealt.sparkSession.createDataFrame([(k, o) for k, o in enumerate([0, *accumulate(counts)][:-1])], "_part int, _offset long")
    joined = dealt.join(F.broadcast(offsets), "_part")  # one row a partition
    return joined.select(*columns, (F.col("_offset") + F.pmod("_id", F.lit(_PLACES))).alias(name))


def joined_by_position(frames: Sequence[tuple[DataFrame, Sequence[str | Column]]], name: str = "position") -> DataFrame:
    """Frames side by side, row by row in the order of each; ValueError if they differ in length."""
    sides = [numbered(rows, order, name) for rows, order in frames]
    lengths = [s.count() for s in sides]
    if len(set(lengths)) > 1:
        raise ValueError(f"frames differ in length: {lengths}")
    out = sides[0]
    for side in sides[1:]:
        out = out.join(side, name)
    return out


def interleaved(parts: Sequence[tuple[DataFrame, Sequence[str | Column]]], seed: int | None = None, name: str = "position") -> DataFrame:
    """The rows of all parts in one order: any prefix holds about each part's share, and each part keeps its order.

    A row's key is its middle in its part, ``(place + 1/2) / size``, so up to a key t a part of n rows has given n t, to within one; parts of equal keys come in their own order, or in a seeded one. Columns are
    those of the first part, with ``part`` and the position.
    """
    keyed = None
    for number, (rows, order) in enumerate(parts):
        placed = numbered(rows, order, "_place")
        size = placed.count()
        # whole numbers, so that equal fractions are equal: the key is (2 place + 1) / (2 size)
        key = ((2 * F.col("_place") + 1).cast("decimal(20,0)") / F.lit(max(2 * size, 1)).cast("decimal(18,0)")).cast("decimal(38,18)")
        one = placed.select(*parts[0][0].columns, F.lit(number).alias("part"), key.alias("_key"), (F.lit(0).cast("long") if seed is None else F.xxhash64(F.lit(seed), F.lit(number))).alias("_turn"))
        keyed = one if keyed is None else keyed.unionByName(one)
    return numbered(keyed, ["_key", "_turn", "part"], name).drop("_key", "_turn")


def blocks_of(rows: DataFrame, order: Sequence[str | Column], size: int, block: str, place: str, within: Sequence[str | Column]) -> DataFrame:
    """Runs of ``size`` rows of an order as ``block``, with the ``place`` of each row in its block by another order."""
    at = numbered(rows, order, "_position")
    by = Window.partitionBy(block).orderBy(*within)
    cut_ = at.withColumn(block, F.floor(F.col("_position") / size).cast("int")).drop("_position")
    return cut_.withColumn(place, F.row_number().over(by) - 1)
