"""Sampling, sharding and batching of ordered rows."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.operators.positions import blocks_of, numbered

#: Rows of a block of the sliding meter.
METER_BLOCK = 1 << 18


def take(rows: DataFrame, strategy: str, order: str, seed: int = 0) -> DataFrame:
    """``all``, ``first:N``, ``end:N``, ``random:N``, each N a number or a share such as ``10%`` (rounded up).

    Random order is a hash of the order key and the seed, so it is the same on any cluster. A limit over an order
    becomes a bounded heap in each task.
    """
    if strategy == "all":
        return rows
    kind, _, amount = strategy.partition(":")
    n = math.ceil(rows.count() * float(amount[:-1]) / 100) if amount.endswith("%") else int(amount)
    by = {"first": F.asc(order), "end": F.desc(order), "random": F.xxhash64(F.lit(seed), F.col(order))}
    if kind not in by or not re.fullmatch(r"\d+(\.\d+)?%?", amount):
        raise ValueError(f"unknown sampling strategy: {strategy}")
    return rows.orderBy(by[kind], order).limit(n)


def balanced_chunks(rows: DataFrame, n: int, order: str, by: Sequence[str] = ()) -> DataFrame:
    """``chunk`` 0..n-1: contiguous, sizes that differ by one at most, the larger ones first."""
    return rows.withColumn("chunk", F.ntile(n).over(Window.partitionBy(*by).orderBy(order)) - 1)


def ceil_chunks(rows: DataFrame, n: int, order: str, by: Sequence[str] = ()) -> DataFrame:
    """``chunk``: contiguous runs of ceil(count / n)."""
    w = Window.partitionBy(*by)
    size = F.ceil(F.count(F.lit(1)).over(w) / n)
    return rows.withColumn("chunk", F.floor((F.row_number().over(w.orderBy(order)) - 1) / size).cast("int"))


def slice_rows(rows: DataFrame, start: int, end: int | None, order: str) -> DataFrame:
    """Rows [start, end) by order."""
    first = rows.orderBy(order)
    return first.offset(start) if end is None else first.limit(end).offset(start)


def replica_shard(rows: DataFrame, replicas: int, order: str, seed: int | None = None, skip: int = 0) -> DataFrame:
    """``replica``: equal contiguous blocks, what doesn't divide evenly left out, optionally in a seeded order, after ``skip`` rows."""
    by = [F.xxhash64(F.lit(seed), F.col(order)), F.col(order)] if seed is not None else [F.col(order)]
    at = numbered(rows, by, "_n")
    each = at.count() // replicas
    kept = at.where(F.col("_n") < each * replicas).withColumn("replica", F.floor(F.col("_n") / each).cast("int"))
    return kept.where(F.col("_n") % each >= skip).drop("_n")


def weighted_union(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Each part ``weight`` times; ``copy`` numbers the repeats."""
    out = None
    for part, weight in parts:
        one = part.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(weight)))) if weight > 0 else part.withColumn("copy", F.lit(1)).limit(0)
        out = one if out is None else out.unionByName(one)
    return out


def frame_indices(total: Column, video_fps: Column, sample_fps: float) -> Column:
    """Distinct frame numbers at a target rate: steps of ``video_fps / sample_fps`` from 0, rounded half-even, inside the video.

    If the video lasts less than two samples: the first frame only. Null without frames.
    """
    step = video_fps / sample_fps
    samples = F.floor(total / video_fps * sample_fps)
    picks = F.transform(F.sequence(F.lit(0), (F.ceil(total / step) - 1).cast("int")), lambda i: F.least(F.bround(i * step).cast("int"), (total - 1).cast("int")))
    return F.when(total > 0, F.when(samples <= 1, F.array(F.lit(0))).otherwise(F.array_distinct(picks)))


def spread_picks(games: Column, frames: Column, n: int) -> Column:
    """``n`` picks over several games (arrays of ids and frame counts): as many of each, the first ones one more; evenly spaced, truncated.

    An array of struct(game, frame). Games without frames give none.
    """

    def of_game(game: Column, i: Column) -> Column:
        total = F.get(frames, i)
        mine = F.floor(F.lit(n) / F.size(games)).cast("int") + F.when(i < F.pmod(F.lit(n), F.size(games)), 1).otherwise(0)
        step = (total - 1) / F.greatest(mine - 1, F.lit(1))
        return F.when((mine > 0) & (total > 0), F.transform(F.sequence(F.lit(0), mine - 1), lambda k: F.struct(game.alias("game"), (k * step).cast("int").alias("frame"))))

    return F.flatten(F.filter(F.transform(games, of_game), lambda x: x.isNotNull()))


def uniform_indices(total: Column, n: int) -> Column:
    """n frame numbers from the first to the last one, truncated."""
    step = (total - 1) / max(n - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * step).cast("int"))


def middle_indices(total: Column, n: int) -> Column:
    """The middle of each of n equal stretches."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor((F.floor(total * i / n) + F.floor(total * (i + 1) / n)) / 2).cast("int"))


def megabatches(rows: DataFrame, size: int, length: str, order: str, seed: int = 0) -> DataFrame:
    """``megabatch`` and ``place``: a seeded order cut into runs of ``size``, each by falling length."""
    return blocks_of(rows, [F.xxhash64(F.lit(seed), F.col(order)), F.col(order)], size, "megabatch", "place", [F.desc(length), F.col(order)])


def modality_megabatches(rows: DataFrame, size: int, length: str, order: str, seed: int = 0) -> DataFrame:
    """As ``megabatches``, for negative and other lengths apart (the sign tells the modality)."""
    signed = rows.withColumn("modality", F.when(F.col(length) < 0, "text").otherwise("media")).withColumn("_len", F.abs(F.col(length)))
    parts = [megabatches(signed.where(F.col("modality") == m), size, "_len", order, seed) for m in ("media", "text")]
    return parts[0].unionByName(parts[1]).drop("_len")


def even_chunks(rows: DataFrame, batch: str, chunks: int, length: str, order: str) -> DataFrame:
    """``chunk`` within each batch, whose rows come by falling length: each next row to the lightest chunk that isn't full.

    Chunks are full at an equal number of rows. Batches that don't divide evenly are dealt in turn instead. Ties of length come by
    ``order``, ties of weight go to the first chunk. A task streams one batch after the other and holds a batch's chunks only.
    """
    names = rows.columns
    sized = rows.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(batch))).select(batch, length, order, "_rows", F.struct(*names).alias("_r"))
    out = T.StructType([T.StructField("_r", sized.schema["_r"].dataType), T.StructField("chunk", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, started, weights, held, place = None, False, [], [], 0
        for some in batches:
            to = []
            for b, n, total in zip(*(some.column(c).to_pylist() for c in (batch, length, "_rows")), strict=True):
                if not started or b != key:
                    key, started, weights, held, place = b, True, [0.0] * chunks, [0] * chunks, 0
                if total % chunks:
                    k = place % chunks
                else:
                    k = min((c for c in range(chunks) if held[c] < total // chunks), key=lambda c: (weights[c], c))
                weights[k] += n or 0
                held[k] += 1
                place += 1
                to.append(k)
            yield pa.RecordBatch.from_arrays([some.column("_r"), pa.array(to, pa.int32())], ["_r", "chunk"])

    dealt = sized.repartition(batch).sortWithinPartitions(batch, F.desc(length), order).mapInArrow(run, out)
    return dealt.select("_r.*", "chunk")


def best_of_n(rows: DataFrame, key: str, score: str, n: int, tie: str) -> DataFrame:
    """The n rows of each key with the highest scores."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(tie))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def round_robin(types: DataFrame, games: DataFrame, kind: str, game: str, each: int) -> DataFrame:
    """Every type takes the next ``each`` games in turn, over and over (both sides are small dimensions)."""
    numbered = games.select(game, (F.row_number().over(Window.orderBy(game)) - 1).alias("_g"))
    n = games.count()
    wanted = types.select(kind, F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("turn"))
    wanted = wanted.withColumn("_g", F.pmod(F.row_number().over(Window.orderBy(kind, "turn")) - 1, F.lit(n)))
    return wanted.join(numbered, "_g").select(kind, "turn", game)


def sliding_meter(rows: DataFrame, key: str, order: Sequence[str], value: str, size: int = 50) -> DataFrame:
    """Median, mean and latest of the last ``size`` values of each key, and its running mean and total.

    Rows that agree in ``order`` come by their value, so the result doesn't depend on how the rows are dealt. Rows are dealt in
    blocks of positions; a block brings along the last rows of the one before, and sums of blocks give the running values.
    """
    v = F.col(value)
    at = numbered(rows.select(key, *order, value), [key, *order, value], "_at")
    block = F.floor(F.col("_at") / METER_BLOCK)
    own = at.withColumn("_block", block).withColumn("_own", F.lit(True))
    before = at.where(F.pmod("_at", F.lit(METER_BLOCK)) >= METER_BLOCK - size + 1).withColumn("_block", block + 1).withColumn("_own", F.lit(False))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(key, "_block").agg(F.sum(v).alias("s"), F.count(v).alias("n"))  # a row for each block of a key
    sums = sums.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"))
    by = Window.partitionBy(key, "_block").orderBy("_at")
    last, all_ = by.rowsBetween(-(size - 1), 0), by.rowsBetween(Window.unboundedPreceding, 0)
    held = F.sort_array(F.collect_list(v).over(last))  # at most ``size`` values
    median = (F.get(held, F.floor((F.size(held) - 1) / 2).cast("int")) + F.get(held, F.floor(F.size(held) / 2).cast("int"))) / 2
    mine = F.when(F.col("_own"), v)
    local = own.unionByName(before).select(key, *order, "_block", "_own", median.alias("median"), F.avg(v).over(last).alias("avg"), v.alias("latest"), F.sum(mine).over(all_).alias("_ls"), F.count(mine).over(all_).alias("_ln"))
    met = local.where("_own").join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of")))
    n, total = F.col("_n") + F.col("_ln"), F.col("_s") + F.coalesce("_ls", F.lit(0.0))
    return met.select(key, *order, "median", "avg", "latest", F.when(n > 0, total / n).alias("global_avg"), F.when(n > 0, total).alias("total"))


def whiten(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(value - mean) / population deviation within each group."""
    w = Window.partitionBy(*by)
    return rows.withColumn("whitened", F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))


def masked_moments(rows: DataFrame, by: Sequence[str], value: str, mask: str) -> DataFrame:
    """Mean and sample variance of the values where the mask holds."""
    v = F.when(F.col(mask), F.col(value))
    return rows.groupBy(*by).agg(F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.count(v).alias("n"))
