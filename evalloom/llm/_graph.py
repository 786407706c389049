"""Connected components, and comparisons along pairs of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut

SALTS = 64


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every id in ``edges`` (``a``, ``b``); component: the smallest id that links reach.

    Alternates large-star and small-star steps until nothing changes: a number of rounds logarithmic in the longest
    path. A node's smallest neighbour is an aggregate that is joined back, so that a hub's rows can be split among
    tasks; each round is cut off, so a lost executor costs one round at most.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.unionByName(now.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")).distinct()
        # large: every node points to something smaller; now each points its neighbours below at the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())


def compare_pairs(pairs: DataFrame, payload: DataFrame, compare: Callable[[bytes, list[bytes]], list[bool]]) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) for which ``compare(payload of a, payloads of some b)`` is true; payload: ``id, x`` (binary)."""
    return along_pairs(pairs, payload, payload, compare).where("share = 1").select("a", "b")


def along_pairs(pairs: DataFrame, heads: DataFrame, others: DataFrame, work: Callable[[bytes, list[bytes]], list]) -> DataFrame:
    """``a, b, share`` of the ``pairs`` (``a``, ``b``): the numbers that ``work(payload of a, payloads of some b)`` gives.

    heads, others: ``id, x`` (binary) of the two sides. The b side carries its payload once for each pair; a's payload is
    sent once to each of at most ``SALTS`` parts of its partners, so a hub neither gathers in one task nor is copied for
    each partner.
    """
    types = [pairs.schema[c].dataType.simpleString() for c in ("a", "b")]
    arrow = [pa.string() if t == "string" else pa.int64() for t in types]
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    right = salted.join(others.select(F.col("id").alias("b"), "x"), "b").select("a", "salt", "b", "x")
    left = salted.select("a", "salt").distinct().join(heads.select(F.col("id").alias("a"), "x"), "a").select("a", "salt", F.lit(None).cast(types[1]).alias("b"), "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = head = None
        for batch in batches:
            a, salt, b, x = (batch.column(c).to_pylist() for c in ("a", "salt", "b", "x"))
            kept: tuple[list, list, list] = ([], [], [])
            i = 0
            while i < len(a):
                if (a[i], salt[i]) != key:
                    key, head = (a[i], salt[i]), None
                if b[i] is None:
                    head = x[i]
                    i += 1
                    continue
                j = i
                while j < len(a) and (a[j], salt[j]) == key and b[j] is not None:
                    j += 1
                if head is not None:
                    kept[0].extend(a[i:j])
                    kept[1].extend(b[i:j])
                    kept[2].extend(map(float, work(head, x[i:j])))
                i = j
            yield pa.RecordBatch.from_arrays([pa.array(kept[0], arrow[0]), pa.array(kept[1], arrow[1]), pa.array(kept[2], pa.float64())], ["a", "b", "share"])

    return right.unionByName(left).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(run, f"a {types[0]}, b {types[1]}, share double")
