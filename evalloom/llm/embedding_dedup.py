"""Operator 3: near-duplicate vectors by sorted projection passes.

Each pass gives every vector a key of concatenated random hashes (signs of random projections) and sorts all vectors
by it. A vector is compared with the next ``window`` ones in that order; pairs at or above the threshold are links.
A task only hands on links that join two of its groups, so a pass gives fewer links than vectors, however dense a
group is. Links of all passes are united to components.

How many links a vector has is then counted exactly within its component. Small components are multiplied out. In
large ones, vectors within half the threshold's angle of the component's mean are all linked with each other and are
only counted; the others are compared with all members, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._spark import cut, partitions

BITS = 48
BLOCK = 256
SMALL = 1000
#: Passes at least, and passes whose shuffle is on disk at a time.
LEAST, AT_ONCE = 24, 24
#: Passes at most that a length of vectors can have: keeps lengths apart in the order.
MOST = 1 << 20


def passes_for(rows: int, threshold: float, window: int, recall: float = 0.97) -> int:
    """Passes after which a pair at the threshold has met with the chance ``recall``, whatever the number of rows.

    In one pass two vectors are within a window if their first ``log2(rows / window)`` signs agree, each with the chance
    1 - angle / pi; a twentieth is taken off for pairs that fall on both sides of a window's end.
    """
    signs = max(0.0, math.log2(max(rows, 1) / window))
    meet = min(0.95 * (1 - math.acos(min(threshold, 1.0)) / math.pi) ** signs, 1 - 1e-9)
    return max(LEAST, math.ceil(math.log(1 - recall) / math.log1p(-meet)))


def planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([dim, number]).standard_normal((dim, BITS))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, dim, v`` (doubles of length 1, as bytes) of the vectors that can be linked, one row for each id."""
    good = vectors.where(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    ).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(x, dtype=np.float64) for x in batch.column("embedding").to_pylist()]
            rows = [x / np.abs(x).max() for x in rows]
            rows = [x / np.sqrt(x @ x) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([len(x) for x in rows], pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())], ["vec_id", "dim", "v"])

    return good.mapInArrow(work, "vec_id long, dim int, v binary").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("u")).select("vec_id", "u.dim", "u.v")


class Forest:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while (up := self.parent.get(x, x)) != root:
            self.parent[x], x = root, up
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def links(units: DataFrame, threshold: float, passes: range, window: int) -> DataFrame:
    """``a, b``: links that connect what the passes of these numbers find."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = np.array(batch.column("dim").to_pylist())
            for d in np.unique(dim):
                some = batch.filter(pa.array(dim == d))
                x = np.frombuffer(b"".join(some.column("v").to_pylist()), dtype=np.float64).reshape(-1, d)
                for number in passes:
                    bits = (x @ planes(int(d), number) > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS, dtype=np.int64))
                    order = pa.array(np.full(len(x), d * MOST + number), pa.int64())
                    yield pa.RecordBatch.from_arrays([order, pa.array(bits), some.column("vec_id"), some.column("v")], ["pass", "key", "vec_id", "v"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        number, ids, x = None, np.empty(0, dtype=np.int64), np.empty((0, 0))
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            passes_of = np.array(batch.column("pass").to_pylist())
            for p in np.unique(passes_of):
                some = batch.filter(pa.array(passes_of == p))
                new_ids = np.array(some.column("vec_id").to_pylist(), dtype=np.int64)
                new = np.frombuffer(b"".join(some.column("v").to_pylist()), dtype=np.float64).reshape(len(new_ids), -1)
                if p != number:
                    number, ids, x = p, new_ids[:0], new[:0]
                old = len(ids)
                ids, x = np.concatenate((ids, new_ids)), np.concatenate((x, new))
                for at in range(0, len(ids), BLOCK):
                    right = x[at : at + BLOCK + window]
                    near = x[at : at + BLOCK] @ right.T >= threshold
                    i, j = np.nonzero(near)
                    some_pairs = (j > i) & (j <= i + window) & (j + at >= old)
                    for i, j in zip((i[some_pairs] + at).tolist(), (j[some_pairs] + at).tolist(), strict=True):
                        if forest.join(int(ids[i]), int(ids[j])):
                            a.append(int(ids[i]))
                            b.append(int(ids[j]))
                ids, x = ids[-window:], x[-window:]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    ordered = units.mapInArrow(keyed, "pass long, key long, vec_id long, v binary")
    parts = partitions(units.sparkSession)
    return ordered.repartitionByRange(parts, "pass", "key", "vec_id").sortWithinPartitions("pass", "key", "vec_id").mapInArrow(neighbours, "a long, b long")


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``vec_id, n_links`` of the members (``component, vec_id, v``) of components."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
    sized = members.join(sizes, "component")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []

        def close() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1)
            n = (x @ x.T >= threshold).sum(1) - 1
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["vec_id", "n_links"])

        for batch in batches:
            for component, vec_id, v in zip(*(batch.column(c).to_pylist() for c in ("component", "vec_id", "v")), strict=True):
                if component != key:
                    if rows:
                        yield close()
                    key, ids, rows = component, [], []
                ids.append(vec_id)
                rows.append(v)
        if rows:
            yield close()

    small = sized.where(F.col("c") <= SMALL).select("component", "vec_id", "v").repartition("component").sortWithinPartitions("component").mapInArrow(exact, "vec_id long, n_links long")
    if not sizes.where(F.col("c") > SMALL).limit(1).count():
        return small
    large = cut(sized.where(F.col("c") > SMALL).select("component", "vec_id", "v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for component, v in zip(batch.column("component").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = np.frombuffer(v, dtype=np.float64)
                sums[component] = sums[component] + x if component in sums else x
            if len(sums) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["component", "s"])
                sums = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["component", "s"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for component, s in zip(batch.column("component").to_pylist(), batch.column("s").to_pylist(), strict=True):
                x = np.frombuffer(s, dtype=np.float64)
                sums[component] = sums[component] + x if component in sums else x
        unit = [(s / max(np.sqrt(s @ s), 1e-300)).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(unit, pa.binary())], ["component", "mean"])

    # one partial sum for each component and task
    mean = large.mapInArrow(partial, "component long, s binary").repartition("component").mapInArrow(means, "component long, mean binary")
    half = float(np.cos(np.arccos(threshold) / 2)) + 1e-9

    def core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [bool(np.frombuffer(v, dtype=np.float64) @ np.frombuffer(m, dtype=np.float64) >= half) for v, m in zip(batch.column("v").to_pylist(), batch.column("mean").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("vec_id"), batch.column("v"), pa.array(near, pa.bool_())], ["component", "vec_id", "v", "core"])

    told = cut(large.join(mean, "component").mapInArrow(core, "component long, vec_id long, v binary, core boolean"))
    counts = told.groupBy("component").agg(F.count_if("core").alias("cores"), F.count_if(~F.col("core")).alias("fringe"))
    base = told.where("core").join(counts, "component").select("vec_id", (F.col("cores") - 1).alias("n_links"))
    fringe = told.where("not core").join(counts, "component").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("fringe") / BLOCK)))
    blocks = fringe.groupBy("component", "block").agg(F.collect_list(F.struct("vec_id", "v")).alias("others"))

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = [], []
            for vec_id, v, is_core, others in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "v", "core", "others")), strict=True):
                x = np.frombuffer(v, dtype=np.float64)
                near = np.frombuffer(b"".join(o["v"] for o in others), dtype=np.float64).reshape(len(others), -1) @ x >= threshold
                linked = [o["vec_id"] for o, ok in zip(others, near, strict=True) if ok and o["vec_id"] != vec_id]
                ids.append(vec_id)
                n.append(len(linked))
                if is_core:  # the other way round; among fringe vectors each is met as a member too
                    ids += linked
                    n += [1] * len(linked)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], ["vec_id", "n_links"])

    more = told.join(blocks, "component").mapInArrow(against, "vec_id long, n_links long")
    return small.unionByName(base.unionByName(more).groupBy("vec_id").agg(F.sum("n_links").alias("n_links")))


def near_vectors(vectors: DataFrame, threshold: float = 0.9, passes: int | None = None, window: int = 32) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row of ``vectors`` (``vec_id``, ``embedding``; others are ignored).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; nor do vectors of
    different lengths with each other. Rows that repeat a vec_id are one vector (the least by length and bytes) and get the
    same result each. An empty table gives an empty one. No pair below the threshold is linked; a pair at it is found with
    a chance of about 0.97: without ``passes`` their number follows the count of rows (``passes_for``), ``AT_ONCE`` of them
    a shuffle. Windows end where a range partition does, so ``window`` rows of each partition and pass miss some of theirs.
    """
    units = cut(unit_vectors(vectors))
    passes = passes or passes_for(units.count(), threshold, window)
    parts = [cut(links(units, threshold, range(k, min(k + AT_ONCE, passes)), window)) for k in range(0, passes, AT_ONCE)]
    found = cut(components(reduce(DataFrame.unionByName, parts)))
    members = cut(units.join(found.withColumnRenamed("id", "vec_id"), "vec_id").select("component", "vec_id", "v"))
    counts = link_counts(members, threshold)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(found.withColumnRenamed("id", "vec_id"), "vec_id", "left").join(counts, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
