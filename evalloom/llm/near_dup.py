"""Operator 6: MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of word shingles (48-bit hashes) and a MinHash signature. Texts with the same set are
   one class; only one document of the class goes on. Classes are numbered, and those that one doc_id holds (rows that
   repeat an id with another text) are linked with each other.
2. Bands of the signature give buckets. Every member of a bucket is paired with the bucket's first one, so a bucket
   gives as many pairs as it has members.
3. Signatures are compared batch by batch. After each batch the posterior of the similarity (uniform prior) bounds
   the chance that the pair reaches the threshold; below ``miss`` the pair is dropped. Survivors are verified on
   their full sets.
4. In buckets whose members don't yet all lie in one component, pairs across components are compared as well, by
   their signatures and within the bucket's task, block by block. The rows bring their full sets along, so that
   survivors are verified on the spot, and only links that join two components are handed on: fewer than the task has
   rows, however many pairs lie just under the threshold. Buckets of more than ``WHOLE`` members or ``BYTES`` bytes of
   sets are dealt into parts of about that size, and each part is compared with itself and with each other part in
   tasks of their own, so that no pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import compare_pairs, components
from ._spark import cut, map_batches, texts
from ._words import Words, mix

ROWS = 6
#: Chance at most that a pair at the threshold shares no band.
UNMET = 5e-5
#: Values of a signature: those of the bands, and more that only sharpen the estimate.
SIGNATURE = 256
STEP = 16
WHOLE = 1000
BYTES = 32 << 20
_BITS = np.uint64(48)
_LOW = np.uint64((1 << 48) - 1)


def shingle_sets(batch: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all texts, one text after the other, and where each text's begin.

    A text with fewer words than ``size`` has its whole word sequence as its one shingle; one without words has none.
    """
    words = Words([t.encode("utf-8") for t in batch])
    n = np.diff(words.first)
    text = np.repeat(np.arange(len(batch), dtype=np.uint64), n)
    h, inside = words.shingles(size)
    keys = [(text[inside] << _BITS) | (h[inside] >> np.uint64(16))]
    for short in range(1, size):
        which = np.flatnonzero(n == short)
        if len(which):
            h, _ = words.shingles(short)
            keys.append((which.astype(np.uint64) << _BITS) | (h[words.first[which]] >> np.uint64(16)))
    key = np.unique(np.concatenate(keys))
    first = np.searchsorted(key, np.arange(len(batch) + 1, dtype=np.uint64) << _BITS)
    return key & _LOW, first


@lru_cache(maxsize=1)
def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)


def signatures(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[rows, texts that have shingles] MinHash values."""
    a, b = _coefficients(SIGNATURE)
    starts = first[:-1][np.diff(first) > 0]
    h = mix(shingles).astype(np.uint32)
    out = np.empty((len(a), len(starts)), dtype=np.uint32)
    for k in range(len(a) if len(starts) else 0):
        out[k] = np.minimum.reduceat(h * a[k] + b[k], starts)
    return out


def banding(threshold: float) -> tuple[int, int]:
    """Number of bands and their rows: as many rows (at most ``ROWS``) as the signature has values for at ``UNMET``."""
    for rows in range(ROWS, 0, -1):
        bands = math.ceil(math.log(UNMET) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= SIGNATURE:
            return bands, rows
    raise ValueError(f"a threshold of {threshold} needs longer signatures")


def least_matches(threshold: float, miss: float, step: int = STEP, rows: int = SIGNATURE) -> list[tuple[int, int]]:
    """(rows compared, matches below which a pair is dropped): the posterior chance of the threshold is below ``miss``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(step, rows + 1, step):
        m = 0
        while m < n:
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= miss * weight.sum():
                break
            m += 1
        out.append((n, m))
    return out


def bayes(threshold: float, miss: float):
    rule = least_matches(threshold, miss)

    def compare(a: bytes, others: list[bytes]) -> list[bool]:
        x = np.frombuffer(a, dtype=np.uint16)
        y = np.frombuffer(b"".join(others), dtype=np.uint16).reshape(len(others), -1)
        alive, matches, done = np.arange(len(others)), np.zeros(len(others), dtype=np.int64), 0
        for n, least in rule:
            matches = matches + (y[alive, done:n] == x[done:n]).sum(1)
            keep = matches >= least
            alive, matches, done = alive[keep], matches[keep], n
        out = np.zeros(len(others), dtype=bool)
        out[alive] = True
        return out.tolist()

    return compare


def across(percent: int, miss: float):
    """Links of one bucket's rows that join different components: pairs that survive the pruning and hold on full sets.

    Rows: ``key, band, id, component, part, sig, x``; if there are rows of two parts, only pairs across them are
    compared. A pair that shares several bands meets in several buckets; the bucket of the first of them compares it.
    """
    rule, alike, block, (bands, rows_of) = least_matches(percent / 100, miss), exact(percent), 256, banding(percent / 100)

    def links(band: int, ids: np.ndarray, component: np.ndarray, part: np.ndarray, sig: np.ndarray, sets: list[bytes]) -> list[tuple[int, int]]:
        out, two = [], part.min() != part.max()
        root = np.unique(component, return_inverse=True)[1]
        for at in range(0, len(ids), block):
            for to in range(at, len(ids), block):
                i, j = np.nonzero(root[at : at + block, None] != root[None, to : to + block])
                i, j = i + at, j + to
                fit = (i < j) & ((part[i] != part[j]) | (not two))
                i, j = i[fit], j[fit]
                matches, done = np.zeros(len(i), dtype=np.int64), 0
                for n, least in rule:
                    matches = matches + (sig[i, done:n] == sig[j, done:n]).sum(1)
                    keep = matches >= least
                    i, j, matches, done = i[keep], j[keep], matches[keep], n
                shared = (sig[i, : bands * rows_of] == sig[j, : bands * rows_of]).reshape(len(i), bands, rows_of).all(2)
                own = shared[:, band] & ~shared[:, :band].any(1)
                for a, b in zip(i[own].tolist(), j[own].tolist(), strict=True):
                    if root[a] != root[b] and alike(sets[a], [sets[b]])[0]:
                        root[root == root[b]] = root[a]
                        out.append((int(ids[a]), int(ids[b])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, band, rows = None, None, []

        def close() -> pa.RecordBatch:
            ids, component, part, sig, sets = zip(*rows, strict=True)
            found = links(band, np.array(ids), np.array(component), np.array(part), np.frombuffer(b"".join(sig), dtype=np.uint16).reshape(len(ids), -1), sets)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for k, of, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "band", "id", "component", "part", "sig", "x")), strict=True):
                if k != key:
                    if len(rows) > 1:
                        yield close()
                    key, band, rows = k, of, []
                rows.append(row)
        if len(rows) > 1:
            yield close()

    return run


def exact(percent: int):
    """100 * intersection >= percent * union, on full sets."""

    def compare(a: bytes, others: list[bytes]) -> list[bool]:
        x, out = np.frombuffer(a, dtype=np.uint64), []
        for other in others:
            y = np.frombuffer(other, dtype=np.uint64)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                out.append(False)
                continue
            both = len(x) + len(y) - len(np.union1d(x, y))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return out

    return compare


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, miss: float = 1e-4) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs`` (``doc_id``, ``text``; others are ignored).

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of ``size``-word shingles.
    Null, empty and blank texts have an empty set and link with nothing. Repeated rows and equal texts are one class
    and get the same component. Rows that repeat a doc_id with other texts are one document of several sets: what is
    near any of them is in its component. Rows without a doc_id link nothing; they get the component of the
    documents with an equal set, or null. Very long texts are read whole, one at a time. An empty table gives an empty one.
    Sets are of 48-bit hashes of shingles. A pair at the threshold is missed with a chance of
    at most ``UNMET`` by the bands and about ``miss`` by the pruning, whatever the size of its buckets; no pair below it
    is linked.
    """
    source = texts(docs).withColumn("own", F.xxhash64("text"))
    n_bands, n_rows = banding(percent / 100)

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles, first = shingle_sets(batch.column("text").to_pylist(), size)
        n = np.diff(first)
        full = n > 0
        sig = signatures(shingles, first)
        starts = first[:-1][full]
        spread = mix(shingles + np.uint64(1))
        marks = [np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)]
        if len(starts):
            marks[0][full] = np.add.reduceat(spread, starts).view(np.int64)
            marks[1][full] = np.add.reduceat(mix(spread), starts).view(np.int64)
        bands = np.zeros((n_bands, sig.shape[1]), dtype=np.uint64)
        for k in range(n_bands):
            h = np.full(sig.shape[1], k + 1, dtype=np.uint64)
            for r in range(n_rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[k * n_rows + r])
            bands[k] = h
        low = np.ascontiguousarray((sig & np.uint32(0xFFFF)).astype(np.uint16).T)
        column = iter(range(sig.shape[1]))
        at = [next(column) if f else None for f in full]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("own"),
                pa.array(n.astype(np.int64)),
                pa.array(marks[0]),
                pa.array(marks[1]),
                pa.array([None if k is None else low[k].tobytes() for k in at], pa.binary()),
                pa.array([None if k is None else bands[:, k].view(np.int64) for k in at], pa.list_(pa.int64())),
            ],
            ["doc_id", "own", "n_shingles", "mark", "mark2", "sig", "bands"],
        )

    table = cut(map_batches(source, sketch, "doc_id long, own long, n_shingles long, mark long, mark2 long, sig binary, bands array<long>", most=1 << 20))
    full = table.where("n_shingles > 0")
    same = ["n_shingles", "mark", "mark2"]
    # A class is known by its number; its text is that of the row (rep, own).
    classes = full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min_by("own", "doc_id").alias("own"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("id"), "rep", "own", *same))
    reps = full.join(classes.select("id", F.col("rep").alias("doc_id"), "own"), ["doc_id", "own"]).dropDuplicates(["id"])
    reps = cut(reps.select("id", "n_shingles", "sig", "bands"))

    again = full.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 and doc_id is not null").select("doc_id")
    held = full.select("doc_id", *same).join(again, "doc_id").join(classes.select("id", *same), same).select("doc_id", "id").distinct()
    least = held.groupBy("doc_id").agg(F.min("id").alias("a"))
    bridges = cut(held.join(least, "doc_id").where("id <> a").select("a", F.col("id").alias("b")))

    exploded = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    first = exploded.groupBy("key").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    members = cut(exploded.join(first, "key"))

    prune, verify = bayes(percent / 100, miss), exact(percent)

    def set_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        shingles, at = shingle_sets(batch.column("text").to_pylist(), size)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingles[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())], ["id", "x"])

    def sets(ids: DataFrame) -> DataFrame:
        rows = ids.join(classes.select("id", F.col("rep").alias("doc_id"), "own"), "id")
        return cut(map_batches(source.join(rows.hint("shuffle_hash"), ["doc_id", "own"]).dropDuplicates(["id"]).select("id", "text"), set_of, "id long, x binary", most=1 << 20))

    stars = members.where("id <> m").select(F.col("m").alias("a"), F.col("id").alias("b")).distinct()
    likely = cut(compare_pairs(stars, reps.select("id", F.col("sig").alias("x")), prune))
    ends = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    edges = cut(compare_pairs(likely, sets(ends), verify)).unionByName(bridges)
    found = components(edges)

    # Buckets that still hold several components.
    rest = members.join(found, "id", "left").select("key", "band", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    parts = F.ceil(F.greatest(F.col("c") / WHOLE, F.col("n") * 8 / BYTES)).cast("int")
    rest = cut(rest.join(sizes.select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    if rest.limit(1).count():
        full_sets = sets(rest.select("id").distinct())
        # A row goes to its part's task with each part, itself included.
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rest = rest.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "band", "id", "component", "part")
        dealt = rest.join(reps.select("id", "sig").join(full_sets, "id"), "id").repartition("key").sortWithinPartitions("key")
        new = cut(dealt.select("key", "band", "id", "component", "part", "sig", "x").mapInArrow(across(percent, miss), "a long, b long"))
        if new.limit(1).count():
            found = components(edges.unionByName(new))

    least = found.join(classes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    named = classes.join(found.join(least, "component").select("id", "least"), "id", "left")
    of_doc = table.join(named.select(*same, F.coalesce("least", "rep").alias("least")), same, "left")
    component = F.coalesce("least", "doc_id")
    return of_doc.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
