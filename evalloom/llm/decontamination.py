"""Operator 7: benchmark decontamination by greedy string tiling.

Texts and benchmark items become words (runs of anything but ASCII signs and white space, A-Z lowered).

1. The hashes of all runs of ``least`` words of the benchmark are its seeds. A Bloom filter of them, of a bounded size,
   goes to the tasks; a document that holds a run which the filter knows is a suspect, and its words are written.
2. The suspects' runs join the seeds, which gives the pairs of documents and items that share a run.
3. Each pair is tiled: Karp-Rabin hashes tell the greatest length at which the two still have an equal run of unmarked
   words; the runs of that length are marked in order of their place in the item, then in the document, as long as
   none of their words is marked; then comes the next smaller length, down to ``least``. As tiles may lie in any order,
   reordered passages are caught.
4. A document is contaminated by an item if its tiles cover at least ``threshold`` of the item's words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._graph import along_pairs
from ._spark import cut, map_batches
from ._words import _LOWER, Words, mix

LEAST, THRESHOLD = 5, 0.8
#: Bits of the filter: 32 for each seed, but at least and at most two to these powers (8 KB to 16 MB).
BITS_LEAST, BITS_MOST, PROBES = 16, 27, 3
_BASE = 0x9E3779B97F4A7C15
_GAP = np.zeros(256, dtype=bool)
_GAP[[b for b in range(128) if not chr(b).isalnum()]] = True


def words(batch: list[str]) -> Words:
    return Words([t.encode("utf-8") for t in batch], _LOWER, _GAP)


def probe(seeds: np.ndarray, k: int, bits: int) -> np.ndarray:
    return mix(seeds + np.uint64(k)) >> np.uint64(64 - bits)


class Runs:
    """Karp-Rabin hashes of the runs of any length in a sequence."""

    def __init__(self, x: np.ndarray, powers: np.ndarray):
        self.x, self.powers = x, powers
        # sum of x[k] * base**k; a run is compared after its sum is shifted to a common power
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(x * powers[: len(x)], dtype=np.uint64)))
        self.top = len(powers) - 1

    def at(self, start: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.powers[self.top - start]

    def free(self, taken: np.ndarray, length: int) -> np.ndarray:
        """Starts of the runs of the length of which no word is taken."""
        before = np.concatenate(([0], np.cumsum(taken)))
        return np.flatnonzero(before[length:] == before[:-length]) if length <= len(self.x) else np.empty(0, dtype=np.int64)


def tiles(doc: np.ndarray, item: np.ndarray, places: np.ndarray, least: int) -> int:
    """Words of ``item`` that greedy tiling covers. places: where the document may share a run of ``least`` words."""
    starts = np.unique(places[places + least <= len(doc)])
    if not len(starts) or len(item) < least:
        return 0
    # Only words in shared runs can be tiled: the stretches of these, a gap between each two.
    reach = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(reach, starts, 1)
    np.add.at(reach, starts + least, -1)
    inside = np.cumsum(reach[:-1]) > 0
    near = inside.copy()
    near[1:] |= inside[:-1]
    doc, gap_doc = doc[near], ~inside[near]
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate(([1], np.full(max(len(doc), len(item)), _BASE))).astype(np.uint64))
        a, b = Runs(item, powers), Runs(doc, powers)
        taken_item, taken_doc = np.zeros(len(item), dtype=bool), gap_doc

        def shared(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            i, j = a.free(taken_item, length), b.free(taken_doc, length)
            x, y = a.at(i, length), b.at(j, length)
            i_in = np.isin(x, y)
            j_in = np.isin(y, x[i_in])
            return i[i_in], x[i_in], j[j_in], y[j_in]

        covered, most = 0, min(len(item), len(doc))
        while most >= least:
            # the greatest length at which some run is shared (a shared run holds shorter ones)
            low, high = least - 1, most
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if len(shared(middle)[0]) else (low, middle - 1)
            length = low
            if length < least:
                break
            i_at, x, j_at, y = shared(length)
            by_hash: dict[int, list[int]] = defaultdict(list)
            for h, j in zip(y.tolist(), j_at.tolist(), strict=True):
                by_hash[h].append(j)
            passed: dict[int, int] = defaultdict(int)
            for i, h in zip(i_at.tolist(), x.tolist(), strict=True):
                # tiles of this round are as long as the run, so one that overlaps it holds one of its ends
                if taken_item[i] or taken_item[i + length - 1]:
                    continue
                some, k = by_hash[h], passed[h]
                while k < len(some) and (taken_doc[some[k]] or taken_doc[some[k] + length - 1]):
                    k += 1
                passed[h] = k  # what is taken stays taken
                for j in some[k:]:
                    if not (taken_doc[j] or taken_doc[j + length - 1]) and np.array_equal(item[i : i + length], doc[j : j + length]):
                        taken_item[i : i + length] = taken_doc[j : j + length] = True
                        covered += length
                        break
            most = length - 1
    return covered


def seed_filter(seeds: DataFrame) -> tuple[int, np.ndarray]:
    """Bloom filter of the benchmark's seeds: its power of two of bits, and the bits, summed block by block in tasks."""
    count = seeds.count()
    bits = min(BITS_MOST, max(BITS_LEAST, (32 * count).bit_length()))
    block = min(bits, 20)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("seed").to_numpy(zero_copy_only=False).view(np.uint64)
            slot = np.unique(np.concatenate([probe(h, k, bits) for k in range(PROBES)])).astype(np.int64)
            of = slot >> block
            edges = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True]))) if len(slot) else np.zeros(1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(of[edges[:-1]]), pa.array([(slot[p:q] & ((1 << block) - 1)).astype(np.int32).tobytes() for p, q in zip(edges, edges[1:], strict=False)], pa.binary())], ["block", "slots"]
            )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, some in zip(batch.column("block").to_pylist(), batch.column("slots").to_pylist(), strict=True):
                held.setdefault(k, np.zeros(1 << block, dtype=bool))[np.frombuffer(some, dtype=np.int32)] = True
        for k, flags in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.packbits(flags).tobytes()], pa.binary())], ["block", "bits"])

    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    size = (1 << block) // 8
    # at most 2**BITS_MOST bits in all
    for row in seeds.select("seed").mapInArrow(slots, "block long, slots binary").repartition("block").mapInArrow(packed, "block long, bits binary").toLocalIterator():
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return bits, out


def known(h: np.ndarray, bits: int, flags: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter knows."""
    at = np.arange(len(h))
    for k in range(PROBES):
        slot = probe(h[at], k, bits)
        at = at[(flags[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1 == 1]
    return at


def row_key(docs: DataFrame) -> Column:
    """Rows that agree in doc_id and text are one document."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64(F.coalesce("text", F.lit("")))))


def covered_items(docs: DataFrame, benchmark: DataFrame, least: int, threshold: float) -> DataFrame:
    """``row, n_items, item_id, coverage`` of the documents that share a run with an item."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()

    def item_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words(batch.column("text").to_pylist())
        h, inside = w.shingles(least)
        spans = list(zip(w.first.tolist(), w.first[1:].tolist(), strict=False))
        return pa.RecordBatch.from_arrays(
            [batch.column("item_id"), batch.column("item"), pa.array([w.hash[p:q].tobytes() for p, q in spans], pa.binary()), pa.array([np.unique(h[p:q][inside[p:q]]).view(np.int64) for p, q in spans], pa.list_(pa.int64()))],
            ["item_id", "item", "words", "seeds"],
        )

    items = cut(map_batches(items.withColumn("item", F.xxhash64("item_id", "text")), item_words, "item_id long, item long, words binary, seeds array<long>"))
    seeds = cut(items.select("item", F.explode("seeds").alias("seed")))
    bits, flags = seed_filter(seeds)
    shared = spark.sparkContext.broadcast(flags)  # at most 2**BITS_MOST bits

    def suspects(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = words(batch.column("text").to_pylist())
        h, inside = w.shingles(least)
        at = known(h, bits, shared.value)
        at = at[inside[at]]
        if not len(at):
            return None
        of = np.searchsorted(w.first, at, "right") - 1
        rows, first = np.unique(of, return_index=True)
        hits = [np.unique(some).view(np.int64) for some in np.split(h[at], first[1:])]
        return pa.RecordBatch.from_arrays(
            [batch.column("row").take(pa.array(rows)), pa.array([w.hash[w.first[k] : w.first[k + 1]].tobytes() for k in rows.tolist()], pa.binary()), pa.array(hits, pa.list_(pa.int64()))], ["row", "words", "hits"]
        )

    source = docs.select(row_key(docs).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    # repeated rows are one document: of equal keys any one's words will do
    found = cut(map_batches(source, suspects, "row string, words binary, hits array<long>")).dropDuplicates(["row"])
    found = cut(found)
    pairs = cut(found.select("row", F.explode("hits").alias("seed")).join(seeds, "seed").select(F.col("row").alias("a"), F.col("item").alias("b")).distinct())

    def tile(head: bytes, others: list[bytes]) -> list[float]:
        doc, out = np.frombuffer(head, dtype=np.uint64), []
        h = Words.runs(doc, least)
        for other in others:
            item = np.frombuffer(other, dtype=np.uint64)
            places = np.flatnonzero(np.isin(h, Words.runs(item, least)))
            out.append(tiles(doc, item, places, least) / len(item))
        return out

    shares = along_pairs(pairs, found.select(F.col("row").alias("id"), F.col("words").alias("x")), items.select(F.col("item").alias("id"), F.col("words").alias("x")), tile)
    shares = cut(shares.join(items.select(F.col("item").alias("b"), "item_id"), "b").select(F.col("a").alias("row"), "item_id", "share"))
    best = F.min_by(F.struct("item_id", "share"), F.struct(-F.col("share"), F.col("item_id")))
    return shares.groupBy("row").agg(F.count_if(F.col("share") >= threshold).alias("n_items"), best.alias("best")).select("row", "n_items", F.col("best.item_id").alias("item_id"), F.col("best.share").alias("coverage"))


def coverage(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with ``n_items`` (items that contaminate it), ``item_id`` and ``coverage`` of the item that is
    covered most (ties: the smallest id; null and 0 where none shares a run), and ``contaminated``.

    Null and empty texts and items have no words and share nothing; items under ``least`` words can't be met, items
    without item_id or text are passed over; of an item_id with several texts each counts. Repeated rows give a row
    each. Very long texts are tiled whole, at a cost of about n log n in the words that they share with an item. Columns of
    ``docs`` by these four names are replaced, all others stay, whatever their names. Empty tables give no contamination.
    """
    kept = [c for c in docs.columns if c not in ("n_items", "item_id", "coverage", "contaminated")]
    found = cut(covered_items(docs, benchmark, least, threshold))
    # Spark broadcasts the written result if its size is under its threshold; else both sides are shuffled.
    joined = docs.select(F.struct(*kept).alias("doc"), row_key(docs).alias("row")).join(found, "row", "left")
    n = F.coalesce("n_items", F.lit(0)).cast("long")
    return joined.select(*(F.col("doc")[c].alias(c) for c in kept), n.alias("n_items"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), (n > 0).alias("contaminated"))
