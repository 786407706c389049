"""Operator 2: exact substring removal over a logarithmic family of suffix arrays.

A string of ``LENGTH`` bytes holds ``LENGTH - GRAM + 1`` grams of ``GRAM`` bytes; the one with the least hash is its
anchor. So equal strings have equal anchors at equal places, and only suffixes at anchors need to be indexed (about
one byte in 35). Strings that follow one another and share an anchor form a run; a run's content is told by the
hashes of its first and last string and its length.

1. Each batch of documents gets a sparse suffix array: its runs, sorted by the hash of the suffix's first ``GRAM``
   bytes, then by content. Equal runs of a batch collapse onto their first occurrence; all later ones are removed
   bytes at once. The array is dealt out by ranges of hashes.
2. For each range an index of sorted levels is kept. A new batch is merge-scanned against all levels: equal runs are
   long matches, of which the later one is removed. What is left of the batch becomes a level, and levels of about
   equal size merge, so there are logarithmically many.
3. Runs with the same anchor but different content (at the edges of copied passages) may still share some strings.
   These few are compared string by string, with their bytes; where an anchor has very many of them, by an aggregate
   over the strings' hashes, which no single task holds.
4. The removed ranges meet their document, whose kept bytes are digested.

Hashes have 64 bits and are compared together with the anchor's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._hashes import sliding_min, windows
from ._spark import cut, map_batches, partitions, slices, texts
from ._words import mix

LENGTH, GRAM = 100, 32
BATCH = 12 << 20
#: Runs of one anchor beyond which they are compared by an aggregate.
HOT = 4000
_PLACE = np.uint64((1 << 24) - 1)
_SEGMENT = 4 << 20
_TOP = np.uint64(32)

#: An entry of a suffix array. key: anchor hash (upper half), content (lower half); content: all of it.
ENTRY = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])


def runs(data: np.ndarray, first: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a stream of documents (``first``: where each begins, and the end), and the lower anchor bits."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.empty(0, dtype=ENTRY), np.empty(0, dtype=np.uint64)
    grams = windows(data, GRAM)
    strings = windows(data, LENGTH)
    place = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams & ~_PLACE) | place, LENGTH - GRAM + 1)
    anchor = (least & _PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), np.diff(first))[:n]
    inside = np.arange(n) + LENGTH <= first[doc + 1]
    begins = inside.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= begins[1:] | ~inside[1:]
    p, q = np.flatnonzero(begins), np.flatnonzero(ends)
    out = np.empty(len(p), dtype=ENTRY)
    size = (q - p + 1).astype(np.uint64)
    content = mix((strings[p] * np.uint64(0x9E3779B97F4A7C15)) ^ (strings[q] + size))
    gram = grams[anchor[p]]
    out["key"] = (gram >> _TOP << _TOP) | (content >> _TOP)
    out["content"], out["doc"], out["start"], out["n"] = content, docs[doc[p]], p - first[doc[p]], size
    return out, gram & np.uint64(0xFFFFFFFF)


def segments(doc_ids: list[int], data: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``runs`` of documents; a very long one goes in overlapping segments, which share no string start."""
    short = [k for k, t in enumerate(data) if LENGTH <= len(t) <= _SEGMENT]
    if short:
        first = np.concatenate(([0], np.cumsum([len(data[k]) for k in short])))
        yield runs(np.frombuffer(b"".join(data[k] for k in short), dtype=np.uint8), first, np.array([doc_ids[k] for k in short]))
    for k, t in enumerate(data):
        if len(t) > _SEGMENT:
            for at in range(0, len(t) - LENGTH + 1, _SEGMENT):
                piece = np.frombuffer(t[at : at + _SEGMENT + LENGTH - 1], dtype=np.uint8)
                got, low = runs(piece, np.array([0, len(piece)]), np.array([doc_ids[k]]))
                got["start"] += at
                yield got, low


def later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Does each entry of ``a`` stand later than that of ``b``?"""
    return (a["doc"] > b["doc"]) | ((a["doc"] == b["doc"]) & (a["start"] > b["start"]))


def collapse(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort; keep the first occurrence of each content; also return the later ones."""
    entries = entries[np.lexsort((entries["start"], entries["doc"], entries["content"], entries["key"]))]
    same = np.zeros(len(entries), dtype=bool)
    same[1:] = (entries["key"][1:] == entries["key"][:-1]) & (entries["content"][1:] == entries["content"][:-1])
    # of a repeated row (same document, same place) neither is later
    group = np.flatnonzero(~same)[np.cumsum(~same) - 1] if len(entries) else np.empty(0, dtype=np.int64)
    lost = entries[same & later(entries, entries[group])]
    return entries[~same], lost


class Levels:
    """The logarithmic index of one range of anchor hashes."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, new: np.ndarray) -> list[np.ndarray]:
        """Take in a batch's sorted entries; returns the entries that turn out to be later occurrences."""
        lost = []
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["key"], new["key"]), len(level) - 1)
            hit = (level["key"][at] == new["key"]) & (level["content"][at] == new["content"])
            if not hit.any():
                continue
            old, mine = at[hit], new[hit]
            behind = later(mine, level[old])
            lost.append(mine[behind])
            ahead = later(level[old], mine)
            lost.append(level[old[ahead]])
            for name in ("doc", "start"):
                level[name][old[ahead]] = mine[name][ahead]
            new = new[~hit]
        if len(new):
            self.levels.append(new)
            while len(self.levels) > 1 and 2 * len(self.levels[-1]) >= len(self.levels[-2]):
                self.merge()
        return lost

    def merge(self) -> None:
        b, a = self.levels.pop(), self.levels.pop()
        both = np.concatenate((a, b))
        self.levels.append(both[np.argsort(both["key"], kind="stable")])

    def contested(self) -> tuple[np.ndarray, np.ndarray]:
        """First occurrences whose anchor has several contents, and how many of these each one's anchor has."""
        while len(self.levels) > 1:
            self.merge()
        if not self.levels:
            return np.empty(0, dtype=ENTRY), np.empty(0, dtype=np.int64)
        level = self.levels[0]
        _, which, n = np.unique(level["key"] >> _TOP, return_inverse=True, return_counts=True)
        n = n[which]
        return level[n > 1], n[n > 1]


_FOUND = "doc_id long, start int, stop int, anchor long, hot boolean"


def _ranges(lost: list[np.ndarray]) -> pa.RecordBatch:
    """Removed ranges of later occurrences."""
    e = np.concatenate([np.empty(0, dtype=ENTRY), *lost])
    none = pa.nulls(len(e), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(e["doc"]), pa.array(e["start"]), pa.array(e["start"] + e["n"] - 1 + LENGTH), none, pa.nulls(len(e), pa.bool_())], ["doc_id", "start", "stop", "anchor", "hot"])


def removed_ranges(source: DataFrame) -> DataFrame:
    """``doc_id, start, stop``: bytes that a string starting earlier covers (ranges may overlap)."""
    spark = source.sparkSession
    parts = partitions(spark)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, number = 0, TaskContext.get().partitionId() << 24

        def close() -> Iterator[pa.RecordBatch]:
            entries = np.concatenate([h[0] for h in held])
            low = np.concatenate([h[1] for h in held])
            bucket = (low * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(parts + 1, dtype=np.uint64))
            rows, lost = [], []
            for k in range(parts):
                kept, gone = collapse(entries[order[edges[k] : edges[k + 1]]])
                lost.append(gone)
                if len(kept):
                    rows.append((k, kept.tobytes()))
            gone = np.concatenate(lost)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows] + [None], pa.int32()), pa.array([number] * (len(rows) + 1), pa.int64()), pa.array([r[1] for r in rows] + [gone.tobytes()], pa.binary())],
                ["bucket", "batch", "data"],
            )

        for batch in batches:
            for some in slices(batch, 1 << 20):
                column = [t.encode("utf-8") for t in some.column("text").to_pylist()]
                held += segments(some.column("doc_id").to_pylist(), column)
                size += sum(map(len, column))
                if size >= BATCH and held:
                    yield from close()
                    held, size, number = [], 0, number + 1
        if held:
            yield from close()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, levels = None, Levels()

        def finish() -> Iterator[pa.RecordBatch]:
            e, n = levels.contested()
            for at in range(0, len(e), 100_000):
                x, m = e[at : at + 100_000], n[at : at + 100_000]
                anchor = mix((x["key"] >> _TOP) * np.uint64(parts) + np.uint64(bucket)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x["doc"]), pa.array(x["start"]), pa.array(x["start"] + x["n"] - 1 + LENGTH), pa.array(anchor), pa.array(m > HOT)], ["doc_id", "start", "stop", "anchor", "hot"])

        for batch in batches:
            for k, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
                if k != bucket:
                    if bucket is not None:
                        yield from finish()
                    bucket, levels = k, Levels()
                entries = np.frombuffer(data.as_buffer(), dtype=ENTRY)
                # later occurrences within a batch come without a bucket
                yield _ranges([entries] if k is None else levels.add(entries.copy()))
        if bucket is not None:
            yield from finish()

    sorted_runs = source.mapInArrow(arrays, "bucket int, batch long, data binary")
    # rows without a bucket go anywhere
    dealt = sorted_runs.repartition(parts, F.coalesce(F.col("bucket").cast("long"), F.col("batch"))).sortWithinPartitions("bucket", "batch")
    found = cut(dealt.mapInArrow(index, _FOUND))
    wanted = found.where("anchor is not null").groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "anchor", "hot")).alias("wanted"))

    def strings(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text, asked in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            data = text.encode("utf-8")
            for w in asked:
                part = data[w["start"] : w["stop"]]
                if w["hot"]:
                    h = windows(np.frombuffer(part, dtype=np.uint8), LENGTH).view(np.int64).tolist()
                    rows += [(x, doc_id, w["start"] + k, None) for k, x in enumerate(h)]
                else:
                    rows.append((w["anchor"], doc_id, w["start"], part))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["anchor", "doc_id", "start", "data"])

    once = source.join(wanted.hint("shuffle_hash"), "doc_id")
    asked = cut(map_batches(once, strings, "anchor long, doc_id long, start int, data binary", most=1 << 20))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close(rows: list[tuple]) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
            size = np.array([len(r[3]) for r in rows])
            n = size - LENGTH + 1
            row = np.repeat(np.arange(len(rows)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h = mix(windows(data, LENGTH)[(np.cumsum(size) - size)[row] + k] + np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)[row])
            e = np.empty(len(row), dtype=ENTRY)
            e["key"], e["content"], e["n"] = h, 0, 1
            e["doc"], e["start"] = np.array([r[1] for r in rows])[row], np.array([r[2] for r in rows])[row] + k
            _, lost = collapse(e)
            # strings that follow one another make one range
            lost = np.unique(lost[["doc", "start"]])
            new = np.ones(len(lost), dtype=bool)
            new[1:] = (lost["doc"][1:] != lost["doc"][:-1]) | (lost["start"][1:] != lost["start"][:-1] + 1)
            at = np.flatnonzero(new)
            out = np.empty(len(at), dtype=ENTRY)
            out["doc"], out["start"], out["n"] = lost["doc"][at], lost["start"][at], np.diff(np.append(at, len(lost)))
            return _ranges([out])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "start", "data")), strict=True):
                if len(held) >= HOT and held[-1][0] != row[0]:
                    yield close(held)
                    held = []
                held.append(row)
        if held:
            yield close(held)

    few = asked.where("data is not null").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(compare, _FOUND)
    many = asked.where("data is null").select("anchor", "doc_id", "start").distinct()
    least = many.groupBy("anchor").agg(F.min(F.struct("doc_id", "start")).alias("least"), F.count(F.lit(1)).alias("c")).where("c > 1")
    hot = many.join(least, "anchor").where(F.struct("doc_id", "start") > F.col("least")).select("doc_id", "start", (F.col("start") + LENGTH).alias("stop"))
    plain = ["doc_id", "start", "stop"]
    return found.where("anchor is null").select(*plain).unionByName(few.select(*plain)).unionByName(hot)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row of ``docs`` (``doc_id``, ``text``).

    A byte goes if a string of 100 bytes covers it that also starts earlier: in a document with a smaller doc_id, or
    earlier in the same one. Null texts are empty; texts under 100 bytes stay whole. Rows that repeat a doc_id are one
    document: none of them stands before the other. Rows without doc_id are neither compared nor changed. Other
    columns are ignored; an empty table gives an empty one.
    """
    source = texts(docs)
    ranges = removed_ranges(source.where("doc_id is not null"))
    of_doc = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, text, ranges in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("ranges"), strict=True):
            data, at, spans, removed, end = text.encode("utf-8"), hashlib.sha256(), 0, 0, -1
            if ranges.is_valid and len(ranges.values):
                both = ranges.values.flatten()
                start, stop = both[0].to_numpy(), both[1].to_numpy()
                order = np.argsort(start, kind="stable")
                start, reach = start[order], np.maximum.accumulate(stop[order])
                new = np.ones(len(start), dtype=bool)
                new[1:] = start[1:] > reach[:-1]
                begin = start[new].tolist()
                finish = reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)].tolist()
                end = 0
                for a, b in zip(begin, finish, strict=True):
                    at.update(data[end:a])
                    removed, end = removed + b - a, b
                spans = len(begin)
                at.update(data[end:])
            else:
                at.update(data)
            rows.append((doc_id, len(data), removed, spans, at.hexdigest()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = source.join(of_doc.hint("shuffle_hash"), "doc_id", "left")
    return map_batches(joined, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", most=1 << 20)
