"""Operator 10: packing by a bounded number of open windows.

Each partition keeps ``open_windows`` windows. A document longer than a window fills whole windows first. What is
left goes to the window whose room it fills best; if it fits none, the fullest one is topped up with as much of it
as there is room (unless that is fewer than ``least_cut`` ids) and emitted. When a partition ends, its open windows
are merged into full ones and a rest of less than one window; rests merge in groups of ``FAN``, level by level. The
very last rest is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._pretokens import PreTokens, vocabulary
from ._spark import cut, slices, texts
from .token_counts import byte_names

WINDOW = 4096
END = 2
FAN = 64
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts; the ids of each distinct pre-token are asked of the library once and remembered."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.path, self.most = path, most
        self.tokenizer, _, self.specials = vocabulary(path)
        self.names = str.maketrans(dict(enumerate(byte_names())))
        self.clear()

    def clear(self) -> None:
        self.seen = np.zeros(1, dtype=np.uint64)
        self.place = np.zeros(1, dtype=np.int64)
        self.size = np.zeros(1, dtype=np.int64)
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with ``END`` after them."""
        pre = PreTokens(texts, self.path)
        start, end, hashes, which = pre.distinct()
        if len(self.seen) > self.most:
            self.clear()
        at = np.minimum(np.searchsorted(self.seen, hashes), len(self.seen) - 1)
        new = self.seen[at] != hashes
        if new.any():
            data = pre.data.tobytes()
            got = [[t.id for t in self.tokenizer.model.tokenize(data[a:b].decode("latin-1").translate(self.names))] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            flat = np.array([i for ids in got for i in ids], dtype=np.uint32)
            size = np.array([len(ids) for ids in got], dtype=np.int64)
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros(max(len(flat), len(self.pool)), dtype=np.uint32)))
            self.pool[self.used : self.used + len(flat)] = flat
            put = np.searchsorted(self.seen, hashes[new])
            self.seen = np.insert(self.seen, put, hashes[new])
            self.place = np.insert(self.place, put, self.used + np.cumsum(size) - size)
            self.size = np.insert(self.size, put, size)
            self.used += len(flat)
            at = np.searchsorted(self.seen, hashes)
        size = self.size[at][which]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.pool[np.repeat(self.place[at][which] - total[:-1], size) + np.arange(total[-1])] if len(which) else np.empty(0, dtype=np.uint32)
        words = total[np.concatenate(([0], np.cumsum(pre.last)))[pre.first]]
        out = []
        for i, text in enumerate(texts):
            if pre.special[i]:  # special strings keep their places: the library itself
                own = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                own = ids[words[i] : words[i + 1]]
            out.append(np.append(own, np.uint32(END)))
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Packer:
    """Open windows of one partition. Rows: the columns of ``_PIECE``, and the ids while the window is open."""

    def __init__(self, prefix: int, window: int = WINDOW, open_windows: int = 32, least_cut: int = 16):
        self.prefix, self.window, self.most, self.least = prefix, window, open_windows, least_cut
        self.open: list[list] = []  # [fill, pieces]
        self.done: list[tuple] = []
        self.made = 0

    def emit(self, pieces: list[tuple]) -> None:
        number, offset = self.prefix + self.made, 0
        self.made += 1
        for doc_id, start, ids, doc_tokens in pieces:
            self.done.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, number, offset))
            offset += len(ids)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.window:
            self.emit([(doc_id, start, ids[start : start + self.window], total)])
            start += self.window
        while start < total:
            rest = total - start
            fits = [w for w in self.open if w[0] + rest <= self.window]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
                room = self.window - best[0]
                if room < self.least:
                    self.emit(best[1])
                    self.open.remove(best)
                    continue
                rest = room
            best[1].append((doc_id, start, ids[start : start + rest], total))
            best[0] += rest
            start += rest
            if best[0] == self.window:
                self.emit(best[1])
                self.open = [w for w in self.open if w is not best]

    def rest(self) -> list[tuple]:
        """Merge the open windows, fullest first, into full ones; what is left is less than a window."""
        pieces = [p for w in sorted(self.open, key=lambda w: -w[0]) for p in w[1]]
        self.open = []
        return self.merge(pieces)

    def merge(self, pieces: list[tuple]) -> list[tuple]:
        fill, held = 0, []
        for doc_id, start, ids, total in pieces:
            while len(ids):
                part = ids[: self.window - fill]
                held.append((doc_id, start, part, total))
                fill, start, ids = fill + len(part), start + len(part), ids[len(part) :]
                if fill == self.window:
                    self.emit(held)
                    fill, held = 0, []
        return held

    def last(self, held: list[tuple]) -> None:
        """Cut the very last rest at powers of two."""
        size = sum(len(p[2]) for p in held)
        for bit in reversed(range(size.bit_length())):
            if size >> bit & 1:
                need, taken = 1 << bit, []
                while need:
                    doc_id, start, ids, total = held.pop(0)
                    taken.append((doc_id, start, ids[:need], total))
                    if len(ids) > need:
                        held.insert(0, (doc_id, start + need, ids[need:], total))
                    need -= len(taken[-1][2])
                self.emit(taken)

    def rows(self, group: int, held: list[tuple] | None = None) -> pa.RecordBatch:
        """Emitted pieces, and the pieces of the rest with their ids."""
        done, self.done = self.done, []
        rows = [(*r, group, None) for r in done] + [(d, s, len(i), 0, t, None, k, group, i.astype("<u4").tobytes()) for k, (d, s, i, t) in enumerate(held or [])]
        types = [pa.int64()] * 8 + [pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], names)


def pack(docs: DataFrame, path: str, window: int = WINDOW, open_windows: int = 32, least_cut: int = 16) -> DataFrame:
    """Pieces of all rows of ``docs`` (``doc_id``, ``text``; other columns are ignored) in sequences of ``window`` ids.

    A row's ids are those of the vocabulary file with id 2 after them; null and empty texts have that one id. Repeated
    rows are packed each. Each id lies in one piece. A closed window lacks fewer than ``least_cut`` ids; sequences of
    a power of two come from the last rest only. An empty table gives no piece.
    """
    schema = f"{_PIECE}, part long, ids binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(part << 24, window, open_windows, least_cut)
        for batch in batches:
            for some in slices(batch, 1 << 20):
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), encoder(path).encode(some.column("text").to_pylist()), strict=True):
                    packer.add(doc_id, ids)
                yield packer.rows(part)
        held = packer.rest()
        yield packer.rows(part, held)

    table = cut(texts(docs).mapInArrow(first, schema))
    out, level = [table.where("ids is null")], 0
    parts = table.agg(F.max("part")).first()[0]
    while parts is not None:
        level += 1
        alone, at = parts < FAN, level

        def again(batches: Iterator[pa.RecordBatch], alone: bool = alone, at: int = at) -> Iterator[pa.RecordBatch]:
            group, pieces = None, []

            def close() -> pa.RecordBatch:
                packer = Packer(at << 58 | group << 24, window)
                held = packer.merge(pieces)
                if alone:
                    packer.last(held)
                    held = []
                return packer.rows(group, held)

            for batch in batches:
                for row in batch.to_pylist():
                    if row["part"] != group:
                        if pieces:
                            yield close()
                        group, pieces = row["part"], []
                    pieces.append((row["doc_id"], row["start"], np.frombuffer(row["ids"], dtype="<u4"), row["doc_tokens"]))
            if pieces:
                yield close()

        # A group: at most FAN rests of less than a window each.
        rests = table.where("ids is not null").withColumn("old", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN))
        dealt = rests.repartition(max(1, int(parts) // FAN + 1), "part").sortWithinPartitions("part", "old", "offset")
        table = cut(dealt.select(*table.columns).mapInArrow(again, schema))
        out.append(table.where("ids is null"))
        parts = None if alone else table.agg(F.max("part")).first()[0]
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.drop("part", "ids")
