"""Operator 8: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character n-grams of a lower-cased text, hashed to bins. Each bin's value is its log
ratio of document frequencies between toxic and clean training texts; a logistic regression weighs these values.

The model is fitted on a bounded sample of labelled rows (parameters ``max_rows`` and ``max_bytes``): whole texts in the
order of the hash of their doc_id, half of both bounds for each class as far as there are any; a text that no longer fits
is passed over. Both classes weigh the same. Tasks count and rank the features, so the driver holds the ``max_features``
chosen ones and, four bytes each, which of these every sampled text has. Scoring reads every whole text and takes nothing
but the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, fresh, map_batches, partitions, slices, texts

ORDERS = (3, 4, 5, 6)
BINS = 1 << 22
_BLOCK = 1 << 16


def grams(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bin of each n-gram, and the text it lies in."""
    points = np.frombuffer("\n".join([*batch, ""]).lower().encode("utf-32-le"), dtype=np.uint32)
    # lower() may lengthen a text, so texts are found again by their lengths after it
    sizes = np.array([len(t.lower()) + 1 for t in batch], dtype=np.int64)
    text = np.repeat(np.arange(len(batch), dtype=np.int32), sizes)
    h = np.zeros(len(points), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            return
        h = (h[: len(points) - n + 1] * np.uint32(0x01000193)) ^ (points[n - 1 :] * np.uint32(0x9E3779B1))
        if n in ORDERS:
            inside = text[: len(h)] == text[n - 1 :]
            bins = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            bins ^= bins >> np.uint32(13)
            yield (bins & np.uint32(BINS - 1))[inside], text[: len(h)][inside]


def present(batch: list[str], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bin) pairs of a batch, sorted by text; ``only``: a flag for each bin that counts."""
    keys = [np.empty(0, dtype=np.int64)]
    for bins, text in grams(batch):
        if only is not None:
            some = only[bins]
            bins, text = bins[some], text[some]
        keys.append(np.unique(text.astype(np.int64) << 32 | bins))
    key = np.unique(np.concatenate(keys))
    return key >> 32, key & 0xFFFFFFFF


@dataclass(frozen=True)
class Model:
    bins: np.ndarray
    weights: np.ndarray
    bias: float

    def __reduce__(self):
        return Model, (self.bins, self.weights, self.bias)

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """For each bin: does it count, and its weight. Made once in each process that scores."""
        flags, weights = np.zeros(BINS, dtype=bool), np.zeros(BINS, dtype=np.float32)
        flags[self.bins], weights[self.bins] = True, self.weights
        return flags, weights

    def scores(self, batch: list[str]) -> np.ndarray:
        flags, weights = self.dense
        text, bins = present(batch, flags)
        z = self.bias + np.bincount(text, weights=weights[bins], minlength=len(batch))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def constant(bias: float) -> Model:
    return Model(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32), bias)


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """``doc_id, toxic, text`` of the training sample, written as a table; one row for each doc_id (the least text)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for k in (0, 1)]
    chosen = cut(picked[0].unionByName(picked[1]))
    # at most max_rows rows of two numbers: the broadcast side is bounded by the parameter
    found = cut(texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    left, fitting = {0: max_bytes // 2, 1: max_bytes // 2}, []
    for row in found.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "toxic", F.octet_length("text").alias("size")).collect():  # at most max_rows
        if row["size"] <= left[row["toxic"]]:
            left[row["toxic"]] -= row["size"]
            fitting.append((row["doc_id"],))
    # rows of a parameter's number, as above
    return found.join(F.broadcast(docs.sparkSession.createDataFrame(fitting, "doc_id long")), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_bytes: int = 16 << 20, max_features: int = 40_000, alpha: float = 2.0) -> Model:
    """Fit on at most ``max_rows`` labelled rows of ``max_bytes`` text bytes outside the held-out fold.

    Labels other than 0 and 1 and rows without doc_id are passed over; a doc_id labelled both ways counts as toxic; of
    several texts with one doc_id the least is read; null texts are empty. Without rows of both classes (or documents of
    them) the score is the same for all texts: 0.5 without any label, else near the one class there is. Columns beside
    ``doc_id``, ``text`` and ``toxic`` are ignored.
    """
    sample = sample_rows(docs, labels, max_rows, max_bytes)
    had = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (had.get(0) and had.get(1)):
        return constant(0.0 if not had else (4.0 if had.get(1) else -4.0))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1 << 20):
                text, bins = present(some.column("text").to_pylist())
                toxic = np.array(some.column("toxic").to_pylist(), dtype=np.int64)[text]
                key, n = np.unique(toxic << 32 | bins, return_counts=True)
                block = (key & 0xFFFFFFFF) // _BLOCK
                order = np.argsort(block, kind="stable")
                edges = np.searchsorted(block[order], np.arange(BINS // _BLOCK + 1))
                parts = [order[i:j] for i, j in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(parts))), pa.array([key[p].tobytes() for p in parts], pa.binary()), pa.array([n[p].astype(np.int32).tobytes() for p in parts], pa.binary())], ["block", "k", "n"]
                )

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block of bins: log-count ratio and strength of the bins that may be chosen."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, k, n in zip(*(batch.column(c).to_pylist() for c in ("block", "k", "n")), strict=True):
                one = total.setdefault(block, np.zeros((2, _BLOCK), dtype=np.int32))
                key = np.frombuffer(k, dtype=np.int64)
                one[key >> 32, (key & 0xFFFFFFFF) - block * _BLOCK] += np.frombuffer(n, dtype=np.int32)
        for block, one in total.items():
            p, q = (one[1] + alpha) / (had[1] + 2 * alpha), (one[0] + alpha) / (had[0] + 2 * alpha)
            strength = np.abs(p - q) / np.sqrt((one.sum(0) + 2 * alpha) / (had[0] + had[1]))
            strength[one.sum(0) < 3] = 0
            some = np.argsort(-strength, kind="stable")[:max_features]
            some = some[strength[some] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(some + block * _BLOCK), pa.array(np.log(p / q)[some]), pa.array(strength[some])], ["bin", "ratio", "strength"])

    spread = cut(sample.repartition(partitions(docs.sparkSession)))
    ranked = spread.repartition(partitions(docs.sparkSession)).mapInArrow(frequencies, "block long, k binary, n binary").repartition("block").mapInArrow(strongest, "bin long, ratio double, strength double")
    # max_features rows of two numbers come to the driver
    features = sorted((r["bin"], r["ratio"]) for r in ranked.orderBy(F.desc("strength"), "bin").limit(max_features).select("bin", "ratio").collect())
    if not features:
        return constant(0.0)
    bins, ratio = np.array([f[0] for f in features], dtype=np.int64), np.array([f[1] for f in features])
    shared = docs.sparkSession.sparkContext.broadcast(bins)

    def chosen_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = np.zeros(BINS, dtype=bool)
        only[shared.value] = True
        for batch in batches:
            for some in slices(batch, 1 << 20):
                text, found = present(some.column("text").to_pylist(), only)
                column = np.searchsorted(shared.value, found).astype(np.int32)
                edges = np.searchsorted(text, np.arange(some.num_rows + 1))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("toxic"), pa.array([column[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["doc_id", "y", "x"])

    y, found = [], []
    for row in spread.mapInArrow(chosen_bins, "doc_id long, y int, x binary").orderBy("doc_id").toLocalIterator():  # at most four bytes for each n-gram of the sample
        y.append(row["y"])
        found.append(np.frombuffer(bytes(row["x"]), dtype=np.int32))
    w, bias = logistic(found, ratio, np.array(y, dtype=np.float64))
    return Model(bins, (w * ratio).astype(np.float32), bias)


def logistic(found: list[np.ndarray], value: np.ndarray, y: np.ndarray, decay: float = 2e-4, epochs: int = 25, rows: int = 256) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression over present features with the given values.

    Adam over batches of ``rows`` texts in a fixed random order, with a falling step; both classes weigh the same.
    """
    weight = np.where(y == 1, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum())) * len(y)
    rng, turn, turns = np.random.default_rng(8), 0, epochs * -(-len(y) // rows)
    w, bias, m, v = np.zeros(len(value)), 0.0, np.zeros(len(value) + 1), np.zeros(len(value) + 1)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), rows):
            some = order[at : at + rows]
            column = np.concatenate([found[k] for k in some])
            row = np.repeat(np.arange(len(some), dtype=np.int32), [len(found[k]) for k in some])
            z = bias + np.bincount(row, weights=(value * w)[column], minlength=len(some))
            error = weight[some] * (1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))) - y[some]) / len(some)
            g = np.append(np.bincount(column, weights=error[row], minlength=len(w)) * value + decay * w, error.sum())
            turn += 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = 0.05 * (1 - 0.9 * turn / turns) * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
            w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``.

    Null and empty texts get the score of a text without features; repeated rows the same score each; very long texts
    are scored whole; other columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features numbers

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared.value.scores(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(texts(docs, held_out(F.col("doc_id")).alias("held_out")), work, "doc_id long, held_out boolean, score double, predicted int", most=1 << 20)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_bytes: int = 16 << 20) -> DataFrame:
    """``score_toxicity`` of every row of ``docs`` by the model that ``fit`` gives; both state the odd cases."""
    return score_toxicity(docs, fit(docs, labels, max_rows, max_bytes))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, with all their columns.

    Null and empty texts have no features; the rest is as in ``score_toxicity``. A model without features, as from an
    empty table of labels or from labels of one class, gives all texts one score and drops none. Columns may have any
    names.
    """
    if not len(model.bins):
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = fresh(docs, "scored")
    hidden = docs.withColumn(name, F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1 << 20, name):
                clean = shared.value.scores(some.column(name).to_pylist()) < 0.5
                yield some.filter(pa.array(clean)).drop_columns([name])

    return hidden.mapInArrow(run, docs.schema)
