"""Exact vector search in Arrow blocks, and re-ranking with a model behind a boundary.

Tasks score blocks of items against a block of queries as one matrix product and keep the best k of each query, so no pair
of a query and an item is ever a row. Few queries travel with the task (their bytes are counted first); more than
``CARRIED`` are dealt with the items by (block of queries, part of items).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.operators.filters import Fields
from evalloom.storage import cut, partitions

#: Bytes of queries that go to every task, and queries of a block where there are more.
CARRIED, BLOCK = 32 << 20, 1024
#: Pairs of a batch that a task gives out.
PAIRS = 1 << 18


class Kept:
    """The best k items of each query so far: higher scores first, then smaller item ids; a score of minus infinity is none."""

    def __init__(self, ids: np.ndarray, k: int, item: str, places: int):
        self.ids, self.k, self.item, self.places = ids, k, item, places
        self.scores, self.items = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)

    def merge(self, who: np.ndarray, scores: np.ndarray, items: np.ndarray) -> None:
        """Take ``scores`` [queries ``who``, ``items``]; only those that can be among the best are rounded and kept."""
        least = self.scores[who, -1]
        unfilled = np.flatnonzero(np.isneginf(least))
        if len(unfilled) and len(items) > self.k:
            least[unfilled] = np.partition(scores[unfilled], -self.k, axis=1)[:, -self.k]
        # what is rounded to the k-th score stays for its ids
        row, column = np.nonzero((scores >= (least - 1.2 * 10.0**-self.places)[:, None]) & (scores > -np.inf))
        if not len(row):
            return
        met, place = np.unique(row, return_inverse=True)
        of = np.concatenate((np.repeat(np.arange(len(met)), self.k), place))
        s = np.concatenate((self.scores[who[met]].ravel(), np.round(scores[row, column], self.places)))
        i = np.concatenate((self.items[who[met]].ravel(), items[column]))
        order = np.lexsort((i, -s, of))
        of, s, i = of[order], s[order], i[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        best = rank < self.k
        self.scores[who[met[of[best]]], rank[best]], self.items[who[met[of[best]]], rank[best]] = s[best], i[best]

    def rows(self) -> pa.RecordBatch:
        q, k = np.nonzero(~np.isneginf(self.scores))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q], pa.int64()), pa.array(self.items[q, k], pa.int64()), pa.array(self.scores[q, k], pa.float64())], ["query_id", self.item, "score"])


def by_filters(given: list) -> list[tuple[dict, np.ndarray]]:
    """Distinct filters and the places of the queries that have them."""
    groups: dict[str, tuple[dict, list[int]]] = {}
    for q, of in enumerate(given):
        filters = dict(of) if of else {}
        groups.setdefault(repr(sorted(filters.items())), (filters, []))[1].append(q)
    return [(filters, np.array(members)) for filters, members in groups.values()]


class Best(Kept):
    """The best k items of each query of a block by its vector.

    Scores are made for ``ROWS`` queries and ``COLUMNS`` items at a time; only those that can be among the best are kept and rounded.
    """

    ROWS, COLUMNS = 1024, 2048

    def __init__(self, asked: pa.Table, k: int, fields: Fields, item: str, places: int):
        super().__init__(asked.column("query_id").to_numpy(), k, item, places)
        self.fields, self.v = fields, matrix(asked.column("qv"))
        self.groups = by_filters(asked.column("filters").to_pylist())

    def add(self, batch: pa.RecordBatch) -> None:
        batch = batch.filter(pa.array(np.asarray(batch.column("v").is_valid())))
        if not len(batch) or not len(self.ids):
            return
        x, items = matrix(batch.column("v")), batch.column(self.item).to_numpy()
        for filters, members in self.groups:
            fit = np.flatnonzero(self.fields.mask(batch, filters))
            for at in range(0, len(fit), self.COLUMNS):
                some = fit[at : at + self.COLUMNS]
                for q in range(0, len(members), self.ROWS):
                    who = members[q : q + self.ROWS]
                    self.merge(who, (self.v[who] @ x[some].T + 1) / 2, items[some])


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles; none may be null."""
    held = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if isinstance(held, pa.ChunkedArray):
        held = pa.concat_arrays(held.chunks) if held.num_chunks else pa.array([], held.type)
    return np.asarray(held.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(held), -1) if len(held) else np.zeros((0, 0))


def over_blocks(asked: DataFrame, offered: DataFrame, item: str, make: Callable[[pa.Table], object], schema: str, carried: int = CARRIED) -> DataFrame:
    """Rows of ``make(block of asked)`` (``add(batch)`` takes items, ``rows()`` gives a batch) for each block of ``asked`` (``query_id, qv``) and part of ``offered``."""
    spark, parts, columns = offered.sparkSession, partitions(offered.sparkSession), asked.columns
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("qv") * 8 + 64).alias("bytes")).first()
    if (size["bytes"] or 0) <= carried:
        block = asked.toArrow()

        def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = make(block)
            for batch in batches:
                state.add(batch)
            yield state.rows()

        return offered.repartition(parts, item).mapInArrow(carry, schema)
    blocks = -(-size["n"] // BLOCK)
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("_kind", F.lit(0))
    offered = offered.withColumn("_part", F.pmod(F.xxhash64(item), F.lit(parts)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_kind", F.lit(1))
    both = asked.unionByName(offered, allowMissingColumns=True)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, waiting = None, None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("_block", "_part", "_kind")), strict=True))
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                if keys[at][:2] != key:
                    if state:
                        yield state.rows()
                    key, state, waiting = keys[at][:2], None, []
                some = batch.slice(at, to - at)
                if keys[at][2] == 0:
                    waiting.append(some.select(columns))
                elif waiting:
                    state = state or make(pa.Table.from_batches(waiting))
                    state.add(some)
                at = to
        if state:
            yield state.rows()

    return both.repartition(parts, "_block", "_part").sortWithinPartitions("_block", "_part", "_kind").mapInArrow(deal, schema)


def block_top_k(queries: DataFrame, items: DataFrame, k: int, item: str = "item_id", fields: Fields | None = None, places: int = 4, carried: int = CARRIED) -> DataFrame:
    """``query_id, item, score, rank``: of each query (``query_id, qv, filters``) the best k items (``item, v``, metadata).

    The score is (1 + dot product) / 2, rounded to ``places``; ties go to the smaller item. Ranks start at 0. Queries and
    items without a vector find nothing. Ids are longs; vectors have one length.
    """
    fields = fields or Fields()
    if clash := {"query_id", "qv", "filters", "v", item, "_block", "_part", "_kind"} & set(fields.columns()):
        raise ValueError(f"metadata columns need other names: {sorted(clash)}")
    asked = queries.where("query_id is not null and qv is not null")
    if "filters" not in asked.columns:
        asked = asked.withColumn("filters", F.lit(None).cast("map<string,array<string>>"))
    asked = asked.select(F.col("query_id").cast("long"), F.col("qv").cast("array<double>").alias("qv"), "filters")
    offered = items.where("v is not null").select(F.col(item).cast("long").alias(item), "v", *fields.columns())
    found = over_blocks(asked, offered, item, lambda block: Best(block, k, fields, item, places), f"query_id long, {item} long, score double", carried)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), item)
    return found.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)


class Counts:
    """Of each query how many items of other labels score above ``least``, where scores are rounded to nine places."""

    def __init__(self, asked: pa.Table, item: str):
        self.ids, self.v, self.item = asked.column("query_id").to_numpy(), matrix(asked.column("qv")), item
        self.labels, self.least = asked.column("label").to_numpy(), asked.column("least").to_numpy()
        self.n = np.zeros(len(self.ids), dtype=np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        x, labels = matrix(batch.column("v")), batch.column("label").to_numpy()
        for at in range(0, len(x), Best.COLUMNS):
            some, of = x[at : at + Best.COLUMNS], labels[at : at + Best.COLUMNS]
            for q in range(0, len(self.ids), Best.ROWS):
                who = slice(q, q + Best.ROWS)
                scores, other = self.v[who] @ some.T, self.labels[who, None] != of[None, :]
                above = (scores > self.least[who, None] + 2e-9) & other
                self.n[who] += above.sum(1)
                row, column = np.nonzero((scores > self.least[who, None] - 2e-9) & other & ~above)
                near = np.zeros(len(row))  # summed in order, as the least was
                for d in range(some.shape[1]):
                    near += self.v[who][row, d] * some[column, d]
                np.add.at(self.n[who], row, np.round(near, 9) > self.least[who][row])

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(self.n)], ["query_id", "n"])


class Truths:
    """Of each query the best other item of its label by (score to four places, id), or how many other items are above ``score, best``."""

    def __init__(self, asked: pa.Table, item: str):
        self.ids, self.v, self.item, self.counting = asked.column("query_id").to_numpy(), matrix(asked.column("qv")), item, "score" in asked.column_names
        if self.counting:
            self.score, self.best = asked.column("score").to_numpy(), asked.column("best").to_numpy()
            self.n = np.zeros(len(self.ids), dtype=np.int64)
        else:
            self.labels = asked.column("label").to_numpy()
            self.score, self.best = np.full(len(self.ids), -np.inf), np.zeros(len(self.ids), dtype=np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        x, items = matrix(batch.column("v")), batch.column(self.item).to_numpy()
        labels = None if self.counting else batch.column("label").to_numpy()
        for at in range(0, len(x), Best.COLUMNS):
            here = slice(at, at + Best.COLUMNS)
            for q in range(0, len(self.ids), Best.ROWS):
                who = slice(q, q + Best.ROWS)
                scores, other = (self.v[who] @ x[here].T + 1) / 2, self.ids[who, None] != items[here][None, :]
                if self.counting:
                    above = (scores > self.score[who, None] + 1e-4) & other
                    self.n[who] += above.sum(1)
                    row, column = np.nonzero((scores > self.score[who, None] - 1e-4) & other & ~above)
                    s, b = np.round(scores[row, column], 4), self.score[who][row]
                    np.add.at(self.n[who], row, (s > b) | ((s == b) & (items[here][column] > self.best[who][row])))
                    continue
                scores = np.where(other & (self.labels[who, None] == labels[here][None, :]), scores, -np.inf)
                least = np.maximum(scores.max(1), self.score[who])
                row, column = np.nonzero((scores >= least[:, None] - 1e-4) & (scores > -np.inf))
                s, i = np.round(scores[row, column], 4), items[here][column]
                last = np.lexsort((i, s, row))
                end = last[np.append(row[last][1:] != row[last][:-1], True)] if len(last) else last
                r, s, i = row[end], s[end], i[end]
                better = (s > self.score[who][r]) | ((s == self.score[who][r]) & (i > self.best[who][r]))
                self.score[who][r[better]], self.best[who][r[better]] = s[better], i[better]

    def rows(self) -> pa.RecordBatch:
        if self.counting:
            return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(self.n)], ["query_id", "n"])
        met = ~np.isneginf(self.score)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[met]), pa.array(self.score[met]), pa.array(self.best[met])], ["query_id", "score", "best"])


def counts_above(queries: DataFrame, items: DataFrame, item: str = "item_id", carried: int = CARRIED) -> DataFrame:
    """``query_id, n`` of ``query_id, qv, label, least``: how many items (``item, v, label``) of other labels have a dot product, to nine places, above ``least``."""
    found = over_blocks(queries, items.where("v is not null and label is not null"), item, lambda block: Counts(block, item), "query_id long, n long", carried)
    return found.groupBy("query_id").agg(F.sum("n").alias("n"))


def best_truths(queries: DataFrame, items: DataFrame, item: str = "item_id", carried: int = CARRIED) -> DataFrame:
    """``query_id, rank`` of ``query_id, qv, label``: how many other items (``item, v, label``) stand above the best one of its label, by score to four places, then the higher id."""
    asked, offered = queries.where("qv is not null"), items.where("v is not null")
    each = over_blocks(asked.where("label is not null"), offered.where("label is not null"), item, lambda block: Truths(block, item), "query_id long, score double, best long", carried)
    best = each.groupBy("query_id").agg(F.max(F.struct("score", "best")).alias("b")).select("query_id", "b.*")
    found = over_blocks(cut(asked.select("query_id", "qv").join(best, "query_id")), offered.select(item, "v"), item, lambda block: Truths(block, item), "query_id long, n long", carried)
    return found.groupBy("query_id").agg(F.sum("n").alias("rank"))


def softmax_over_queries(queries: DataFrame, items: DataFrame, item: str = "item_id", places: int = 6) -> DataFrame:
    """``query_id, item, score`` of all pairs but a row with itself: (1 + dot product) / 2 to four places, times its softmax over the item's queries.

    All queries travel with the tasks, which need every score of an item; a task holds ``PAIRS`` of them at a time.
    """
    block = queries.where("qv is not null").select("query_id", F.col("qv").cast("array<double>").alias("qv")).toArrow()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = block.column("query_id").to_numpy(), matrix(block.column("qv"))
        step = max(1, PAIRS // max(1, len(ids)))
        for batch in batches:
            x, items_ = matrix(batch.column("v")), batch.column(item).to_numpy()
            for at in range(0, len(x) if len(ids) else 0, step):
                of = items_[at : at + step]
                scores = np.round((x[at : at + step] @ v.T + 1) / 2, 4)
                other = of[:, None] != ids[None, :]
                top = np.where(other, scores, -np.inf).max(1, keepdims=True)
                grown = np.where(other, np.exp(scores - np.where(np.isneginf(top), 0, top)), 0)
                row, column = np.nonzero(other)
                total = grown.sum(1, keepdims=True)
                out = np.round(scores * grown / np.where(total > 0, total, 1), places)
                yield pa.RecordBatch.from_arrays([pa.array(ids[column]), pa.array(of[row]), pa.array(out[row, column])], ["query_id", item, "score"])

    offered = items.where("v is not null").select(F.col(item).cast("long").alias(item), "v")
    found = offered.repartition(partitions(items.sparkSession), item).mapInArrow(run, f"query_id long, {item} long, score double")
    # pairs without a vector have no score
    none = F.lit(None).cast("double").alias("score")
    blank = queries.select("query_id").crossJoin(items.where("v is null").select(item)).unionByName(queries.where("qv is null").select("query_id").crossJoin(items.where("v is not null").select(item)))
    return found.unionByName(blank.where(F.col("query_id") != F.col(item)).select("query_id", item, none))


def first_k(queries: DataFrame, items: DataFrame, k: int, item: str = "item_id", fields: Fields | None = None) -> DataFrame:
    """``query_id, item, score, rank``: the first k items, by id, that fit each query's filters; scores are null."""
    none = F.array().cast("array<double>")
    found = block_top_k(queries.withColumn("qv", none), items.withColumn("v", none), k, item, fields)
    return found.withColumn("score", F.lit(None).cast("double"))


def rerank(candidates: DataFrame, k: int, make_scorer: Callable[[], Callable[[list[dict]], list[float]]], inputs: Mapping[str, str], item: str = "item_id", batch: int = 256) -> DataFrame:
    """The best k candidates of each query by its first score, scored again by a model and ranked anew (``first``, ``score``, ``rank``).

    ``make_scorer`` is called once a task and gives a function from rows (the columns ``inputs`` under their new names) to
    scores; it sees k rows a query only. Rows are dealt by (query, item), so no query is bound to one task.
    """
    by_first = Window.partitionBy("query_id").orderBy(F.desc("score"), item)
    chosen = candidates.withColumn("first", F.row_number().over(by_first)).where(F.col("first") <= k).withColumn("first", F.col("score"))
    kept = chosen.select("query_id", item, "first", *inputs).repartition(partitions(candidates.sparkSession), "query_id", item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make_scorer()
        for whole in batches:
            for at in range(0, len(whole), batch):
                some = whole.slice(at, batch)
                rows = some.select(list(inputs)).rename_columns(list(inputs.values())).to_pylist()
                yield pa.RecordBatch.from_arrays([some.column("query_id"), some.column(item), some.column("first"), pa.array(score(rows), pa.float64())], ["query_id", item, "first", "score"])

    types = dict(kept.dtypes)
    scored = kept.mapInArrow(run, f"query_id {types['query_id']}, {item} {types[item]}, first {types['first']}, score double")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), item)) - 1)
