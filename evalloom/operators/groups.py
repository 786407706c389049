"""Sequential work on groups of sorted rows, for what can't be expressed relationally."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def map_groups(rows: DataFrame, keys: Sequence[str], order: Sequence, work: Callable[[tuple, list[tuple]], list[tuple]], schema: str | T.StructType) -> DataFrame:
    """``work(key, rows of the group in order)`` for each group; rows are tuples in the columns' order.

    One shuffle by the keys and a sort; groups stream through a task, so a task holds one group at a time and pays no
    conversion for each of many small ones.
    """
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow, n = to_arrow_schema(out), len(keys)
    names = [*keys, *(c for c in rows.columns if c not in keys)]

    def tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*made, strict=True) if made else [[]] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for key, group in groupby(tuples(batches), key=lambda r: r[:n]):
            made += work(key, [r[n:] for r in group])
            if len(made) >= 10_000:
                yield batch()
                made = []
        yield batch()

    return rows.select(*names).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


def starts(rows: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """The places in sorted rows where another group begins."""
    changed = np.zeros(max(len(rows) - 1, 0), dtype=bool)
    for k in keys:
        a, b = rows.column(k).slice(0, len(changed)), rows.column(k).slice(1)
        changed |= np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | (np.asarray(a.is_null()) != np.asarray(b.is_null()))
    return np.append(0, np.flatnonzero(changed) + 1) if len(rows) else np.zeros(0, dtype=np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches of whole groups: the last group of a batch waits for the next one."""

    def joined(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        return some[0] if len(some) == 1 else pa.Table.from_batches(some).combine_chunks().to_batches()[0]

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        if waiting and len(starts(joined([waiting[-1].slice(len(waiting[-1]) - 1), batch.slice(0, 1)]), keys)) == 2:
            yield joined(waiting)
            waiting = []
        last = int(starts(batch, keys)[-1])
        if last:
            yield joined([*waiting, batch.slice(0, last)])
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield joined(waiting)
