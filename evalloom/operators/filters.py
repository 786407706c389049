"""Metadata filters that each query brings along, as a column expression and on Arrow batches.

A query's filters are a map from field to a list of values; a missing, null or empty list doesn't filter. One description
of the fields serves both retrievers, so that the filter is applied inside each, before anything is cut to the best k.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fields:
    """How each field filters.

    ``scalars``: the value, as text, is one of the list. ``arrays``: they share a value. ``dates``: the day lies in one of
    the ranges ``D``, ``D..``, ``..D``, ``D..D`` (inclusive). ``intervals`` (field -> start and end column): strict overlap
    with one of ``a-b`` in seconds. ``clocks``: the same on a countdown of ``MM:SS-MM:SS``, bounds in either order.
    A range that can't be read doesn't filter. ``aliases`` are other names of fields.
    """

    scalars: Sequence[str] = ()
    arrays: Sequence[str] = ()
    dates: Sequence[str] = ()
    intervals: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    clocks: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    aliases: Mapping[str, str] = field(default_factory=dict)

    def columns(self) -> list[str]:
        """The metadata columns that filters read."""
        ends = [c for pair in (*self.intervals.values(), *self.clocks.values()) for c in pair]
        return list(dict.fromkeys([*self.scalars, *self.arrays, *self.dates, *ends]))

    def _given(self, name: str, filters: Column) -> Column:
        names = [name, *(a for a, n in self.aliases.items() if n == name)]
        return F.coalesce(*(filters[n] for n in names))

    def matches(self, filters: Column) -> Column:
        """Whether the row's metadata fit the map ``filters``."""
        out = F.lit(True)

        def put(name: str, test) -> None:
            nonlocal out
            given = self._given(name, filters)
            out = out & (given.isNull() | (F.size(given) == 0) | F.coalesce(test(given), F.lit(False)))

        for c in self.scalars:
            put(c, lambda given, c=c: F.array_contains(given, F.col(c).cast("string")))
        for c in self.arrays:
            put(c, lambda given, c=c: F.arrays_overlap(given, F.col(c).cast("array<string>")))
        for c in self.dates:
            put(c, lambda given, c=c: F.exists(given, lambda v: _day_within(F.col(c), v)))
        for parse, fields in ((_seconds, self.intervals), (_clock, self.clocks)):
            for name, (start, end) in fields.items():
                put(name, lambda given, a=start, b=end, parse=parse: F.exists(given, lambda v: _overlap(F.col(a), F.col(b), v, parse)))
        return out

    def mask(self, batch: pa.RecordBatch, filters: Mapping[str, Sequence[str]] | None) -> np.ndarray:
        """``matches`` of one query on each row of a batch."""
        out = np.ones(len(batch), dtype=bool)
        given = {}
        for name, values in (filters or {}).items():
            name = self.aliases.get(name, name)
            if values and not given.get(name):
                given[name] = list(values)
        for name, values in given.items():
            if name in self.scalars:
                out &= _true(pc.is_in(batch.column(name).cast(pa.string()), pa.array(values, pa.string())))
            elif name in self.arrays:
                lists = batch.column(name)
                hit = _true(pc.is_in(lists.flatten().cast(pa.string()), pa.array(values, pa.string())))
                of = pc.list_parent_indices(lists).to_numpy()
                out &= np.bincount(of, weights=hit, minlength=len(batch)) > 0
            elif name in self.dates:
                day = batch.column(name).cast(pa.date32()).cast(pa.int32())
                within = np.zeros(len(batch), dtype=bool)
                for v in values:
                    low, high = (x.strip() for x in (v.split("..", 1) if ".." in v else (v, v)))
                    fits = np.asarray(pc.is_valid(day))
                    for bound, compare in ((low, pc.greater_equal), (high, pc.less_equal)):
                        if bound:
                            fits = fits & _true(compare(day, pa.scalar(bound).cast(pa.date32()).cast(pa.int32())))
                    within |= fits
                out &= within
            elif name in self.intervals or name in self.clocks:
                (start, end), parse = (self.intervals[name], float) if name in self.intervals else (self.clocks[name], _clock_value)
                within = np.zeros(len(batch), dtype=bool)
                for v in values:
                    bounds = _bounds(v, parse)
                    if bounds is None:
                        within[:] = True
                    else:
                        within |= _true(pc.less(batch.column(start).cast(pa.float64()), bounds[1])) & _true(pc.greater(batch.column(end).cast(pa.float64()), bounds[0]))
                out &= within
        return out


def _true(x: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(x, False))


def _day_within(day: Column, text: Column) -> Column:
    day = day.cast("date")
    parts = F.split(text, r"\.\.", 2)
    low, high = F.trim(parts[0]), F.trim(F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise(parts[0]))

    def bound(x: Column, test) -> Column:
        return (x == "") | test(F.try_to_date(x))

    return bound(low, lambda d: day >= d) & bound(high, lambda d: day <= d) & day.isNotNull()


def _seconds(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def _clock(x: Column) -> Column:
    m = F.regexp_extract(F.trim(x), r"^(\d+):(\d+(?:\.\d+)?)$", 1)
    s = F.regexp_extract(F.trim(x), r"^(\d+):(\d+(?:\.\d+)?)$", 2)
    return m.try_cast("double") * 60 + s.try_cast("double")


def _clock_value(x: str) -> float:
    minutes, seconds = x.split(":")
    return int(minutes) * 60 + float(seconds)


def _bounds(text: str, parse) -> tuple[float, float] | None:
    try:
        a, b = (parse(x.strip()) for x in text.split("-")[:2])
    except ValueError:
        return None
    return (min(a, b), max(a, b)) if min(a, b) >= 0 else None


def _overlap(start: Column, end: Column, text: Column, parse) -> Column:
    parts = F.split(text, "-")
    a, b = parse(F.get(parts, F.lit(0))), parse(F.get(parts, F.lit(1)))
    known = a.isNotNull() & b.isNotNull() & (a >= 0) & (b >= 0)
    return F.when(known, (start < F.greatest(a, b)) & (end > F.least(a, b))).otherwise(True)
