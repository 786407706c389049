"""Expressions over option distributions: ``map<string,double>`` columns keyed by option."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = -100.0


def softmax(logits: Column, options: Column, missing: float = MISSING) -> Column:
    """Map of probabilities over ``options``; an option without a value counts as ``missing``; none at all: uniform."""
    value = F.transform(options, lambda o: F.coalesce(F.try_element_at(logits, o), F.lit(missing)))
    top = F.array_max(value)
    grown = F.transform(value, lambda x: F.exp(x - top))
    total = F.aggregate(grown, F.lit(0.0), lambda s, x: s + x)
    n = F.size(options)
    known = F.coalesce(F.size(logits), F.lit(0)) > 0
    return F.map_from_arrays(options, F.when(known, F.transform(grown, lambda x: x / total)).otherwise(F.transform(options, lambda o: F.lit(1.0) / n)))


def brier(probabilities: Column, truth: Column, options: Column) -> Column:
    """Mean over the options of (p - [option is true])^2; a missing p is 0."""
    each = F.transform(options, lambda o: F.pow(F.coalesce(F.try_element_at(probabilities, o), F.lit(0.0)) - F.when(o == truth, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(options)


def random_brier(options: Column) -> Column:
    """(K-1)/K^2: the score of a uniform guess."""
    k = F.size(options)
    return (k - 1) / (k * k)


def best_option(probabilities: Column) -> Column:
    """The option with the highest probability; ties: the first by name."""
    ordered = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("p"), e["key"].alias("k"))))
    return F.when(F.size(ordered) > 0, F.element_at(ordered, 1)["k"])
