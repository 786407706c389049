"""Names to canonical names: exact, by match ratio, by containment, with an index of characters instead of all pairs.

A name is a set of tokens (character, how manieth of its kind). The match ratio 2M / (a + b) counts at most the shared
tokens, so a ratio of t needs t (a + b) / 2 of them and lengths within t / (2 - t) of each other. With tokens in one order, rare
ones first, two names with so many shared tokens share one among the first ones of each (as many as can be missed, and one
more). Only such pairs are compared. Likewise, if one name holds the other, it has the other's rarest token.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.storage import cut


def canonical_names(rows: DataFrame, *columns: str) -> DataFrame:
    """``canonical``: distinct names in columns of text, arrays, or arrays of arrays; nulls and blanks go."""
    out = None
    for c in columns:
        names = F.col(c)
        kind = rows.select(names).schema[0].dataType.simpleString()
        while kind.startswith("array<array<"):
            names, kind = F.flatten(F.filter(names, lambda x: x.isNotNull())), kind[len("array<") : -1]
        one = rows.select((F.explode(names) if kind.startswith("array") else names).alias("canonical"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.length(F.trim("canonical")) > 0).distinct()


def _tokens(lower: Column) -> Column:
    """Array of ``character + count so far`` of a text."""
    letters = F.filter(F.split(lower, ""), lambda x: x != "")
    sorted_ = F.array_sort(letters)
    return F.transform(sorted_, lambda x, i: F.concat(x, (i - F.array_position(sorted_, x).cast("int") + 1).cast("string")))


def _indexed(names: DataFrame, column: str) -> DataFrame:
    """``lower, size, token`` of the distinct lower-cased names."""
    low = names.select(F.lower(column).alias("lower")).where(F.length("lower") > 0).distinct()
    return low.select("lower", F.length("lower").alias("size"), F.explode(_tokens(F.col("lower"))).alias("token"))


@F.pandas_udf(T.DoubleType())
def match_ratio(known: pd.Series, name: pd.Series) -> pd.Series:
    matcher, last, out = SequenceMatcher(), None, []
    for k, n in zip(known, name, strict=True):
        if n != last:
            matcher.set_seq2(n)
            last = n
        matcher.set_seq1(k)
        out.append(matcher.ratio())
    return pd.Series(out, dtype=float)


def _candidates(names: DataFrame, canon: DataFrame, name: str = "name", canonical: str = "canonical", threshold: float = 0.6) -> DataFrame:
    """``name, known`` (lower-cased): all pairs whose match ratio can be ``threshold`` or more, and some others; sorted by name within partitions."""
    asked, known = _indexed(names, name), _indexed(canon, canonical)
    rarity = known.groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    shortest = threshold / (2 - threshold)  # of two lengths over the other

    def heads(index: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lower").orderBy(F.coalesce("seen", F.lit(0)), "token"))
        # the partner has at least `shortest` of the length, so at least this many tokens are shared
        least = F.ceil(threshold * (F.col("size") + F.ceil(F.col("size") * shortest - 1e-9)) / 2 - 1e-9)
        return index.join(rarity, "token", "left").withColumn("place", place).where(F.col("place") <= F.col("size") - least + 1).select("lower", "size", "token")

    a = heads(asked).select("token", F.col("lower").alias("name"), F.col("size").alias("a"))
    b = heads(known).select("token", F.col("lower").alias("known"), F.col("size").alias("b"))
    pairs = a.join(b, "token").where(F.least("a", "b") + 1e-9 >= threshold * (F.col("a") + F.col("b")) / 2).select("name", "known").distinct()
    return pairs.repartition("name").sortWithinPartitions("name")


def close_names(names: DataFrame, canon: DataFrame, name: str = "name", canonical: str = "canonical", threshold: float = 0.6) -> DataFrame:
    """``name, known, ratio`` (lower-cased) of all pairs whose match ratio is ``threshold`` or more."""
    return _candidates(names, canon, name, canonical, threshold).withColumn("ratio", match_ratio("known", "name")).where(F.col("ratio") >= threshold)


def _letters(lower: Column) -> Column:
    """The characters of a text in order: what ``quick_ratio`` sees of it."""
    return F.array_join(F.array_sort(F.split(lower, "")), "")


def _kinds(names: DataFrame, column: str) -> DataFrame:
    """``kind, name``: the distinct lower-cased names with their letters."""
    low = names.select(F.lower(column).alias("name")).where(F.length("name") > 0).distinct()
    return low.select(_letters(F.col("name")).alias("kind"), "name")


def _packed(rows: DataFrame, row: Column, part: str, size: int) -> DataFrame:
    """``kind, part, rows``: the rows of each kind in lists of about ``size``."""
    count = F.count(F.lit(1)).over(Window.partitionBy("kind"))
    return rows.withColumn(part, F.pmod(F.xxhash64("name"), F.ceil(count / size))).groupBy("kind", part).agg(F.sort_array(F.collect_list(row), asc=False).alias("rows"))


def _holds(a: str, b: str) -> bool:
    """Whether the longer text has the letters of the other in order."""
    short, rest = (a, iter(b)) if len(a) < len(b) else (b, iter(a))
    return all(c in rest for c in short)


def _tried(asked: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """``kind, name, ratio, known``: the better of what ``asked`` (the same columns) has and what ``pairs`` (``kind, known_kind, bound``) give.

    Lists of known names come by falling bound, then by their largest name; a name leaves a list where nothing in it can be better.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, key, best = SequenceMatcher(), None, {}
        for batch in batches:
            found = []
            for kind, part, names, lists, bound in zip(*(batch.column(c).to_pylist() for c in ("kind", "part", "names", "lists", "bound")), strict=True):
                if (kind, part) != key:  # a group may go on in the next batch
                    found += [(key[0], n, *b) for n, b in best.items()]
                    key, best = (kind, part), {r["name"]: (r["ratio"], r["known"]) for r in names}
                for name, so_far in best.items():
                    if (bound, lists[0]) <= so_far:
                        continue
                    matcher.set_seq2(name)
                    both = len(name) + len(lists[0])
                    shared = round(bound * both / 2)
                    # one that holds all letters meets the bound only with them in order; else it has one letter less
                    whole = shared in (len(name), len(lists[0]))
                    for limit, in_order in ((bound, True), (2.0 * (shared - 1) / both, False)) if whole else ((bound, None),):
                        for k in lists:
                            if (limit, k) <= so_far:
                                break
                            if in_order is None or in_order == _holds(k, name):
                                matcher.set_seq1(k)
                                so_far = max(so_far, (matcher.ratio(), k))
                    best[name] = so_far
            yield _found(found)
        yield _found([(key[0], n, *b) for n, b in best.items()] if key else [])

    names = _packed(asked, F.struct("name", "ratio", "known"), "part", 64).withColumnRenamed("rows", "names")
    lists = _packed(known, F.col("name"), "known_part", 256).select(F.col("kind").alias("known_kind"), F.col("rows").alias("lists"))
    least = F.array_min(F.transform("names", lambda x: x["ratio"]))
    met = names.join(pairs, "kind").where(F.col("bound") >= least).join(lists, "known_kind")
    dealt = met.repartition("kind", "part").sortWithinPartitions("kind", "part", F.desc("bound"), F.desc(F.col("lists")[0]))
    return dealt.select("kind", "part", "names", "lists", "bound").mapInArrow(run, "kind string, name string, ratio double, known string")


def closest_names(names: DataFrame, canon: DataFrame, name: str = "name", canonical: str = "canonical", threshold: float = 0.6) -> DataFrame:
    """``name, known, ratio`` (lower-cased): of each name the known one of the best match ratio, ``threshold`` or more; of equal ones the larger.

    The upper bound (shared characters) is the same for all names of the same letters, so kinds of letters are paired, not
    names. The known names of the best bound are tried first; only names that other bounds leave open go on to those.
    """
    asked, known = _kinds(names, name), _kinds(canon, canonical)
    mine = cut(asked.select("kind").distinct().select("kind", _tokens(F.col("kind")).alias("a")))
    theirs = cut(known.select(F.col("kind").alias("known_kind")).distinct().select("known_kind", _tokens(F.col("known_kind")).alias("b")))
    met = _candidates(mine, theirs, "kind", "known_kind", threshold).select(F.col("name").alias("kind"), F.col("known").alias("known_kind"))
    # in the order of difflib, so that a bound that is met is equal to the ratio
    bound = 2.0 * F.size(F.array_intersect("a", "b")) / (F.size("a") + F.size("b"))
    pairs = cut(met.join(mine, "kind").join(theirs, "known_kind").select("kind", "known_kind", bound.alias("bound"))).where(F.col("bound") >= threshold)
    tops = pairs.groupBy("kind").agg(F.max("bound").alias("top"))
    first = pairs.join(tops, "kind").where("bound = top").drop("top")
    later = pairs.join(tops, "kind").where("bound < top").drop("top")
    start = asked.select("kind", "name", F.lit(threshold).cast("double").alias("ratio"), F.lit("").alias("known"))
    tried = cut(_tried(start, known, first))
    nexts = later.groupBy("kind").agg(F.max("bound").alias("next"))
    split = tried.join(nexts, "kind", "left")
    open_ = split.where("ratio <= next").drop("next")
    done = split.where("next is null or ratio > next").drop("next")
    return done.unionByName(_tried(open_, known, later)).where("known <> ''").select("name", "known", "ratio")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds, names, ratios, known = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(names, pa.string()), pa.array(ratios, pa.float64()), pa.array(known, pa.string())], ["kind", "name", "ratio", "known"])


def containing_names(names: DataFrame, canon: DataFrame, name: str = "name", canonical: str = "canonical") -> DataFrame:
    """``name, known`` (lower-cased) of all pairs where one holds the other."""
    asked, known = _indexed(names, name), _indexed(canon, canonical)
    rarity = known.groupBy("token").agg(F.count(F.lit(1)).alias("seen"))

    def rarest(index: DataFrame) -> DataFrame:
        by = F.struct(F.coalesce("seen", F.lit(0)), "token")
        return index.join(rarity, "token", "left").groupBy("lower").agg(F.min_by("token", by).alias("token"))

    up = rarest(asked).select("token", F.col("lower").alias("name")).join(known.select("token", F.col("lower").alias("known")), "token").where(F.contains("known", F.col("name")))
    down = rarest(known).select("token", F.col("lower").alias("known")).join(asked.select("token", F.col("lower").alias("name")), "token").where(F.contains("name", F.col("known")))
    return up.select("name", "known").unionByName(down.select("name", "known")).distinct()


def resolve_entities(names: DataFrame, canon: DataFrame, name: str = "name", canonical: str = "canonical", threshold: float = 0.6) -> DataFrame:
    """``name, resolved`` of each distinct name: equal without case, else of the best match ratio, else one that holds it or that it holds.

    Of equal ratios the larger lower-cased name counts, of several containing ones the least, of canonical names that
    differ by case only the least. Names that nothing fits, empty and null ones give null.
    """
    spelled = canon.where(F.length(canonical) > 0).groupBy(F.lower(canonical).alias("known")).agg(F.min(canonical).alias("spelled"))
    asked = names.select(F.col(name).alias("name")).distinct().withColumn("lower", F.lower("name"))
    exact = asked.join(spelled.withColumnsRenamed({"known": "lower", "spelled": "exact"}), "lower", "left")
    rest = exact.where("exact is null and lower is not null").select("lower")
    near = closest_names(rest, canon, "lower", canonical, threshold).select("name", F.col("known").alias("near"))
    far = rest.join(near.select(F.col("name").alias("lower")), "lower", "left_anti")
    held = containing_names(far, canon, "lower", canonical).groupBy("name").agg(F.min("known").alias("held"))
    found = near.join(held, "name", "full").select(F.col("name").alias("lower"), F.coalesce("near", "held").alias("known")).join(spelled, "known").select("lower", "spelled")
    return exact.join(found, "lower", "left").select("name", F.coalesce("exact", "spelled").alias("resolved"))
