"""Positions against plain sorting, on any partitioning and without one task for all; names against difflib; sequential dealing."""

from __future__ import annotations

import difflib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from evalloom.functions import geometry, text
from evalloom.operators import entities, logs, positions, sampling
from evalloom.sources import readers, sinks


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(20)]), k, "p") for k in range(500)]
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "a int, b int, _p string").repartition(parts)
        got = positions.numbered(df, ["a", "b"])
        assert [tuple(r)[:3] for r in sorted(got.collect(), key=lambda r: r["position"])] == expected
        assert sorted(r["position"] for r in got.collect()) == list(range(500))
    assert positions.numbered(df.limit(0), ["a"]).columns == ["a", "b", "_p", "position"] and positions.numbered(df.limit(0), ["a"]).count() == 0
    same = positions.numbered(spark.createDataFrame([(1,)] * 50, "a int"), ["a"])
    assert sorted(r["position"] for r in same.collect()) == list(range(50))


def test_no_task_takes_all(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("n"))
    for made in (positions.numbered(df, ["id"]), sampling.replica_shard(df, 3, "id", seed=4), sampling.megabatches(df, 10, "n", "id"), sinks.batch_requests(df.select(F.col("id").cast("string").alias("t")), "t", "m")):
        assert "SinglePartition" not in plan(made) and "single" not in plan(made).lower().replace("singlequote", "")


def test_joined_by_position_checks_lengths(spark):
    a, b = spark.range(10).select("id"), spark.range(100, 110).select(F.col("id").alias("x"))
    got = positions.joined_by_position([(a, ["id"]), (b, [F.desc("x")])]).collect()
    assert sorted((r["id"], r["x"]) for r in got) == [(k, 109 - k) for k in range(10)]
    with pytest.raises(ValueError, match="length"):
        positions.joined_by_position([(a, ["id"]), (b.where("x > 100"), ["x"])])


@pytest.mark.parametrize("seed", [None, 5])
def test_interleaved_keeps_shares_and_orders(spark, seed):
    sizes = [40, 7, 1, 0, 40]
    frames = [spark.range(n).select(F.col("id").alias("k")).repartition(3) for n in sizes]
    got = sorted(positions.interleaved([(f, ["k"]) for f in frames], seed).collect(), key=lambda r: r["position"])
    again = sorted(positions.interleaved([(f.coalesce(1), ["k"]) for f in frames], seed).collect(), key=lambda r: r["position"])
    assert [tuple(r) for r in got] == [tuple(r) for r in again] and len(got) == sum(sizes)
    held = [0] * 5
    for at, r in enumerate(got, 1):
        assert r["k"] == held[r["part"]]
        held[r["part"]] += 1
        for p, n in enumerate(sizes):
            share = Fraction(n, sum(sizes))
            assert abs(held[p] - at * share) <= 1 + share * len(sizes) / 2


def plain_resolve(name: str, canon: list[str], threshold: float = 0.6):
    spelled = {}
    for c in sorted(canon, reverse=True):
        spelled[c.lower()] = c
    low = name.lower()
    if low in spelled:
        return spelled[low]
    if found := difflib.get_close_matches(low, list(spelled), n=1, cutoff=threshold):
        return spelled[found[0]]
    held = sorted(c for c in spelled if low in c or c in low)
    return spelled[held[0]] if held else None


def test_names_equal_difflib(spark):
    rng = random.Random(6)
    words = "los angeles lakers clippers golden state warriors boston celtics fc bayern ab a é 76ers".split()
    canon = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))).title() for _ in range(80)} | {"LA", "la", "X"})
    names = [rng.choice(canon) for _ in range(30)] + [c.upper() for c in canon[:5]] + ["zzz", "Q", "x marks", "celt", "the boston celtics of boston", "a", "76"]
    for _ in range(120):
        letters = list(rng.choice(canon))
        for _ in range(rng.randint(1, 6)):
            k = rng.randrange(len(letters))
            letters[k : k + rng.randint(0, 2)] = rng.choice(["", "x", "er", " "])
            letters = letters or ["q"]
        names.append("".join(letters))
    rows = spark.createDataFrame([(n,) for n in [*names, None, ""]], "name string").repartition(5)
    got = {r["name"]: r["resolved"] for r in entities.resolve_entities(rows, spark.createDataFrame([(c,) for c in [*canon, ""]], "canonical string")).collect()}
    assert got == {**{n: plain_resolve(n, canon) for n in names if n}, None: None, "": None}
    pairs = {(r["name"], r["known"]) for r in entities.close_names(rows, spark.createDataFrame([(c,) for c in canon], "canonical string")).collect()}
    lows = {c.lower() for c in canon}
    assert pairs == {(n, c) for n in {x.lower() for x in names if x} for c in lows if difflib.SequenceMatcher(None, c, n).ratio() >= 0.6}


def test_canonical_names(spark):
    df = spark.createDataFrame([([["A", " "], None, ["B"]], "C"), (None, None)], "p array<array<string>>, t string")
    assert sorted(r[0] for r in entities.canonical_names(df, "p", "t").collect()) == ["A", "B", "C"]


def test_even_chunks_equal_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(b, k, rng.randint(1, 50), "c") for b, n in (("x", 12), ("y", 13), ("z", 4)) for k in range(n)]
    got = {(r["b"], r["k"]): r["to"] for r in sampling.even_chunks(spark.createDataFrame(rows, "b string, k int, n int, _rows string"), "b", 4, "n", "k").withColumnRenamed("chunk", "to").collect()}
    for b in "xyz":
        mine = sorted((r for r in rows if r[0] == b), key=lambda r: (-r[2], r[1]))
        if len(mine) % 4:
            expected = [k % 4 for k in range(len(mine))]
        else:
            weight, held, expected = [0.0] * 4, [0] * 4, []
            for r in mine:
                k = weight.index(min(weight))
                weight[k] += r[2]
                held[k] += 1
                if held[k] == len(mine) // 4:
                    weight[k] = float("inf")
                expected.append(k)
        assert [got[b, r[1]] for r in mine] == expected


def test_values_from_the_cited_formulas(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    assert value(sampling.frame_indices(F.lit(100), F.lit(30.0), 1.0)) == [0, 30, 60, 90]
    assert value(sampling.frame_indices(F.lit(20), F.lit(30.0), 1.0)) == [0] and value(sampling.frame_indices(F.lit(0), F.lit(30.0), 1.0)) is None
    assert value(text.numbered_answers(F.lit("Answer 1: a\nAnswer iv: b\nc Answer 12:d"))) == ["a", "b\nc", "d"]
    assert value(text.numbered_answers(F.lit("Answer 1: a Answer iv: b"), number="[1-5]")) == ["a Answer iv: b"]
    assert tuple(value(text.transcript_line(F.lit("[ 1.50s -> 12.25s]  words x ")))) == (1, 12, "[1-12] words x")
    assert value(text.without_thinking(F.lit("a</think> b</think> c"))) == "b</think> c"
    assert value(text.is_final(F.lit("Well. I cannot find the answer in the provided documents or videos."))) and not value(text.is_final(F.lit("I cannot answer")))
    assert [value(logs.period_seconds(F.lit(x))) for x in ("3_NBA", "6_NCAA Division I", "other")] == [720, 1200, 600]
    box = geometry.Box(F.lit(-3.0), F.lit(2.0), F.lit(1.0), F.lit(90.0))
    c = geometry.clip(box, 50.0, 40.0, 10.0)
    assert [value(x) for x in (c.x1, c.y1, c.x2, c.y2)] == [0.0, 2.0, 10.0, 40.0]


def test_mot_rows(spark, tmp_path):
    lines = ["1,1,0,0,10,20,1,1,0.5", "1,2,0,0,10,20,0,1,0.5", "1,3,5,5,1,1,1,7,0.1", "1,4,5,5,1,1,1,3,-1", "0,5,0,0,1,1,1,1,1", "1,6,0,0,1,1", "2,7,1,1,2,2,0.7", ""]
    (tmp_path / "gt.txt").write_text("\n".join(lines))
    ids = {kind: sorted(r["track_id"] for r in readers.mot_results(spark, str(tmp_path / "gt.txt"), kind).collect()) for kind in ("result", "truth", "ignore")}
    assert ids == {"result": [1, 2, 3, 4, 7], "truth": [1], "ignore": [3, 4]}


def test_names_of_the_same_letters_are_tried_as_one_kind(spark, monkeypatch):
    known = [f"Supplier#{k:09d}" for k in range(0, 400, 3)] + ["abcabc", "cbacba"]
    names = [f"supplier#00{k}" for k in range(0, 400, 7)] + ["abcacb", "acbcab", "abxcabc"]
    rows, canon = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(k,) for k in known], "canonical string")
    sizes = []
    candidates = entities._candidates
    monkeypatch.setattr(entities, "_candidates", lambda *a: sizes.append((a[0].count(), a[1].count())) or candidates(*a))
    got = {r["name"]: r["known"] for r in entities.closest_names(rows, canon).collect()}
    assert got == {n: max((difflib.SequenceMatcher(None, k.lower(), n).ratio(), k.lower()) for k in known)[1] for n in names}
    assert sizes and sizes[0][0] < len(names) and sizes[0][1] < len(known) / 2


def test_sliding_meter_in_blocks_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(sampling, "METER_BLOCK", 64)
    rng = random.Random(8)
    rows = [(rng.choice("ab") if k % 5 else "c", k, float(rng.randint(1, 50))) for k in range(700)]
    got = {r["k"]: r for r in sampling.sliding_meter(spark.createDataFrame(rows, "g string, k long, v double"), "g", ["k"], "v", 9).collect()}
    assert len(got) == 700
    for g in "abc":
        held = []
        for _, k, v in (r for r in rows if r[0] == g):
            held.append(v)
            some = sorted(held[-9:])
            mid = (some[(len(some) - 1) // 2] + some[len(some) // 2]) / 2
            assert (got[k]["median"], got[k]["avg"], got[k]["total"], got[k]["latest"]) == (mid, pytest.approx(sum(some) / len(some)), sum(held), v) and got[k]["global_avg"] == pytest.approx(sum(held) / len(held))
