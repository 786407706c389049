"""Search: filters twice, blocks, the persisted index and its increments, re-ranking."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalloom.operators import blocks, search
from evalloom.operators.filters import Fields

FIELDS = Fields(scalars=("kind", "year"), arrays=("teams",), dates=("day",), intervals={"window": ("a", "b")}, clocks={"left": ("low", "high")}, aliases={"season": "year"})


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(1)
    rows = []
    for k in range(200):
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randint(0, 60))
        some = [rng.choice("xyz") for _ in range(rng.randint(0, 2))]
        a, low = rng.uniform(0, 90), rng.randint(0, 700)
        rows.append((k, rng.choice(["p", "q", None]), rng.choice([2023, 2024]), rng.choice([some, None]), rng.choice([day, None]), a, a + 5.4, low, low + 6, [rng.gauss(0, 1) for _ in range(4)] if k % 11 else None))
    return spark.createDataFrame(rows, "item_id long, kind string, year int, teams array<string>, day date, a double, b double, low int, high int, v array<double>")


@pytest.fixture(scope="module")
def queries(spark):
    filters = [None, {}, {"kind": []}, {"kind": ["p"]}, {"season": ["2024"], "kind": ["q", "p"]}, {"teams": ["x", "y"]}, {"day": ["2024-01-10..2024-01-20", "2024-02-01"]}, {"day": ["..2024-01-15"]}, {"day": ["2024-02-10.."]}, {"window": ["30-40.5"]}, {"window": ["broken"]}, {"left": ["10:00-08:45.5", "0:00-1:00"]}, {"kind": ["none"]}]
    rng = random.Random(2)
    return spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)], f) for k, f in enumerate(filters)], "query_id long, qv array<double>, filters map<string,array<string>>")


def test_filters_as_columns_and_on_batches(items, queries):
    got = {(r["query_id"], r["item_id"]) for r in queries.join(items, FIELDS.matches(F.col("filters"))).select("query_id", "item_id").collect()}
    batch = pa.Table.from_batches(items.toArrow().to_batches()).combine_chunks().to_batches()[0]
    ids = np.array(batch.column("item_id").to_pylist())
    sizes = {}
    for q in queries.collect():
        assert {i for k, i in got if k == q["query_id"]} == set(ids[FIELDS.mask(batch, q["filters"])].tolist())
        sizes[q["query_id"]] = int(FIELDS.mask(batch, q["filters"]).sum())
    assert sizes[0] == sizes[1] == sizes[2] == sizes[10] == 200 and sizes[12] == 0 and all(0 < sizes[k] < 200 for k in (3, 4, 5, 6, 7, 8, 9, 11))


@pytest.mark.parametrize("carried", [blocks.CARRIED, 0])
def test_block_top_k_equals_brute_force(items, queries, carried, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 3)
    got = sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in blocks.block_top_k(queries, items, 4, fields=FIELDS, carried=carried).collect())
    batch = pa.Table.from_batches(items.toArrow().to_batches()).combine_chunks().to_batches()[0]
    rows, expected = batch.to_pylist(), []
    for q in queries.collect():
        scored = [(-round((float(np.dot(q["qv"], r["v"])) + 1) / 2, 4), r["item_id"]) for r, ok in zip(rows, FIELDS.mask(batch, q["filters"]), strict=True) if ok and r["v"] is not None]
        expected += [(q["query_id"], k, i, -s) for k, (s, i) in enumerate(sorted(scored)[:4])]
    assert got == sorted(expected)
    assert blocks.block_top_k(queries, items.limit(0), 4, fields=FIELDS, carried=carried).count() == 0
    assert blocks.block_top_k(queries.limit(0), items, 4, fields=FIELDS, carried=carried).count() == 0


def test_rerank_scores_only_the_first_k(spark, items, queries):
    seen = spark.sparkContext.accumulator(0)

    def scorer():
        def score(rows):
            seen.add(len(rows))
            return [float(r["doc"] % 7) for r in rows]

        return score

    first = blocks.block_top_k(queries, items, 30)
    got = blocks.rerank(first.withColumn("d", F.col("item_id")), 5, scorer, {"d": "doc"}).collect()
    best = {(r["query_id"], r["item_id"]) for r in first.where("rank < 5").collect()}
    assert {(r["query_id"], r["item_id"]) for r in got} == best and len(got) == seen.value == 5 * 13
    for q in range(13):
        mine = sorted((r["rank"], -r["score"], r["item_id"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(5)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(3)
    words = "goal save shot pass foul late early home away win".split()
    rows = [(k, k // 3, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9))), [rng.gauss(0, 1) for _ in range(3)] if k % 5 else None, rng.choice(["r", "s"])) for k in range(60)]
    rows += [(60, 20, None, None, "r"), (61, 20, "", None, "s"), (62, 20, "goal goal", None, "t"), (62, 20, "a second row of it", None, "t"), (None, 1, "lost", None, "r")]
    return spark.createDataFrame([(*r, "x") for r in rows], "node_id long, doc_id long, content string, v array<double>, kind string, term string")


def tables(index, names=("nodes", "postings", "frequencies", "lengths")):
    drop = {"shard"}
    sums = {"frequencies": ["term"], "lengths": []}
    out = {}
    for n in names:
        t = index._table(n).drop(*drop)
        t = t.groupBy(*sums[n]).agg(*(F.sum(c).alias(c) for c in t.columns if c not in sums[n])) if n in sums else t
        out[n] = sorted(map(repr, t.collect()))
    return out


def test_ingest_is_idempotent_and_survives_a_crash(spark, nodes, tmp_path, monkeypatch):
    fields = Fields(scalars=("kind",))
    once = search.SearchIndex(spark, str(tmp_path / "once"), fields, 3)
    assert once.ingest(nodes, "all") and not once.ingest(nodes, "all")
    twice = search.SearchIndex(spark, str(tmp_path / "twice"), fields, 3)
    assert twice.ingest(nodes.where("node_id < 25 or node_id is null"), "a")
    with monkeypatch.context() as m:  # dies before the increment is committed
        m.setattr(type(spark), "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            twice.ingest(nodes.where("node_id < 40"), "b")
    twice.refresh()
    assert twice.increments() == ["a"] and twice.nodes().count() == 25
    twice.ingest(nodes.where("node_id < 40"), "b")
    twice.ingest(nodes, "c")
    assert tables(once) == tables(twice)


def test_stream_into_the_index(spark, nodes, tmp_path):
    fields = Fields(scalars=("kind",))
    nodes.repartition(3).write.parquet(str(tmp_path / "in"))
    index = search.SearchIndex(spark, str(tmp_path / "index"), fields, 3)
    stream = spark.readStream.schema(nodes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(lambda rows, k: index.ingest(rows, f"batch{k}")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    index.refresh()
    assert index.nodes().count() == 63 and len(index.increments()) == 3
    # node 62 came twice, with other contents: one of them is in
    assert index._table("lengths").agg(F.sum("n")).first()[0] == 61


def test_documents(spark, nodes, tmp_path):
    fields = Fields(scalars=("kind",))
    index = search.SearchIndex(spark, str(tmp_path / "index"), fields, 3)
    index.ingest(nodes, "all")
    rows = [(1, "late goal", [1.0, 0.0, 0.0], None), (2, "goal", None, {"kind": ["s"]}), (3, "None", None, {"kind": ["t"]}), (4, "", None, {}), (5, None, None, None), (6, "zzz", None, {"kind": ["r"]})]
    queries = spark.createDataFrame(rows, "query_id long, query string, qv array<double>, filters map<string,array<string>>")
    got = index.documents(queries, 3, longest=20).collect()
    by = {q: sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"]) for q in range(1, 7)}
    assert len(by[1]) == 3 and by[1][0]["rrf"] >= by[1][1]["rrf"] and all(len(r["highlights"]) <= 20 + len(" ... (truncated)") for r in got)
    kinds = {r["doc_id"] for r in nodes.where("kind = 's' and content like '%goal%'").select("doc_id").collect()}
    assert by[2] and all(r["doc_id"] in kinds and r["semantic"] is None and r["bm25"] for r in by[2])
    assert [(r["doc_id"], r["rrf"]) for r in by[3]] == [(20, None)] and not by[4] and not by[5] and not by[6]
    assert index.documents(queries.limit(0), 3).count() == 0
    assert index.lexical(queries.where("query_id = 1"), 2).count() == 2


@pytest.mark.parametrize("carried", [blocks.CARRIED, 0])
def test_ranks_by_blocks_equal_brute_force(spark, carried, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 5)
    monkeypatch.setattr(blocks.Best, "ROWS", 4)
    monkeypatch.setattr(blocks.Best, "COLUMNS", 7)
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 3), [rng.choice([-0.6, 0.0, 0.6, 0.8]) for _ in range(3)]) for k in range(60)]  # many ties
    items = spark.createDataFrame(rows, "item_id long, label int, v array<double>")
    asked = items.where("item_id % 3 = 0").selectExpr("item_id as query_id", "label", "v as qv")
    dots = {(q, i): sum(x * y for x, y in zip(v, w, strict=True)) for q, _, v in rows[::3] for i, _, w in rows}
    label = {i: g for i, g, _ in rows}
    score = {p: round((s + 1) / 2, 4) for p, s in dots.items()}
    expected = {}
    for q in range(0, 60, 3):
        if truths := [(score[q, i], i) for i in label if i != q and label[i] == label[q]]:
            expected[q] = sum((score[q, i], i) > max(truths) for i in label if i != q)
    assert {r["query_id"]: r["rank"] for r in blocks.best_truths(asked, items, carried=carried).collect()} == expected
    least = asked.withColumn("least", F.round(F.aggregate("qv", F.lit(0.0), lambda s, x: s + x) * 0.6, 9))
    got = {r["query_id"]: r["n"] for r in blocks.counts_above(least, items, carried=carried).collect()}
    bounds = {r["query_id"]: r["least"] for r in least.collect()}
    assert got == {q: sum(round(dots[q, i], 9) > bounds[q] and label[i] != label[q] for i in label) for q in bounds}


def test_lexical_scores_where_the_node_lies(spark, nodes, tmp_path, monkeypatch):
    index = search.SearchIndex(spark, str(tmp_path / "index"), Fields(scalars=("kind",)), 3)
    index.ingest(nodes.where("node_id < 30"), "a")
    index.ingest(nodes, "b")
    rows = [(1, "late goal", None), (2, "goal shot", {"kind": ["s"]}), (3, "a second row of goal", {"kind": ["t", "r"]}), (4, "zzz", None), (5, "", None)]
    queries = spark.createDataFrame(rows, "query_id long, query string, filters map<string,array<string>>")
    monkeypatch.setattr(search, "HELD", 12)
    for asked, where in ((queries, None), (queries.drop("filters"), None), (queries, F.col("doc_id") % 2 == 0), (queries.drop("filters"), F.col("doc_id") % 2 == 0)):
        found = index.lexical(asked, 4, where)
        with monkeypatch.context() as m:
            m.setattr(search, "CARRIED", 0)
            joined = index.lexical(asked, 4, where)
        assert sorted(map(tuple, found.select("query_id", "node_id", "score", "rank").collect())) == sorted(map(tuple, joined.select("query_id", "node_id", "score", "rank").collect()))
        assert found.count() >= 9
    # a pair of a query and a node isn't shuffled before it is among a task's best
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in plan(index.lexical(queries, 4)) and "Aggregate [query_id" in plan(joined)
