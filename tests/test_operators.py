"""Hand-worked fixtures and invariants of the library's own operators."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import geometry, probability, text
from evalloom.operators import accuracy, boxes, calibration, groups, ranking, retrieval, runs, sampling
from evalloom.sources import readers, sinks


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, (_type(v) for v in values.values()), strict=True)))
    return row.select(column.alias("x")).first()["x"]


def _type(v):
    return "double" if isinstance(v, float) else "long" if isinstance(v, int) else "string"


def test_calibration(spark):
    rows = spark.createDataFrame([({"A": 0.2, "B": 0.8}, "B"), ({"A": 1.0, "B": 0.0}, "B")], "probabilities map<string,double>, truth string")
    got = calibration.calibration_error(calibration.option_samples(rows), 5).first()
    assert got["ce_unweighted"] == pytest.approx(0.32)
    assert got["ce_weighted"] == pytest.approx(0.50)


def test_recall(spark):
    got = ranking.recall(spark.createDataFrame([(0,), (4,), (9,), (60,)], "rank long"), at=(1, 5, 10, 50, 100)).first()
    assert [got[f"r_at_{k}"] for k in (1, 5, 10, 50, 100)] == [25, 50, 75, 75, 100]
    assert got["med_rank"] == 6


def test_fusion_of_two_firsts_is_one(spark):
    a = spark.createDataFrame([(1, 7, 0), (1, 8, 1)], "query_id long, item_id long, rank int")
    top = retrieval.normal_scores(retrieval.fuse([a, a], 1), "rrf").first()
    assert (top["item_id"], top["score"]) == (7, 1.0)


def test_brier(spark):
    p = F.create_map(*(F.lit(x) for x in ("A", 0.7, "B", 0.2, "C", 0.1)))
    options = F.array(*map(F.lit, "ABC"))
    got = spark.range(1).select(probability.brier(p, F.lit("A"), options), probability.random_brier(options)).first()
    assert got[0] == pytest.approx(0.0466667, abs=1e-6)
    assert got[1] == pytest.approx(2 / 9)


def test_iou(spark):
    a = geometry.Box(*map(F.lit, (0.0, 0.0, 2.0, 2.0)))
    b = geometry.Box(*map(F.lit, (1.0, 1.0, 3.0, 3.0)))
    assert spark.range(1).select(geometry.iou(a, b)).first()[0] == pytest.approx(1 / 7)


def test_holistic_with_a_lone_truth(spark):
    schema = "clip_id string, frame_id int, track_id long, x1 double, y1 double, x2 double, y2 double"
    pred = spark.createDataFrame([("c", 0, 1, 0.0, 0.0, 2.0, 2.0)], schema)
    truth = spark.createDataFrame([("c", 0, 1, 1.0, 1.0, 3.0, 3.0), ("c", 0, 2, 5.0, 5.0, 6.0, 7.0)], schema)
    mapping = spark.createDataFrame([("c", 1, 1)], "clip_id string, truth_id long, pred_id long")
    assert boxes.holistic_miou(pred, truth, mapping).first()["holistic_miou"] == pytest.approx(1 / 9)
    own = boxes.greedy_mapping(boxes.frame_pairs(truth, truth), 0.5)
    assert boxes.holistic_miou(truth, truth, own).first()["holistic_miou"] == 1.0


def test_keep_best(spark):
    rows = spark.createDataFrame([("q", 1, False), ("q", 2, True), ("q", 3, False), ("r", 4, True), ("r", 5, True), (None, 6, False), (None, 7, False)], "id string, seq long, ok boolean")
    kept = runs.keep_best(rows, "id", "ok", "seq")
    assert sorted(r["seq"] for r in kept.collect()) == [2, 5, 6, 7]
    assert runs.keep_best(kept, "id", "ok", "seq").count() == kept.count()


def test_coverage(spark):
    got = accuracy.coverage(spark.createDataFrame([("a", 3, 4), ("a", 1, 6)], "g string, got int, total int"), ["g"], "got", "total").where("g = 'overall'").first()
    assert (got["micro"], got["macro"]) == (pytest.approx(0.4), pytest.approx(0.458333, abs=1e-5))


@pytest.mark.parametrize(("said", "told"), [("Right - matches", "Right"), ('{"verdict":"Wrong"}', "Wrong"), ("maybe", None), ("**Right**", None), ("right-hand", None), ('{"verdict": "right"}', None), ("`Wrong`. No", "Wrong"), (" RIGHT:", "Right")])
def test_verdict(spark, said, told):
    assert one(spark, text.verdict(F.col("c")), c=said) == told


def test_clock_and_season(spark):
    rows = spark.createDataFrame([("08:05",), ("x",), (None,), ("10:30:00",), ("a:1",), ("1:",), (" 2 : 1.5 ",)], "c string").select(text.clock_seconds(F.col("c")))
    assert [r[0] for r in rows.collect()] == [485.0, -1.0, -1.0, 630.0, -1.0, -1.0, 121.5]
    rows = spark.createDataFrame([("21-22",), ("99-00",), ("2019",)], "c string").select(text.season_year(F.col("c")))
    assert [r[0] for r in rows.collect()] == [2022, 2000, 2019]


def test_numbered_answers(spark):
    said = "Answer 1: yes\nmore Answer 2: no Answer 3:  "
    assert one(spark, text.numbered_answers(F.col("c")), c=said) == ["yes\nmore", "no", ""]  # blanks after the last mark are an answer


def test_hungarian_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (3, 3), (4, 2), (2, 5), (5, 5)):
        cost = rng.random((n, m))
        pairs = boxes.hungarian(cost)
        assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        small, wide = (cost, False) if n <= m else (cost.T, True)
        best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
        assert sum(cost[i, j] for i, j in pairs) == pytest.approx(best), wide


def test_sampling(spark):
    rows = spark.range(10)
    assert sorted(r["id"] for r in sampling.take(rows, "first:3", "id").collect()) == [0, 1, 2]
    assert sorted(r["id"] for r in sampling.take(rows, "end:25%", "id").collect()) == [7, 8, 9]
    assert sampling.take(rows, "random:4", "id", 3).count() == 4
    sizes = [r["count"] for r in sampling.balanced_chunks(rows, 3, "id").groupBy("chunk").count().orderBy("chunk").collect()]
    assert sizes == [4, 3, 3]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nnot json\n{"x": 2}\n\n')
    good, bad = readers.jsonl(spark, str(tmp_path / "a.jsonl"), "x long")
    assert sorted(r["x"] for r in good.collect()) == [1, 2]
    assert bad.count() == 1
    (tmp_path / "clip.txt").write_text("0,1,0.1,0.2,0.3,0.4,0.9,-1,-1,-1\n\nshort,1\n1,1,0,0,1,1\n")
    b = readers.boxes(spark, str(tmp_path / "clip.txt"))
    assert [(r["clip_id"], r["frame_id"], r["confidence"]) for r in b.orderBy("frame_id").collect()] == [("clip", 0, 0.9), ("clip", 1, 1.0)]
    sinks.boxes_text(b, str(tmp_path / "out"))
    assert readers.boxes(spark, str(tmp_path / "out/*/*.txt")).count() == 2
    (tmp_path / "k1.json").write_text(json.dumps({"a": {"t": "1"}, "b": {"t": "2"}}))
    (tmp_path / "k2.json").write_text(json.dumps({"b": {"t": "3"}}))
    both = readers.keyed_json_union(spark, [str(tmp_path / "k1.json"), str(tmp_path / "k2.json")], "struct<t:string>")
    assert {r["key"]: r["t"] for r in both.collect()} == {"a": "1", "b": "3"}
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "1"}, {"id": "2"}, {"id": "3"}]}))
    assert [r["id"] for r in readers.questions(spark, str(tmp_path / "q.json"), "struct<id:string>", 1, 3).collect()] == ["2", "3"]
    (tmp_path / "list.txt").write_text("/x/a.mp4\n/y/b.mp4\n/z/a.mp4\n")
    assert {r["name"]: r["path"] for r in readers.path_list(spark, str(tmp_path / "list.txt")).collect()} == {"a": "/z/a.mp4", "b": "/y/b.mp4"}


def test_streaming_matches_batch(spark, tmp_path):
    from evalloom.streaming import events

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "b", 3.0)], "ts string, k string, value double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.stream_parquet(spark, str(tmp_path / "in"), "ts timestamp, k string, value double")
    q = events.tumbling(stream, "ts", "1 hour", "k").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    key = lambda r: (r["start"], r["k"])
    assert sorted(spark.table("tumbled").collect(), key=key) == sorted(events.tumbling(rows, "ts", "1 hour", "k").collect(), key=key)


def test_registry_and_steps(spark):
    from evalloom.plans.registry import Registry, Step, close_schema

    r = Registry("task")
    r.add("retrieval", 1, "t3")
    r.add("captions", 2)
    assert r.pick("all") == ["captions", "retrieval"]
    assert r.pick("t3, captions") == ["retrieval", "captions"]
    with pytest.raises(KeyError):
        r.resolve("none")
    both = Step(lambda df: df.where("id > 2")) >> (lambda df: df.where("id < 5"))
    assert [x["id"] for x in both(spark.range(10)).collect()] == [3, 4]
    closed = close_schema({"type": "object", "properties": {"b": {"type": "object", "properties": {}}, "a": {"type": "string"}}})
    assert closed["required"] == ["a", "b"]
    assert closed["properties"]["b"]["additionalProperties"] is False


def test_datasets(spark):
    from evalloom.operators import datasets

    items = spark.createDataFrame([("v1", ["a", "b"], [1, 2], [2, 3]), ("v2", ["c"], None, [4])], "v string, caps array<string>, neg array<int>, hneg array<int>")
    assert [(r["text_idx"], r["item_idx"], r["text"]) for r in datasets.text_map(items, "v", "caps").orderBy("text_idx").collect()] == [(0, 0, "a"), (1, 0, "b"), (2, 1, "c")]
    assert {r["v"]: r["negatives"] for r in datasets.negatives(items, "v", "neg", "hneg").collect()} == {"v1": [1, 2, 3], "v2": [4]}
    nested = spark.createDataFrame([((1, ("x",)),)], "a struct<b:int,c:struct<d:string>>")
    assert datasets.flattened(nested).columns == ["a/b", "a/c/d"]
    assert datasets.prompts(items, "v", ["see {}", "no {}"]).count() == 4


def test_scores_of_judges(spark):
    said = spark.createDataFrame([("Overall Score: 3/4",), ("1 \u2014 **supported 2 \u2014 Contradicted, Supported",), ("Supported",)], "c string").select(text.score_ratio(F.col("c")).alias("s"))
    assert [(r["s"]["got"], r["s"]["total"]) for r in said.collect()] == [(3, 4), (1, 2), (None, None)]
    assert one(spark, text.json_field(F.col("c"), "k"), c='so {"k": "v"} it is') == "v"
    assert one(spark, text.answer_body(F.col("c")), c="a <answer> b\nc </answer>") == "b\nc"
    assert one(spark, text.without_thinking(F.col("c")), c="<think>x</think> y") == "y"
    assert one(spark, text.options_in(F.col("c")), c="Pick b: two A : one (C) D.") == ["A", "B"]


def test_format_table():
    from evalloom.operators.reports import format_table

    assert format_table(["a", "bb"], [["x", 1.5], ["yy", None]]) == "a     bb\n--  ----\nx   1.50\nyy     -"


def test_frame_mean_is_of_pairs_and_lone_boxes(spark):
    schema = "clip_id long, frame_id long, track_id long, x1 double, y1 double, x2 double, y2 double"
    truth = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 2.0, 2.0), (0, 0, 2, 8.0, 8.0, 9.0, 9.0), (1, 0, 1, 1.0, 1.0, 1.0, 1.0)], schema)
    pred = spark.createDataFrame([(0, 0, 1, 0.0, 0.0, 2.0, 2.0), (1, 0, 1, 1.0, 1.0, 1.0, 1.0)], schema)
    mapping = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "clip_id long, truth_id long, pred_id long")
    got = {r["clip_id"]: (r["frame_mean"], r["holistic_miou"]) for r in boxes.holistic_miou(pred, truth, mapping).collect()}
    assert got == {0: (0.5, pytest.approx(0.8)), 1: (0.0, 0.0)}


def test_duplicate_tracks_of_two_lists(spark):
    schema = "clip_id long, track_id long, age long, x1 double, y1 double, x2 double, y2 double"
    a = spark.createDataFrame([(0, 1, 5, 0.0, 0.0, 10.0, 10.0), (0, 2, 3, 50.0, 50.0, 60.0, 60.0), (0, 3, 9, 80.0, 80.0, 90.0, 90.0)], schema)
    b = spark.createDataFrame([(0, 11, 5, 0.0, 0.0, 10.0, 10.0), (0, 12, 2, 50.0, 50.0, 60.0, 60.0), (0, 13, 1, 80.0, 80.0, 90.0, 89.0)], schema)
    left, right = boxes.drop_duplicate_tracks(a, b)
    # equal ages: that of the first list goes; a distance of 0.1 is none of a duplicate
    assert sorted(r["track_id"] for r in left.collect()) == [2, 3]
    assert sorted(r["track_id"] for r in right.collect()) == [11, 13]


def test_listed_paths_are_read_in_splits(spark, tmp_path):
    lines = [f"/{k}/{k % 700}.mp4" for k in range(5000)]
    (tmp_path / "list.txt").write_text("\n".join(lines))
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        assert spark.read.text(str(tmp_path / "list.txt")).rdd.getNumPartitions() > 3
        got = readers.path_list(spark, str(tmp_path / "list.txt"))
        assert "wholetext" not in got._jdf.queryExecution().toString().lower()
        assert {r["name"]: r["path"] for r in got.collect()} == {str(k % 700): f"/{k}/{k % 700}.mp4" for k in range(5000)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_bm25_shuffles_texts_only(spark):
    docs = spark.createDataFrame([(k, f"a b{k % 3} c{k % 5} c{k % 5}") for k in range(40)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b1"), (2, "c2 c3")], "query_id long, query string")
    scored = retrieval.bm25(docs, queries)
    scored.collect()
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan
    assert "WindowGroupLimit" in retrieval.top_k(scored, 3, "doc_id")._jdf.queryExecution().executedPlan().toString()


def test_softmax_of_blocks_equals_a_window(spark):
    from evalloom.operators import blocks, ranking

    items = spark.createDataFrame([(k, [0.1 * (k % 7), 0.6 - 0.1 * (k % 4)] if k != 9 else None) for k in range(30)], "item_id long, v array<double>")
    q = items.where("item_id % 4 = 0 or item_id = 9").selectExpr("item_id as query_id", "v as qv")
    dot = F.aggregate(F.zip_with("qv", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    pairs = q.join(items, F.col("query_id") != F.col("item_id")).select("query_id", "item_id", F.round((dot + 1) / 2, 4).alias("score"))
    expected = {(r[0], r[1]): r[2] for r in ranking.dual_softmax(pairs, "item_id").select("query_id", "item_id", F.round("score", 6)).collect()}
    assert {(r[0], r[1]): r[2] for r in blocks.softmax_over_queries(q, items).collect()} == expected


def test_assignments_of_many_frames_in_step(spark):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    for shape in ((1, 1), (2, 3), (3, 2), (4, 4), (1, 5)):
        cost = np.round(rng.random((40, *shape)), 1)  # many ties
        b, i, j = boxes.hungarian_many(cost)
        for k in range(40):
            assert list(zip(i[b == k].tolist(), j[b == k].tolist(), strict=True)) == boxes.hungarian(cost[k])
            best = min(sum(cost[k][(x, y) if shape[0] <= shape[1] else (y, x)] for x, y in enumerate(p)) for p in itertools.permutations(range(max(shape)), min(shape)))
            assert np.isclose(cost[k][i[b == k], j[b == k]].sum(), best)
    batch = pa.RecordBatch.from_pydict({"k": [None, None, 1, 1, 2, 2, 2, 3]})
    for size in (1, 2, 3, 8):
        whole = list(groups.whole_groups(iter([batch.slice(a, size) for a in range(0, 8, size)]), ["k"]))
        assert [x for w in whole for x in w.column("k").to_pylist()] == batch.column("k").to_pylist()
        held = [set(w.column("k").to_pylist()) for w in whole]
        assert all(not (a & b) for a, b in itertools.combinations(held, 2))
    rows = [(c, f, t, p, float(rng.integers(0, 5)) / 4) for c in range(3) for f in range(4) for t in range(f) for p in range(c + 1)]
    pairs = spark.createDataFrame(rows, "clip_id long, frame_id int, truth_id long, pred_id long, iou double")
    expected = []
    for c in range(3):
        for f in range(1, 4):
            cost = np.array([[1 - next(r[4] for r in rows if r[:4] == (c, f, t, p)) for p in range(c + 1)] for t in range(f)])
            expected += [(c, f, i, j, 1 - cost[i, j]) for i, j in boxes.hungarian(np.minimum(cost, 0.6 + 1e-6)) if cost[i, j] <= 0.6]
    assert sorted(map(tuple, boxes.optimal_assignment(pairs, 0.6).collect())) == sorted(expected)
    assert boxes.optimal_assignment(pairs.limit(0), 0.6).count() == 0


def test_box_folders_are_listed_by_few_tasks(spark, tmp_path):
    rows = [(c, c % 7, 1, 0.5, 1.0, 2.0, 3.0, 1.0) for c in range(40)]
    sinks.boxes_text(spark.createDataFrame(rows, "clip_id int, frame_id int, track_id int, x1 double, y1 double, x2 double, y2 double, confidence double").coalesce(1), str(tmp_path / "out"))
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, context = spark.conf.get(key), spark.sparkContext
    context.setJobGroup("boxes listed", "")
    got = readers.boxes(spark, str(tmp_path / "out"))
    context.setLocalProperty("spark.jobGroup.id", None)
    stages = [s for j in context.statusTracker().getJobIdsForGroup("boxes listed") for s in context.statusTracker().getJobInfo(j).stageIds]
    assert stages and all(context.statusTracker().getStageInfo(s).numTasks <= 16 for s in stages)
    assert spark.conf.get(key) == before and got.count() == 40
    assert readers.boxes(spark, str(tmp_path / "out" / "clip_id=3")).count() == 1
