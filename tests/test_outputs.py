"""Exactly-once outputs through crashes and streams; vectors from real files; transcripts against a plain loop."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.sources import clips, outputs


def test_a_crash_between_both_writes_leaves_no_duplicate(spark, tmp_path, monkeypatch):
    log = outputs.AnswerLog(spark, str(tmp_path / "log"), "id long, said string")
    rows = spark.range(20).select("id", F.concat(F.lit("a"), F.col("id").cast("string")).alias("said"), F.lit(1).alias("more"))
    log.append(rows.where("id < 8"), 0)
    put = outputs.AnswerLog._put

    def dies(self, part, table, batch):
        if table == "ids":
            raise RuntimeError("lost")
        put(self, part, table, batch)

    with monkeypatch.context() as m:
        m.setattr(outputs.AnswerLog, "_put", dies)
        with pytest.raises(RuntimeError):
            log.append(rows.where("id < 14"), 1)
    assert log.rows().count() == 8 and log.pending(rows).count() == 12  # what isn't committed isn't read
    again = outputs.AnswerLog(spark, str(tmp_path / "log"), "id long, said string")
    again.append(rows.where("id < 14"), 1)
    again.append(rows.where("id < 14"), 1)
    again.append(rows.unionByName(rows).unionByName(rows.limit(1).withColumn("id", F.lit(None).cast("long"))), 2)
    assert sorted(tuple(r) for r in again.rows().collect()) == [(k, f"a{k}") for k in range(20)]
    assert again.pending(rows).count() == 0 and outputs.AnswerLog(spark, str(tmp_path / "none"), "id long").rows().count() == 0


def test_a_restarted_stream_appends_once(spark, tmp_path, monkeypatch):
    spark.range(30).select("id", F.lit("x").alias("said")).repartition(3).write.parquet(str(tmp_path / "in"))
    log = outputs.AnswerLog(spark, str(tmp_path / "log"), "id long, said string")

    def run():
        stream = spark.readStream.schema("id long, said string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(log.append).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()

    put, left = outputs.AnswerLog._put, [1]

    def dies_once(self, part, table, batch):
        if table == "ids" and batch == 1 and left:
            left.clear()
            raise RuntimeError("lost")
        put(self, part, table, batch)

    monkeypatch.setattr(outputs.AnswerLog, "_put", dies_once)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert sorted(r["id"] for r in log.rows().collect()) == list(range(30))


def test_worker_rows_and_merge(spark, tmp_path):
    (tmp_path / "results_worker_0.jsonl").write_text('{"id": "b", "n": 1}\n\n{"id": "c", "n"')
    (tmp_path / "results_worker_12.jsonl").write_text('{"id": "b", "n": 2}\n{"n": 3}\nnull\n')
    rows, bad = outputs.worker_rows(spark, str(tmp_path / "*.jsonl"), "id string, n int")
    assert [tuple(r) for r in outputs.merged(rows, "id", "worker").collect()] == [(12, None, 3), (0, "b", 1), (12, "b", 2)]
    assert [r["value"] for r in bad.collect()] == ['{"id": "c", "n"', "null"] or {r["value"] for r in bad.collect()} == {'{"id": "c", "n"', "null"}
    assert {tuple(r) for r in outputs.merged(rows, "id", "worker", last_wins=True).collect()} == {("b", 2), (None, 3)}


def test_vectors_from_files(spark, tmp_path):
    for k in range(6):
        (tmp_path / f"{k % 2:02d}").mkdir(exist_ok=True)
        np.save(tmp_path / f"{k % 2:02d}" / f"c{k}.npy", np.full((1, 3), k, dtype=np.float32))
    np.save(tmp_path / "00" / "flat.npy", np.arange(6.0).reshape(2, 3))
    np.save(tmp_path / "00" / "objects.npy", np.array([{"a": 1}], dtype=object))
    (tmp_path / "00" / "broken.npy").write_bytes(b"no array")
    (tmp_path / "00" / "other.txt").write_text("x")
    files = clips.npy_files(spark, str(tmp_path))
    got = {r["clip_id"]: r["v"] for r in clips.npy_vectors(files).collect()}
    assert got == {**{f"c{k}": [float(k)] * 3 for k in range(6)}, "flat": None, "objects": None, "broken": None}
    assert {r["clip_id"] for r in clips.npy_vectors(clips.npy_files(spark, str(tmp_path), ["01"])).collect()} == {"c1", "c3", "c5"}
    assert clips.bucket_size(files).first()["size"] == 6
    meta = spark.createDataFrame([("c1", "x"), ("c9", "y"), ("broken", "z")], "clip_id string, label string")
    vectors = clips.npy_vectors(files)
    assert [r["clip_id"] for r in clips.clip_nodes(meta, vectors).collect()] == ["c1"]
    assert {(r["clip_id"], r["v"] is None) for r in clips.clip_nodes(meta, vectors, keep_missing=True).collect()} == {("c1", False), ("c9", True), ("broken", True)}
    captions = spark.createDataFrame([("c1", "said"), ("c2", "no")], "clip_id string, text string")
    assert {(r["clip_id"], r["text"]) for r in clips.caption_nodes(meta, captions, keep_missing=True).collect()} == {("c1", "said"), ("c9", ""), ("broken", "")}
    assert clips.caption_nodes(meta, captions).count() == 1


def test_paths_and_logs(spark):
    rows = spark.createDataFrame([("a/b.mp4",), ("/x/c.mp4",), ("store:d.mp4",)], "p string")
    assert [r[0] for r in rows.select(clips.clip_path(F.col("p"), "/root/")).collect()] == ["/root/a/b.mp4", "/x/c.mp4", "store:d.mp4"]
    files = spark.createDataFrame([("/l/12_a.csv",), ("/l/12_b.csv",), ("/l/13_a.csv",), ("/l/9.csv",)], "path string")
    games = spark.createDataFrame([(12,), (9,)], "game_id int")
    assert {tuple(r) for r in clips.logs_of(files, games).collect()} == {("12", "/l/12_b.csv")}


def plain_format(items: list[tuple], segments=None, offset=60) -> str:
    out = []
    for period, transcript in sorted(items):
        out.append(f"\n**Period {period}**")
        for a, b, c in re.findall(r"\[(.*)\..*s -> (.*)\..*s\](.*)\n", transcript + "\n"):
            a, b, c = int(a.strip()), int(b.strip()), c.strip()
            n = 1 if segments is None else sum(period == p and a >= s - offset and b <= e + offset for p, s, e in segments)
            out += [f"[{a}-{b}] {c}"] * n * (3 < len(c) <= 200)
    return "\n".join(out)


@pytest.mark.parametrize("segments", [None, [(1, 0, 10), (1, 5, 70), (2, 500, 600)]])
def test_transcripts_equal_a_plain_loop(spark, segments):
    games = {"g1": [(2, "[0.0s -> 4.1s] to be\n[601.2s -> 610.0s]  long enough"), (1, "noise\n[ 3.9s -> 7.5s] abc\n[100.0s -> 140.2s] kept? " + "x" * 192 + "\n[9.0s -> 12.0s] four" + "\n[70.5s -> 131.0s] out")], "g2": [(0, "")]}
    rows = spark.createDataFrame([(g, p, t) for g, items in games.items() for p, t in items] + [("g3", 1, None)], "game_id string, period int, transcript string")
    parts = None if segments is None else spark.createDataFrame([(g, *s) for g in games for s in segments], "game_id string, period int, start int, end int")
    got = {r["game_id"]: r["text"] for r in clips.formatted_transcripts(rows, parts).collect()}
    assert got == {**{g: plain_format(items, segments) for g, items in games.items()}, "g3": "\n**Period 1**"}
