"""Tracking: filters against plain matrices, matching, and stream against batch."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.streaming import tracking
from evalloom.streaming.tracking import Motion, Settings, Tracker


def matrices(motion: Motion, k: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.zeros((8, 8))
    for c in range(4):
        p[c, c], p[c, c + 4], p[c + 4, c], p[c + 4, c + 4] = motion.var[k, c], motion.cov[k, c], motion.cov[k, c], motion.var_speed[k, c]
    return np.concatenate((motion.mean[k], motion.speed[k])), p


def test_filters_equal_plain_matrices():
    rng = np.random.default_rng(1)
    z = np.column_stack((rng.uniform(0, 500, (5, 2)), rng.uniform(0.2, 2, 5), rng.uniform(10, 90, 5)))
    motion = Motion.start(z)
    step, see = np.eye(8) + np.eye(8, k=4), np.eye(4, 8)
    plain = [matrices(motion, k) for k in range(5)]
    for _ in range(6):
        still = rng.random(5) < 0.3
        motion = motion.predict(still)
        for k, (m, p) in enumerate(plain):
            h = m[3]
            m = m.copy()
            if still[k]:
                m[7] = 0
            noise = np.diag(np.array([h / 20, h / 20, 1e-2, h / 20, h / 160, h / 160, 1e-5, h / 160]) ** 2)
            plain[k] = step @ m, step @ p @ step.T + noise
        for k, (m, p) in enumerate(plain):
            assert np.allclose(matrices(motion, k)[0], m) and np.allclose(matrices(motion, k)[1], p)
        seen = motion.mean + rng.normal(0, 2, (5, 4)) * [1, 1, 0.01, 1]
        far = motion.distances(seen)
        for k, (m, p) in enumerate(plain):
            s = see @ p @ see.T + np.diag(np.array([m[3] / 20, m[3] / 20, 1e-1, m[3] / 20]) ** 2)
            for j in range(5):
                d = seen[j] - m[:4]
                assert np.isclose(far[k, j], d @ np.linalg.inv(s) @ d)
                assert np.isclose(motion.distances(seen, position_only=True)[k, j], d[:2] @ np.linalg.inv(s[:2, :2]) @ d[:2])
            gain = p @ see.T @ np.linalg.inv(s)
            plain[k] = m + gain @ (seen[k] - m[:4]), p - gain @ s @ gain.T
        motion = motion.update(seen)
        for k, (m, p) in enumerate(plain):
            assert np.allclose(matrices(motion, k)[0], m) and np.allclose(matrices(motion, k)[1], p)


def test_gate_and_fusions():
    motion = Motion.start(np.array([[100.0, 100, 0.5, 40]])).predict(np.array([False]))
    z = np.array([[100.0, 101, 0.5, 40], [300, 100, 0.5, 40]])
    cost = np.array([[0.2, 0.3]])
    assert tracking.gate(cost, motion, z).tolist() == [[0.2, np.inf]]
    assert np.allclose(tracking.fuse_motion(cost, motion, z)[0, 0], 0.98 * 0.2 + 0.02 * motion.distances(z)[0, 0])
    assert np.allclose(tracking.fuse_score(cost, [0.5, 1.0]), [[0.6, 0.3]])


def frames(n: int = 40) -> list[tuple]:
    """Two walkers that pass each other; one is hidden for a while, one fades; and a flash that is seen once."""
    rng = np.random.default_rng(2)
    rows = []
    for f in range(n):
        for who, x, y in ((0, 10 + 4 * f, 50), (1, 200 - 4 * f, 120)):
            if who == 0 and 12 <= f < 18:
                continue
            score = 0.3 if who == 1 and 8 <= f < 12 else 0.9
            dx, dy = rng.normal(0, 0.5, 2).tolist()
            rows.append((f, x + dx, y + dy, x + dx + 30, y + dy + 60, score))
        if f == 20:
            rows.append((f, 400.0, 300.0, 430.0, 360.0, 0.95))
    return rows


def test_tracks_keep_their_numbers():
    tracker, seen = Tracker(Settings()), {}
    by = {}
    for r in frames():
        by.setdefault(r[0], []).append(r[1:])
    for f in sorted(by):
        x = np.array(by[f])
        tracker = Tracker(Settings(), tracker.state()) if f else tracker  # from the kept text each time
        seen[f] = {t: (x1, y1) for t, x1, y1, *_ in tracker.update(f, x[:, :4], x[:, 4])}
    assert all(set(seen[f]) == {1, 2} for f in (0, 5, 10, 25, 39)) and set(seen[14]) == {2}
    top = min(seen[0], key=lambda t: seen[0][t][1])
    assert all(abs(seen[f][top][0] - (10 + 4 * f)) < 6 for f in (5, 25, 39))
    # a flash never becomes sure, a long absence ends a track
    assert not any(len(s) > 2 for s in seen.values())
    assert [t for t, *_ in tracker.update(100, np.array([[170.0, 50, 200, 110]]), np.array([0.9]))] == []
    assert [t.number for t in tracker.tracks] == [4]


def test_gating_rules_out_jumps():
    def ends(gated: bool) -> set[int]:
        tracker = Tracker(Settings(gated=gated, first=1.0))
        for f in range(8):
            tracker.update(f, np.array([[10.0 + f, 10, 40 + f, 90]]), np.array([0.9]))
        return {t for t, *_ in tracker.update(8, np.array([[43.0, 10, 73, 90]]), np.array([0.9]))}

    assert ends(False) == {1} and ends(True) == set()


@pytest.fixture(scope="module")
def detections(spark):
    rows = [(clip, f, *rest) for clip in (1, 2, 3) for f, *rest in frames() if (f + clip) % 7]
    odd = [(1, 3, 5.0, 5.0, 5.0, 9.0, 0.9), (None, 3, 1.0, 1.0, 2.0, 2.0, 0.9), (1, None, 1.0, 1.0, 2.0, 2.0, 0.9), (2, 3, None, 1.0, 2.0, 2.0, 0.9), rows[5]]
    return spark.createDataFrame([(*r, "x") for r in rows + odd], "clip_id long, frame_id int, x1 double, y1 double, x2 double, y2 double, score double, track_id string")


def test_batch_is_the_same_on_any_partitioning(detections):
    got = [sorted(map(tuple, tracking.track(d).collect())) for d in (detections, detections.repartition(7, "x1"), detections.coalesce(1))]
    assert got[0] == got[1] == got[2] and len(got[0]) > 150
    assert tracking.track(detections.limit(0)).count() == 0


def test_stream_equals_batch(spark, detections, tmp_path):
    for k, (low, high) in enumerate(((0, 9), (9, 20), (20, 99))):
        detections.where((F.col("frame_id") >= low) & (F.col("frame_id") < high)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(detections.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        run = tracking.track_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(key)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, tracking.track(detections).collect()))


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_clips_in_step_equal_each_alone(size, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    settings, rows, expected = Settings(gated=True, keep=4), [], []
    for clip in range(60):
        f = int(rng.integers(0, 3))
        alone, places = Tracker(settings), rng.uniform(0, 60, (4, 2))
        for _ in range(int(rng.integers(1, 12))):
            n = int(rng.integers(1, 5))
            x = np.round(np.column_stack((places[rng.integers(0, 4, n)] + rng.normal(0, 1.5, (n, 2)), rng.choice([0.05, 0.3, 0.65, 0.8, 0.9], n))), 1)
            x = x[np.lexsort((x[:, 1], x[:, 0], -x[:, 2]))]
            boxes = np.column_stack((x[:, :2], x[:, 0] + 30, x[:, 1] + 60))
            rows += [(f"c{clip:02}", f, *b, s) for b, s in zip(boxes.tolist(), x[:, 2].tolist(), strict=True)]
            expected += [(f"c{clip:02}", f, *t) for t in alone.update(f, boxes, x[:, 2])]
            alone = Tracker(settings, alone.state())
            f += int(rng.choice([1, 1, 1, 1, 1, 1, 2, 9, 40]))
    names = ["clip_id", "frame_id", "x1", "y1", "x2", "y2", "score"]
    batch = pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    steps, step = [], tracking.Tracks.step
    monkeypatch.setattr(tracking.Tracks, "step", lambda *a: steps.append(1) or step(*a))
    got = [tuple(r.values()) for b in tracking._in_step(iter([batch.slice(k, size) for k in range(0, len(rows), size)]), settings) for r in b.to_pylist()]
    assert sorted(got) == sorted(expected) and len(expected) > 100
    # many clips take as many steps as the longest of them has frames
    assert size < 10_000 or len(steps) <= 11 * (settings.keep + 3)
