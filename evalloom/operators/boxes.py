"""Box tracks: matching, mIoU, suppression, track sets. Boxes: ``clip_id, frame_id, track_id, x1, y1, x2, y2``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.functions.geometry import Box, intersection, iou, union
from evalloom.operators.groups import map_groups, starts, whole_groups

COORDS = ("x1", "y1", "x2", "y2")


def last_wins(boxes: DataFrame, order: str) -> DataFrame:
    """One box for each track and frame: the last by ``order``."""
    keys = ("clip_id", "frame_id", "track_id")
    return boxes.groupBy(*keys).agg(F.max_by(F.struct(*COORDS), order).alias("b")).select(*keys, "b.*")


def frame_pairs(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Every prediction with every true box of the same frame, with ``iou``: an equi-join on clip and frame."""
    p = pred.select("clip_id", "frame_id", F.col("track_id").alias("pred_id"), *(F.col(c).alias(f"p_{c}") for c in COORDS))
    t = truth.select("clip_id", "frame_id", F.col("track_id").alias("truth_id"), *(F.col(c).alias(f"t_{c}") for c in COORDS))
    return p.join(t, ["clip_id", "frame_id"]).withColumn("iou", iou(Box.of("p_"), Box.of("t_")))


def best_match(pairs: DataFrame) -> DataFrame:
    """The best true box of each prediction (ties: the smaller truth_id)."""
    return pairs.groupBy("clip_id", "frame_id", "pred_id").agg(F.max_by("truth_id", F.struct(F.col("iou"), -F.col("truth_id"))).alias("truth_id"), F.max("iou").alias("iou"))


def first_frames(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("clip_id", "track_id").agg(F.min("frame_id").alias("first_frame"))


def first_frame_tracks(boxes: DataFrame) -> DataFrame:
    """Boxes of the tracks that stand in frame 0."""
    return boxes.join(boxes.where("frame_id = 0").select("clip_id", "track_id").distinct(), ["clip_id", "track_id"], "left_semi")


def limit_frames(boxes: DataFrame, n: int, distinct: bool = False) -> DataFrame:
    """``frame_id < n``, or the first n distinct frames of each clip."""
    if not distinct:
        return boxes.where(F.col("frame_id") < n)
    rank = F.dense_rank().over(Window.partitionBy("clip_id").orderBy("frame_id"))
    return boxes.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def _best() -> tuple:
    return (F.desc("iou"), F.desc("truth_id"), F.desc("pred_id"))


def greedy_mapping(pairs: DataFrame, threshold: float) -> DataFrame:
    """One-to-one mapping of tracks by clip: pairs in falling (iou, truth, pred), greedily; those under the threshold go before."""

    def assign(key: tuple, rows: list[tuple]) -> list[tuple]:
        truths, preds, out = set(), set(), []
        for t, p, _ in rows:
            if t not in truths and p not in preds:
                truths.add(t)
                preds.add(p)
                out.append((*key, t, p))
        return out

    clip = pairs.schema["clip_id"].dataType.simpleString()
    some = pairs.where(F.col("iou") >= threshold).select("clip_id", "truth_id", "pred_id", "iou")
    return map_groups(some, ["clip_id"], _best(), assign, f"clip_id {clip}, truth_id long, pred_id long")


def dynamic_mapping(pairs: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """Mapping that grows frame by frame: a true track is mapped in the frame where it first stands, or never."""
    first = first_frames(truth).select("clip_id", F.col("track_id").alias("truth_id"), F.col("first_frame").alias("frame_id"))

    def assign(key: tuple, rows: list[tuple]) -> list[tuple]:
        truths, preds, out = set(), set(), []
        for _, t, p, _ in rows:  # a track's pairs all lie in its first frame
            if t not in truths and p not in preds:
                truths.add(t)
                preds.add(p)
                out.append((*key, t, p))
        return out

    clip = pairs.schema["clip_id"].dataType.simpleString()
    some = pairs.where(F.col("iou") >= threshold).join(first, ["clip_id", "frame_id", "truth_id"], "left_semi").select("clip_id", "frame_id", "truth_id", "pred_id", "iou")
    return map_groups(some, ["clip_id"], (F.asc("frame_id"), *_best()), assign, f"clip_id {clip}, truth_id long, pred_id long")


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Optimal assignment of rows to columns (shortest augmenting paths); cost may be rectangular."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            used[j0] = True
            slack = c[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.argmin(np.where(used, np.inf, least)[1:])) + 1
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(j, i) for i, j in pairs] if flip else pairs


def hungarian_many(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``problem, row, column`` of the optimal assignments of many problems of one shape [problems, rows, columns], in step."""
    flip = cost.shape[1] > cost.shape[2]
    c = cost.transpose(0, 2, 1) if flip else cost
    every, n, m = c.shape
    u, v, match = np.zeros((every, n + 1)), np.zeros((every, m + 1)), np.zeros((every, m + 1), dtype=int)
    for i in range(1, n + 1):
        match[:, 0] = i
        at, live = np.zeros(every, dtype=int), np.arange(every)
        least, used, way = np.full((every, m + 1), np.inf), np.zeros((every, m + 1), dtype=bool), np.zeros((every, m + 1), dtype=int)
        while len(live):
            j0 = at[live]
            used[live, j0] = True
            row, seen, low, back = match[live, j0], used[live], least[live], way[live]
            slack = c[live, row - 1] - u[live, row][:, None] - v[live, 1:]
            better = ~seen[:, 1:] & (slack < low[:, 1:])
            low[:, 1:], back[:, 1:] = np.where(better, slack, low[:, 1:]), np.where(better, j0[:, None], back[:, 1:])
            j1 = np.argmin(np.where(seen, np.inf, low)[:, 1:], axis=1) + 1
            step = low[np.arange(len(live)), j1][:, None]
            b, j = np.nonzero(seen)
            u[live[b], match[live[b], j]] += step[b, 0]
            v[live] = np.where(seen, v[live] - step, v[live])
            least[live], way[live], at[live] = np.where(seen, low, low - step), back, j1
            live = live[match[live, j1] != 0]
        live = np.arange(every)
        while len(live):
            before = way[live, at[live]]
            match[live, at[live]] = match[live, before]
            at[live] = before
            live = live[before != 0]
    b, j = np.nonzero(match[:, 1:])
    i = match[b, j + 1] - 1
    return (b, j, i) if flip else (b, i, j)


def assignments(cost: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``problem, row, column`` of problems of any shapes ``n`` x ``m``, whose costs stand one after the other."""
    start, out = np.cumsum(n * m) - n * m, []
    for shape in sorted(set(zip(n.tolist(), m.tolist(), strict=True))):
        if all(shape):
            who = np.flatnonzero((n == shape[0]) & (m == shape[1]))
            some = cost[start[who][:, None] + np.arange(shape[0] * shape[1])].reshape(-1, *shape)
            # steps of many cost more than those of one
            b, i, j = hungarian_many(some) if len(who) > 2 else np.array([(k, *pair) for k, c in enumerate(some) for pair in hungarian(c)]).T
            out.append((who[b], i, j))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, dtype=int),) * 3


def optimal_assignment(pairs: DataFrame, limit: float) -> DataFrame:
    """By clip and frame: the assignment of least total (1 - iou), pairs over ``limit`` left out.

    The frames of a batch are solved together; a task holds a batch or one frame.
    """
    keys = ["clip_id", "frame_id"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, keys):
            first = starts(rows, keys)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
            truth, pred, x = (rows.column(c).to_numpy() for c in ("truth_id", "pred_id", "iou"))
            (t, n), (p, m) = _places(of, truth, len(first)), _places(of, pred, len(first))
            start = np.cumsum(n * m) - n * m
            at, cost = start[of] + t * m[of] + p, np.full(int((n * m).sum()), 1.0)
            cost[at] = 1 - x
            b, i, j = assignments(np.minimum(cost, limit + 1e-6), n, m)
            got = cost[start[b] + i * m[b] + j]
            b, i, j, got = (y[got <= limit] for y in (b, i, j, got))
            of_truth, of_pred = (np.zeros(int(k.sum()), dtype=np.int64) for k in (n, m))
            to_truth, to_pred = np.cumsum(n) - n, np.cumsum(m) - m
            of_truth[to_truth[of] + t], of_pred[to_pred[of] + p] = truth, pred
            out = [*(rows.column(k).take(pa.array(first[b])) for k in keys), pa.array(of_truth[to_truth[b] + i]), pa.array(of_pred[to_pred[b] + j]), pa.array(1 - got)]
            yield pa.RecordBatch.from_arrays(out, [*keys, "truth_id", "pred_id", "iou"])

    types = {c: pairs.schema[c].dataType.simpleString() for c in keys}
    rows = pairs.select(*keys, F.col("truth_id").cast("long"), F.col("pred_id").cast("long"), "iou")
    schema = f"clip_id {types['clip_id']}, frame_id {types['frame_id']}, truth_id long, pred_id long, iou double"
    return rows.repartition(*keys).sortWithinPartitions(*keys, "truth_id", "pred_id").mapInArrow(solve, schema)


def _places(of: np.ndarray, ids: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of each id among the distinct ids of its group, and how many these are."""
    order = np.lexsort((ids, of))
    o, x = of[order], ids[order]
    new = np.append(True, (o[1:] != o[:-1]) | (x[1:] != x[:-1]))
    n = np.bincount(o[new], minlength=groups)
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.cumsum(new) - 1 - (np.cumsum(n) - n)[o]
    return place, n


def ordered_matches(pairs: DataFrame, threshold: float) -> DataFrame:
    """First come, first served: each true box in order takes its best free prediction at the threshold or above."""

    def take(key: tuple, rows: list[tuple]) -> list[tuple]:
        truths, preds, out = set(), set(), []
        for t, p, x in rows:
            if t not in truths and p not in preds:
                truths.add(t)  # its best free one; below the threshold it stays without
                if x >= threshold:
                    preds.add(p)
                    out.append((*key, t, p, x))
        return out

    clip = pairs.schema["clip_id"].dataType.simpleString()
    rows = pairs.select("clip_id", "truth_id", "pred_id", "iou")
    return map_groups(rows, ["clip_id"], ("truth_id", F.desc("iou"), "pred_id"), take, f"clip_id {clip}, truth_id long, pred_id long, iou double")


def aligned(pred: DataFrame, truth: DataFrame, mapping: DataFrame) -> DataFrame:
    """Full outer join of tracks by frame under a mapping: matched, prediction only, truth only."""
    p = pred.join(mapping, (pred.clip_id == mapping.clip_id) & (pred.track_id == mapping.pred_id), "left").select(pred.clip_id, "frame_id", F.coalesce(mapping.truth_id, -1 - pred.track_id).alias("pair"), *(F.col(c).alias(f"p_{c}") for c in COORDS), F.lit(True).alias("has_p"))
    t = truth.select("clip_id", "frame_id", F.col("track_id").alias("pair"), *(F.col(c).alias(f"t_{c}") for c in COORDS), F.lit(True).alias("has_t"))
    both = p.join(t, ["clip_id", "frame_id", "pair"], "full_outer")
    return both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_p", "has_t")})


def holistic_miou(pred: DataFrame, truth: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sum of intersections over sum of unions by clip (0 without any union); lone boxes add their area to the union.

    Also the mean over frames of the mean IoU of a frame's pairs, lone boxes as 0.
    """
    both = aligned(pred, truth, mapping)
    p, t = Box.of("p_"), Box.of("t_")
    matched = F.col("has_p") & F.col("has_t")
    inter = F.when(matched, intersection(p, t)).otherwise(F.lit(0.0))
    whole = F.when(matched, union(p, t)).when(F.col("has_p"), p.area).otherwise(t.area)
    each = F.when(matched & (whole > 0), inter / whole).otherwise(F.lit(0.0))
    frames = both.groupBy("clip_id", "frame_id").agg(F.sum(inter).alias("i"), F.sum(whole).alias("u"), F.avg(each).alias("m"))
    return frames.groupBy("clip_id").agg(F.coalesce(F.try_divide(F.sum("i"), F.sum("u")), F.lit(0.0)).alias("holistic_miou"), F.avg("m").alias("frame_mean"), F.count(F.lit(1)).alias("n_frames"))


def video_miou(pred: DataFrame, truth: DataFrame, mapping: DataFrame, penalise: bool = False) -> DataFrame:
    """Mean over frames of the mean IoU of mapped pairs (0 without any); precision, recall and F1 of boxes."""
    both = aligned(pred, truth, mapping)
    matched = F.col("has_p") & F.col("has_t")
    score = F.when(matched, iou(Box.of("p_"), Box.of("t_")))
    n = F.count(F.lit(1)) if penalise else F.count_if(matched)
    frames = both.groupBy("clip_id", "frame_id").agg(F.coalesce(F.try_divide(F.sum(score), n), F.lit(0.0)).alias("m"), F.count_if(matched).alias("tp"), F.count_if("has_p").alias("np"), F.count_if("has_t").alias("nt"))
    out = frames.groupBy("clip_id").agg(F.avg("m").alias("miou"), F.coalesce(F.try_divide(F.sum("tp"), F.sum("np")), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(F.sum("tp"), F.sum("nt")), F.lit(0.0)).alias("recall"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def last_frame_miou(matches: DataFrame, truth_last: DataFrame) -> DataFrame:
    """Mean over the true boxes of the last frame; unmatched ones count 0."""
    t = truth_last.select("clip_id", F.col("track_id").alias("truth_id"))
    return t.join(matches, ["clip_id", "truth_id"], "left").groupBy("clip_id").agg(F.avg(F.coalesce("iou", F.lit(0.0))).alias("last_frame_miou"))


def suppress(boxes: DataFrame, group: Sequence[str], threshold: float, score: str = "score") -> DataFrame:
    """Non-maximum suppression within each group (image and class)."""
    names = [*group, *(c for c in boxes.columns if c not in group)]
    at = [names.index(c) - len(group) for c in COORDS]

    def keep(key: tuple, rows: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for r in rows:
            x1, y1, x2, y2 = (r[k] for k in at)
            for o in kept:
                a1, b1, a2, b2 = (o[k] for k in at)
                inter = max(0.0, min(x2, a2) - max(x1, a1)) * max(0.0, min(y2, b2) - max(y1, b1))
                if inter > threshold * ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - inter):
                    break
            else:
                kept.append(r)
        return [(*key, *r) for r in kept]

    return map_groups(boxes.select(*names), group, (F.desc(score), "track_id"), keep, boxes.select(*names).schema)


def join_tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of tracks; where both have one, that of ``a``."""
    return a.unionByName(b.join(a.select("clip_id", "track_id").distinct(), ["clip_id", "track_id"], "left_anti").select(*a.columns))


def subtract_tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("clip_id", "track_id").distinct(), ["clip_id", "track_id"], "left_anti")


def drop_duplicate_tracks(a: DataFrame, b: DataFrame, near: float = 0.05, age: str = "age") -> tuple[DataFrame, DataFrame]:
    """Tracks of two lists with IoU distance under ``near`` in the same clip: the younger one goes (ties: that of ``a``)."""
    left = a.select("clip_id", F.col("track_id").alias("ta"), F.col(age).alias("age_a"), *(F.col(c).alias(f"p_{c}") for c in COORDS))
    right = b.select("clip_id", F.col("track_id").alias("tb"), F.col(age).alias("age_b"), *(F.col(c).alias(f"t_{c}") for c in COORDS))
    dup = left.join(right, "clip_id").where(1 - iou(Box.of("p_"), Box.of("t_")) < near)
    gone_a = dup.where("age_a <= age_b").select("clip_id", F.col("ta").alias("track_id")).distinct()
    gone_b = dup.where("age_a > age_b").select("clip_id", F.col("tb").alias("track_id")).distinct()
    return a.join(gone_a, ["clip_id", "track_id"], "left_anti"), b.join(gone_b, ["clip_id", "track_id"], "left_anti")


def dense_frames(boxes: DataFrame, frames: int, fill_forward: bool = True) -> DataFrame:
    """One row for each (clip, track, frame below ``frames``): gaps take the last box before them (or zeros)."""
    tracks = boxes.select("clip_id", "track_id").distinct()
    spine = tracks.select("clip_id", "track_id", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame_id"))
    out = spine.join(boxes.select("clip_id", "track_id", "frame_id", F.struct(*COORDS).alias("b")), ["clip_id", "track_id", "frame_id"], "left")
    if fill_forward:
        order = Window.partitionBy("clip_id", "track_id").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn("b", F.last("b", ignorenulls=True).over(order))
    return out.select("clip_id", "track_id", "frame_id", *(F.coalesce(F.col(f"b.{c}"), F.lit(0.0)).alias(c) for c in COORDS))


def wide_frames(dense: DataFrame) -> DataFrame:
    """``clip_id, frame_id, values``: the coordinates of all tracks in the order of their ids."""
    row = F.array_sort(F.collect_list(F.struct("track_id", F.array(*COORDS).alias("v"))))
    return dense.groupBy("clip_id", "frame_id").agg(F.flatten(F.transform(row, lambda x: x["v"])).alias("values"))
