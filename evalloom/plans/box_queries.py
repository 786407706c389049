"""Box queries: boxes are made from lineitem by arithmetic (clip: order, frame: line, track: part or supplier class)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.functions import geometry
from evalloom.functions.geometry import Box
from evalloom.operators import boxes
from evalloom.plans.catalog import query
from evalloom.plans.tables import read, rounded
from evalloom.streaming import tracking

_SQL = """WITH l AS (SELECT l_orderkey AS clip_id, (l_linenumber - 1)::INT AS frame_id, l_partkey % 3 AS t, l_suppkey % 3 AS s, (l_partkey % 10)::DOUBLE AS x, (l_suppkey % 10)::DOUBLE AS y FROM lineitem),
truth AS (SELECT clip_id, frame_id, t AS track_id, x AS x1, y AS y1, x + 4 AS x2, y + 5 AS y2 FROM l),
pred AS (SELECT clip_id, frame_id, s AS track_id, x + (s - 1) AS x1, y + 0.5 AS y1, x + 4 + (s - 1) AS x2, y + 5 AS y2 FROM l),
pairs AS (SELECT p.clip_id, p.frame_id, p.track_id AS pred_id, t.track_id AS truth_id, greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1)) AS i,
  (p.x2 - p.x1) * (p.y2 - p.y1) AS ap, (t.x2 - t.x1) * (t.y2 - t.y1) AS tt FROM pred p JOIN truth t USING (clip_id, frame_id)) """


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Predicted and true boxes of all lineitems, as in ``_SQL``."""
    x, y = (F.col("l_partkey") % 10).cast("double"), (F.col("l_suppkey") % 10).cast("double")
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_id"), (F.col("l_linenumber") - 1).alias("frame_id"), (F.col("l_partkey") % 3).alias("t"), (F.col("l_suppkey") % 3).alias("s"), x.alias("x"), y.alias("y"))  # noqa: E741
    truth = l.select("clip_id", "frame_id", F.col("t").alias("track_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 4).alias("x2"), (F.col("y") + 5).alias("y2"))
    shift = F.col("s") - 1
    pred = l.select("clip_id", "frame_id", F.col("s").alias("track_id"), (F.col("x") + shift).alias("x1"), (F.col("y") + 0.5).alias("y1"), (F.col("x") + 4 + shift).alias("x2"), (F.col("y") + 5).alias("y2"))
    return pred, truth


@query(_SQL + "SELECT clip_id, frame_id, pred_id, truth_id, round(CASE WHEN ap + tt - i > 0 THEN i / (ap + tt - i) ELSE 0 END, 6) AS iou FROM pairs")
def frame_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IoU of all boxes of a frame."""
    pred, truth = _boxes(spark, sf_dir)
    return rounded(boxes.frame_pairs(pred, truth).select("clip_id", "frame_id", "pred_id", "truth_id", "iou"))


@query(_SQL + "SELECT clip_id, frame_id, pred_id, max(round(i / (ap + tt - i), 6)) AS iou, arg_max(truth_id, [i / (ap + tt - i), -truth_id]) AS truth_id FROM pairs GROUP BY 1, 2, 3")
def best_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best true box of each prediction."""
    return rounded(boxes.best_match(boxes.frame_pairs(*_boxes(spark, sf_dir))))


_SAME = ", m AS (SELECT clip_id, track_id FROM truth INTERSECT SELECT clip_id, track_id FROM pred) "
_ALIGNED = _SQL + _SAME + """, a AS (SELECT clip_id, frame_id, track_id, p.x1 IS NOT NULL AS hp, t.x1 IS NOT NULL AS ht,
 greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1)) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) AS ap, (t.x2 - t.x1) * (t.y2 - t.y1) AS tt FROM
 (SELECT clip_id, frame_id, track_id, max(x1) AS x1, max(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM pred GROUP BY 1, 2, 3) p FULL JOIN
 (SELECT clip_id, frame_id, track_id, max(x1) AS x1, max(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM truth GROUP BY 1, 2, 3) t USING (clip_id, frame_id, track_id)),
f AS (SELECT clip_id, frame_id, sum(CASE WHEN hp AND ht THEN i ELSE 0 END) AS i, sum(CASE WHEN hp AND ht THEN ap + tt - i WHEN hp THEN ap ELSE tt END) AS u, avg(CASE WHEN hp AND ht THEN i / (ap + tt - i) END) AS m, avg(CASE WHEN hp AND ht AND ap + tt - i > 0 THEN i / (ap + tt - i) ELSE 0 END) AS e,
 count(*) FILTER (WHERE hp AND ht) AS tp, count(*) FILTER (WHERE hp) AS np, count(*) FILTER (WHERE ht) AS nt FROM a GROUP BY 1, 2) """


def _one_box(b: DataFrame) -> DataFrame:
    return b.groupBy("clip_id", "frame_id", "track_id").agg(*(F.max(c).alias(c) for c in boxes.COORDS))


def _identity(pred: DataFrame, truth: DataFrame) -> DataFrame:
    both = truth.select("clip_id", "track_id").intersect(pred.select("clip_id", "track_id"))
    return both.select("clip_id", F.col("track_id").alias("truth_id"), F.col("track_id").alias("pred_id"))


@query(_ALIGNED + "SELECT clip_id, round(coalesce(sum(i) / nullif(sum(u), 0), 0), 6) AS holistic_miou, round(avg(e), 6) AS frame_mean, count(*) AS n_frames FROM f GROUP BY 1")
def holistic_miou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersections over unions with areas of lone boxes, under an identity mapping."""
    pred, truth = map(_one_box, _boxes(spark, sf_dir))
    return rounded(boxes.holistic_miou(pred, truth, _identity(pred, truth)))


@query(_ALIGNED + """, v AS (SELECT clip_id, avg(coalesce(m, 0)) AS miou, coalesce(sum(tp)::DOUBLE / nullif(sum(np), 0), 0) AS p, coalesce(sum(tp)::DOUBLE / nullif(sum(nt), 0), 0) AS r FROM f GROUP BY 1)
SELECT clip_id, round(miou, 6) AS miou, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM v""")
def video_miou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of frame means, precision, recall, F1."""
    pred, truth = map(_one_box, _boxes(spark, sf_dir))
    return rounded(boxes.video_miou(pred, truth, _identity(pred, truth)))


@query(_ALIGNED + "SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(median(x), 6) AS median, count(x) AS n, count(*) - count(x) AS failed FROM (SELECT coalesce(sum(i) / nullif(sum(u), 0), 0) AS x FROM f GROUP BY clip_id)")
def corpus_miou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus summary of the clips' holistic mIoU."""
    from evalloom.operators.accuracy import corpus_summary

    pred, truth = map(_one_box, _boxes(spark, sf_dir))
    return rounded(corpus_summary(boxes.holistic_miou(pred, truth, _identity(pred, truth)), "holistic_miou"))


@query()
def greedy_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one mapping of tracks (sequential; tests hold it against a plain checker)."""
    return boxes.greedy_mapping(boxes.frame_pairs(*_boxes(spark, sf_dir)).where("frame_id = 0"), 0.3)


@query()
def dynamic_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping that grows frame by frame."""
    pred, truth = _boxes(spark, sf_dir)
    return boxes.dynamic_mapping(boxes.frame_pairs(pred, truth), truth, 0.3)


@query()
def optimal_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-cost assignment in each frame."""
    return boxes.optimal_assignment(boxes.frame_pairs(*map(_one_box, _boxes(spark, sf_dir))), 0.7)


@query()
def last_frame_miou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the last frame in the order of the true boxes; unmatched ones count 0."""
    pred, truth = map(_one_box, _boxes(spark, sf_dir))
    last = truth.groupBy("clip_id").agg(F.max("frame_id").alias("frame_id"))
    at_end = truth.join(last, ["clip_id", "frame_id"], "left_semi")
    pairs = boxes.frame_pairs(pred, at_end)
    return boxes.last_frame_miou(boxes.ordered_matches(pairs, 0.3), at_end)


@query()
def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-maximum suppression by clip and frame."""
    pred, _ = _boxes(spark, sf_dir)
    return boxes.suppress(pred.withColumn("score", (F.col("x1") * 7 % 11) / 11), ["clip_id", "frame_id"], 0.5)


@query(_SQL + "SELECT clip_id, track_id, min(frame_id) AS first_frame FROM truth GROUP BY 1, 2")
def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First frame of each track."""
    return boxes.first_frames(_boxes(spark, sf_dir)[1])


@query(_SQL + "SELECT clip_id, track_id, frame_id FROM truth WHERE (clip_id, track_id) IN (SELECT clip_id, track_id FROM truth WHERE frame_id = 0) AND frame_id < 5")
def first_frame_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the tracks of frame 0, the first frames only."""
    return boxes.limit_frames(boxes.first_frame_tracks(_boxes(spark, sf_dir)[1]), 5).select("clip_id", "track_id", "frame_id")


@query(_SQL + "SELECT clip_id, frame_id, track_id, x1 FROM truth UNION ALL SELECT clip_id, frame_id, track_id, x1 FROM pred WHERE (clip_id, track_id) NOT IN (SELECT clip_id, track_id FROM truth)")
def joined_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: union of tracks, the first list wins."""
    pred, truth = _boxes(spark, sf_dir)
    return boxes.join_tracks(truth, pred).select("clip_id", "frame_id", "track_id", "x1")


@query(_SQL + "SELECT clip_id, frame_id, track_id FROM truth WHERE (clip_id, track_id) NOT IN (SELECT clip_id, track_id FROM pred)")
def subtracted_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of one list only."""
    pred, truth = _boxes(spark, sf_dir)
    return boxes.subtract_tracks(truth, pred).select("clip_id", "frame_id", "track_id")


@query(_SQL + """, o AS (SELECT clip_id, track_id, frame_id, max(x1) AS x1 FROM truth GROUP BY 1, 2, 3), k AS (SELECT DISTINCT clip_id, track_id FROM o), s AS (SELECT *, unnest(range(7))::INT AS frame_id FROM k)
SELECT s.clip_id, s.track_id, s.frame_id, coalesce(last_value(x1 IGNORE NULLS) OVER (PARTITION BY s.clip_id, s.track_id ORDER BY s.frame_id ROWS UNBOUNDED PRECEDING), 0) AS x1 FROM s LEFT JOIN o USING (clip_id, track_id, frame_id)""")
def dense_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame of each track, gaps filled forward."""
    return boxes.dense_frames(_one_box(_boxes(spark, sf_dir)[1]), 7).select("clip_id", "track_id", "frame_id", "x1")


@query()
def wide_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """coordinates of all tracks of a frame in one array, zeros where a track is missing."""
    return boxes.wide_frames(boxes.dense_frames(_one_box(_boxes(spark, sf_dir)[1]), 7, fill_forward=False))


@query(_SQL + """SELECT clip_id, frame_id, pid AS pred_id, tid AS truth_id, round(i / (ap + tt - i) - (h - (ap + tt - i)) / h, 6) AS giou FROM (
SELECT *, (greatest(px2, tx2) - least(px1, tx1)) * (greatest(py2, ty2) - least(py1, ty1)) AS h FROM (
SELECT p.clip_id, p.frame_id, p.track_id AS pid, t.track_id AS tid, p.x1 AS px1, p.x2 AS px2, p.y1 AS py1, p.y2 AS py2, t.x1 AS tx1, t.x2 AS tx2, t.y1 AS ty1, t.y2 AS ty2,
greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1)) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) AS ap, (t.x2 - t.x1) * (t.y2 - t.y1) AS tt FROM pred p JOIN truth t USING (clip_id, frame_id)))""")
def generalised_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generalised IoU."""
    pairs = boxes.frame_pairs(*_boxes(spark, sf_dir))
    return rounded(pairs.select("clip_id", "frame_id", "pred_id", "truth_id", geometry.generalised_iou(Box.of("p_"), Box.of("t_")).alias("giou")))


@query(_SQL + """, c AS (SELECT *, least(greatest(0, x1), 2) AS cl, least(greatest(6, x2), 8) AS cr FROM pred) SELECT clip_id, frame_id, track_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, cl, greatest(6, cr - cl)::DOUBLE AS cw, (x2 - x1) * (y2 - y1) BETWEEN 15 AND 25 AS in_range FROM c WHERE x2 > x1 AND y2 > y1""")
def box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions, validity, area range, clipping to a width of six at least."""
    b = Box.of()
    pred = _boxes(spark, sf_dir)[0].where(geometry.valid(b))
    c, clipped = geometry.to_cxcywh(b), geometry.clip(b, 8.0, 8.0, 6.0)
    return pred.select("clip_id", "frame_id", "track_id", *(c[k].alias(k) for k in ("cx", "cy", "w", "h")), clipped.x1.alias("cl"), (clipped.x2 - clipped.x1).alias("cw"), b.area.between(15, 25).alias("in_range"))


@query(_SQL + """, o AS (SELECT p.clip_id, p.frame_id, p.track_id AS pred_id, t.track_id AS truth_id, greatest(0, least(p.x2, t.x2) - greatest(p.x1, t.x1)) * greatest(0, least(p.y2, t.y2) - greatest(p.y1, t.y1)) AS i, (p.x2 - p.x1) * (p.y2 - p.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) AS areas,
((p.x1 + p.x2 - t.x1 - t.x2) / 2) ** 2 + ((p.y1 + p.y2 - t.y1 - t.y2) / 2) ** 2 AS d, (greatest(p.x2, t.x2) - least(p.x1, t.x1)) ** 2 + (greatest(p.y2, t.y2) - least(p.y1, t.y1)) ** 2 AS c,
4 / pi() ** 2 * (atan((t.x2 - t.x1) / (t.y2 - t.y1)) - atan((p.x2 - p.x1) / (p.y2 - p.y1))) ** 2 AS v FROM pred p JOIN truth t USING (clip_id, frame_id)), x AS (SELECT *, i / (areas - i) AS iou FROM o)
SELECT clip_id, frame_id, pred_id, truth_id, round(1 - greatest(-1, least(1, iou - d / c - CASE WHEN iou > 0.5 THEN v * v / (1 - iou + v) ELSE 0 END)), 6) AS loss FROM x""")
def complete_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete IoU loss."""
    pairs = boxes.frame_pairs(*_boxes(spark, sf_dir))
    return rounded(pairs.select("clip_id", "frame_id", "pred_id", "truth_id", geometry.complete_iou_loss(Box.of("p_"), Box.of("t_")).alias("loss")))


@query("""WITH d AS (SELECT p_partkey, (640 + p_size * 10)::DOUBLE AS w, (360 + p_size)::DOUBLE AS h FROM part), s AS (SELECT *, greatest(832::DOUBLE / w, 480::DOUBLE / h) AS scale FROM d)
SELECT p_partkey, round(scale, 6) AS scale, (round_even(w * scale, 0) - 832) / 2 AS crop_left, (round_even(h * scale, 0) - 480) / 2 AS crop_top FROM s""")
def centre_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """centre-crop parameters, half-even rounding."""
    c = geometry.centre_crop((640 + F.col("p_size") * 10).cast("double"), (360 + F.col("p_size")).cast("double"), 832, 480)
    return rounded(read(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", F.col("c.scale").alias("scale"), F.col("c.left").alias("crop_left"), F.col("c.top").alias("crop_top")))


@query()
def two_stage_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of detections that drift by order and line (stateful, so no SQL; tests hold the stream against it)."""
    n = F.col("l_linenumber")
    drift = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_id"), (n - 1).alias("frame_id"), (n * 2 + F.col("l_partkey") % 3).cast("double").alias("x1"), (F.col("l_suppkey") % 4).cast("double").alias("y1"), (0.4 + F.col("l_quantity") / 100).alias("score"))
    detections = drift.withColumn("x2", F.col("x1") + 30).withColumn("y2", F.col("y1") + 50)
    return rounded(tracking.track(detections, tracking.Settings(gated=True)))
