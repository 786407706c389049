"""Tracking by detection: tracks with motion state, kept by clip across frames.

Each frame is matched in two stages: confident detections with all tracks (distance fused with the score), the rest of the
tracks with weak detections. A clip's frames come in order; what is kept between them is a text of a few hundred bytes a
track. In batch a task streams sorted frames and takes those of many clips together; in a stream the text is the state of
the clip's key. Both give the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evalloom.operators.boxes import assignments
from evalloom.operators.groups import starts, whole_groups

#: 0.95 quantiles of the chi-square distribution by degrees of freedom.
CHI_SQUARE_95 = {1: 3.8415, 2: 5.9915, 3: 7.8147, 4: 9.4877, 5: 11.070, 6: 12.592, 7: 14.067, 8: 15.507, 9: 16.919}
#: Standard deviations as shares of a box's height; those of the aspect ratio are absolute.
OF_PLACE, OF_SPEED = 1 / 20, 1 / 160

TRACKED, LOST = "tracked", "lost"


class Motion:
    """Constant-velocity filters of boxes (centre x, y, aspect ratio, height), for many boxes at once.

    All noise is diagonal, so the four coordinates never mix: each has a mean and speed and the three numbers of its own
    2 x 2 covariance. Arrays are [boxes, 4].
    """

    def __init__(self, mean, speed, var, cov, var_speed):
        self.mean, self.speed, self.var, self.cov, self.var_speed = (np.array(x, dtype=float).reshape(-1, 4) for x in (mean, speed, var, cov, var_speed))

    @staticmethod
    def noise(height: np.ndarray, share: float, ratio: float) -> np.ndarray:
        out = np.repeat((share * np.asarray(height, dtype=float))[:, None], 4, axis=1)
        out[:, 2] = ratio
        return out**2

    @classmethod
    def start(cls, measured: np.ndarray) -> Motion:
        h = measured[:, 3]
        zero = np.zeros_like(measured)
        return cls(measured, zero, cls.noise(h, 2 * OF_PLACE, 1e-2), zero, cls.noise(h, 10 * OF_SPEED, 1e-5))

    def predict(self, still: np.ndarray) -> Motion:
        """One frame ahead; the height of boxes that are ``still`` keeps."""
        speed = self.speed.copy()
        speed[still, 3] = 0
        h = self.mean[:, 3]
        var = self.var + 2 * self.cov + self.var_speed + self.noise(h, OF_PLACE, 1e-2)
        return Motion(self.mean + speed, speed, var, self.cov + self.var_speed, self.var_speed + self.noise(h, OF_SPEED, 1e-5))

    def update(self, measured: np.ndarray) -> Motion:
        total = self.var + self.noise(self.mean[:, 3], OF_PLACE, 1e-1)
        off = measured - self.mean
        return Motion(self.mean + self.var / total * off, self.speed + self.cov / total * off, self.var - self.var**2 / total, self.cov - self.var * self.cov / total, self.var_speed - self.cov**2 / total)

    def distances(self, measured: np.ndarray, position_only: bool = False, plain: bool = False) -> np.ndarray:
        """Squared distances [boxes, measurements] in units of the expected spread (or in pixels, if ``plain``)."""
        n = 2 if position_only else 4
        total = self.var + self.noise(self.mean[:, 3], OF_PLACE, 1e-1)
        off = (measured[None, :, :n] - self.mean[:, None, :n]) ** 2
        return off.sum(2) if plain else (off / total[:, None, :n]).sum(2)

    def distances_of(self, i: np.ndarray, measured: np.ndarray) -> np.ndarray:
        """``distances`` of boxes ``i`` to the measurements of equal place."""
        total = self.var + self.noise(self.mean[:, 3], OF_PLACE, 1e-1)
        return ((measured - self.mean[i]) ** 2 / total[i]).sum(1)


def gate(cost: np.ndarray, motion: Motion, measured: np.ndarray, position_only: bool = False) -> np.ndarray:
    """``cost`` with pairs that the motion rules out at 95 % set to infinity."""
    return np.where(motion.distances(measured, position_only) > CHI_SQUARE_95[2 if position_only else 4], np.inf, cost)


def fuse_motion(cost: np.ndarray, motion: Motion, measured: np.ndarray, share: float = 0.98, position_only: bool = False) -> np.ndarray:
    """Gated cost blended with the motion's distance."""
    return share * gate(cost, motion, measured, position_only) + (1 - share) * motion.distances(measured, position_only)


def fuse_score(cost: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """1 - (1 - cost) * score of the detection."""
    return 1 - (1 - cost) * np.asarray(scores)[None, :]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU [boxes of a, boxes of b]; 0 where the union is empty."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(2)
    union = (a[:, 2:] - a[:, :2]).prod(1)[:, None] + (b[:, 2:] - b[:, :2]).prod(1)[None, :] - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


def to_measure(boxes: np.ndarray) -> np.ndarray:
    size = boxes[:, 2:] - boxes[:, :2]
    return np.column_stack((boxes[:, :2] + size / 2, size[:, 0] / size[:, 1], size[:, 1]))


def to_boxes(mean: np.ndarray) -> np.ndarray:
    w, h = mean[:, 2] * mean[:, 3], mean[:, 3]
    return np.column_stack((mean[:, 0] - w / 2, mean[:, 1] - h / 2, mean[:, 0] + w / 2, mean[:, 1] + h / 2))


def pairs_within(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every row of ``a`` with every row of ``b`` of its clip (both are sorted clips of rows), clip by clip; and the rows of each in a clip that both have."""
    low, high = np.searchsorted(b, a), np.searchsorted(b, a, side="right")
    n = high - low
    i = np.repeat(np.arange(len(a)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + low[i]
    first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, dtype=int)
    rows = np.diff(np.append(first, len(a)))
    met = n[first] > 0
    return i, j, rows[met], n[first][met]


def overlaps_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``overlaps`` of the pairs of equal place."""
    both = np.clip(np.minimum(a[:, 2:], b[:, 2:]) - np.maximum(a[:, :2], b[:, :2]), 0, None).prod(1)
    union = (a[:, 2:] - a[:, :2]).prod(1) + (b[:, 2:] - b[:, :2]).prod(1) - both
    return np.divide(both, union, out=np.zeros_like(both), where=union > 0)


@dataclass(frozen=True)
class Settings:
    """Detections above ``confident`` are matched first, those between ``weak`` and it second; a new track needs
    ``fresh`` more than ``confident``. ``first``, ``second`` and ``unsure`` are the largest distances of the stages; ``keep`` the frames for which a
    lost track is kept; ``same`` the distance under which a lost and a live track are one. ``gated``: motion rules pairs out."""

    confident: float = 0.6
    weak: float = 0.1
    fresh: float = 0.1
    first: float = 0.9
    second: float = 0.5
    unsure: float = 0.7
    keep: int = 30
    same: float = 0.05
    gated: bool = False


#: Of a track, a column each.
_PLAIN = {"clip": np.int64, "number": np.int64, "start": np.int64, "seen": np.int64, "score": np.float64, "sure": np.bool_, "tracked": np.bool_}
_MOTION = ("mean", "speed", "var", "cov", "var_speed")


class Tracks:
    """The tracks of many clips as columns, sorted by clip and, within it, by age. Clips that have a frame go on in step."""

    def __init__(self, settings: Settings, clips: int):
        self.settings = settings
        self.first, self.next = np.zeros(clips, dtype=np.int64), np.ones(clips, dtype=np.int64)
        self.t = {c: np.zeros(0, dtype=d) for c, d in _PLAIN.items()} | {c: np.zeros((0, 4)) for c in _MOTION}

    def keep(self, which: np.ndarray) -> None:
        self.t = {c: x[which] for c, x in self.t.items()}

    def _motion(self, at: np.ndarray) -> Motion:
        return Motion(*(self.t[c][at] for c in _MOTION))

    def _put(self, at: np.ndarray, motion: Motion) -> None:
        for c in _MOTION:
            self.t[c][at] = getattr(motion, c)

    def _match(self, at: np.ndarray, frame: np.ndarray, clip: np.ndarray, boxes: np.ndarray, scores: np.ndarray, limit: float, fused: bool) -> tuple[np.ndarray, np.ndarray]:
        """Predict the tracks ``at``, assign detections of their clips and update; which of them and which detections were matched.

        The assignment saves most against leaving tracks and detections alone, which costs ``limit`` a pair.
        """
        met, used = np.zeros(len(at), dtype=bool), np.zeros(len(clip), dtype=bool)
        if not len(at):
            return met, used
        motion = self._motion(at).predict(~self.t["tracked"][at])
        self._put(at, motion)
        i, j, rows, columns = pairs_within(self.t["clip"][at], clip)
        if not len(i):
            return met, used
        cost = 1 - overlaps_of(to_boxes(motion.mean)[i], boxes[j])
        if fused:
            cost = 1 - (1 - cost) * scores[j]
        if self.settings.gated:
            cost = np.where(motion.distances_of(i, to_measure(boxes)[j]) > CHI_SQUARE_95[4], np.inf, cost)
        # more than the limit is as bad as no pair
        of, r, c = assignments(np.minimum(cost, limit + 1e-6), rows, columns)
        place = (np.cumsum(rows * columns) - rows * columns)[of] + r * columns[of] + c
        place = np.sort(place[cost[place] <= limit])
        i, j = i[place], j[place]
        met[i], used[j] = True, True
        at = at[i]
        if len(at):
            self._put(at, self._motion(at).update(to_measure(boxes[j])))
            self.t["seen"][at], self.t["score"][at], self.t["sure"][at], self.t["tracked"][at] = frame[self.t["clip"][at]], scores[j], True, True
        return met, used

    def step(self, active: np.ndarray, frame: np.ndarray, clip: np.ndarray, boxes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take the detections of the frame ``frame[c]`` of each clip c that is ``active``, sorted by clip; ``clip, number, box, score`` of their live tracks."""
        s, t = self.settings, self.t
        strong, weak = np.flatnonzero(scores > s.confident), np.flatnonzero((scores > s.weak) & (scores < s.confident))
        here = active[t["clip"]]
        sure, unsure = np.flatnonzero(here & t["sure"]), np.flatnonzero(here & ~t["sure"])
        pool = sure[np.lexsort((sure, ~t["tracked"][sure], t["clip"][sure]))]
        met, used = self._match(pool, frame, clip[strong], boxes[strong], scores[strong], s.first, fused=True)
        left = pool[~met & t["tracked"][pool]]
        met, _ = self._match(left, frame, clip[weak], boxes[weak], scores[weak], s.second, fused=False)
        t["tracked"][left[~met]] = False
        rest = strong[~used]
        met, used = self._match(unsure, frame, clip[rest], boxes[rest], scores[rest], s.unsure, fused=True)
        gone = here & ~t["tracked"] & (frame[t["clip"]] - t["seen"] > s.keep)
        gone[unsure[~met]] = True
        self.keep(~gone)
        new = rest[~used & (scores[rest] >= s.confident + s.fresh)]
        if len(new):
            self._start(frame, clip[new], boxes[new], scores[new])
        self._drop_twins(active)
        live = np.flatnonzero(active[self.t["clip"]] & self.t["sure"] & self.t["tracked"])
        return self.t["clip"][live], self.t["number"][live], to_boxes(self.t["mean"][live]), self.t["score"][live]

    def _start(self, frame: np.ndarray, clip: np.ndarray, boxes: np.ndarray, scores: np.ndarray) -> None:
        motion = Motion.start(to_measure(boxes))
        number = self.next[clip] + np.arange(len(clip)) - np.searchsorted(clip, clip)
        np.add.at(self.next, clip, 1)
        new = {"clip": clip, "number": number, "start": frame[clip], "seen": frame[clip], "score": scores, "sure": frame[clip] == self.first[clip], "tracked": np.ones(len(clip), dtype=bool)} | {c: getattr(motion, c) for c in _MOTION}
        self.t = {c: np.concatenate((x, new[c])) for c, x in self.t.items()}
        self.keep(np.argsort(self.t["clip"], kind="stable"))

    def _drop_twins(self, active: np.ndarray) -> None:
        """Of a live and a lost track at one place the younger goes (of equal age the live one)."""
        t = self.t
        here = active[t["clip"]]
        live, lost = np.flatnonzero(here & t["tracked"]), np.flatnonzero(here & ~t["tracked"])
        i, j, _, _ = pairs_within(t["clip"][live], t["clip"][lost])
        if not len(i):
            return
        places, age = to_boxes(t["mean"]), t["seen"] - t["start"]
        near = 1 - overlaps_of(places[live[i]], places[lost[j]]) < self.settings.same
        i, j = live[i[near]], lost[j[near]]
        stays = np.ones(len(age), dtype=bool)
        stays[np.where(age[i] > age[j], j, i)] = False
        self.keep(stays)


@dataclass
class Track:
    number: int
    start: int
    seen: int
    score: float
    sure: bool
    state: str = TRACKED
    #: mean, speed, var, cov, var_speed
    motion: list[list[float]] = field(default_factory=list)


class Tracker:
    """The tracks of one clip."""

    def __init__(self, settings: Settings, state: str | None = None):
        self.settings, self._held = settings, Tracks(settings, 1)
        held = json.loads(state) if state else {"frame": None, "first": None, "next": 1, "tracks": []}
        self.frame, self.first = held["frame"], held["first"]
        self._held.first[0], self._held.next[0] = held["first"] or 0, held["next"]
        tracks = [Track(**t) for t in held["tracks"]]
        values = {"clip": [0] * len(tracks), "tracked": [t.state == TRACKED for t in tracks]}
        self._held.t = {c: np.array(values[c] if c in values else [getattr(t, c) for t in tracks], dtype=d) for c, d in _PLAIN.items()}
        self._held.t |= {c: np.array([t.motion[k] for t in tracks], dtype=float).reshape(-1, 4) for k, c in enumerate(_MOTION)}

    @property
    def tracks(self) -> list[Track]:
        columns = {c: x.tolist() for c, x in self._held.t.items()}
        return [Track(*(columns[c][k] for c in ("number", "start", "seen", "score", "sure")), TRACKED if columns["tracked"][k] else LOST, [columns[c][k] for c in _MOTION]) for k in range(len(columns["clip"]))]

    def state(self) -> str:
        return json.dumps({"frame": self.frame, "first": self.first, "next": int(self._held.next[0]), "tracks": [asdict(t) for t in self.tracks]})

    def update(self, frame: int, boxes: np.ndarray, scores: np.ndarray) -> list[tuple]:
        """Take the next frame's detections; ``(track_id, x1, y1, x2, y2, score)`` of the live tracks. Frames left out count as empty."""
        if self.frame is None:
            self.first = self._held.first[0] = frame
        else:
            # after so many empty frames no track is left
            for gap in range(self.frame + 1, min(frame, self.frame + self.settings.keep + 3)):
                self._step(gap, np.zeros((0, 4)), np.zeros(0))
        return self._step(frame, boxes, scores)

    def _step(self, frame: int, boxes: np.ndarray, scores: np.ndarray) -> list[tuple]:
        self.frame = frame
        _, number, places, score = self._held.step(np.ones(1, dtype=bool), np.array([frame]), np.zeros(len(scores), dtype=np.int64), boxes, np.asarray(scores))
        return [(n, *b, x) for n, b, x in zip(number.tolist(), places.tolist(), score.tolist(), strict=True)]


def _in_step(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """Tracks of sorted detections: the k-th frames of all clips of a batch are taken together, then the next ones.

    Frames left out count as empty. The last clip of a batch may go on in the next one, with its tracks.
    """
    last = None  # clip, frame, first frame, next number and tracks
    for batch in whole_groups(batches, ["clip_id", "frame_id"]):
        group = starts(batch, ["clip_id", "frame_id"])
        size = np.diff(np.append(group, len(batch)))
        row = starts(batch, ["clip_id"])
        frame = batch.column("frame_id").to_numpy()[group]
        clip = np.searchsorted(row, group, side="right") - 1
        begins = np.append(True, clip[1:] != clip[:-1])
        before = np.append(0, frame[:-1])
        held = Tracks(settings, len(row))
        held.first = frame[begins]
        goes_on = last is not None and last[0].equals(batch.column("clip_id").slice(0, 1))
        if goes_on:
            _, before[0], held.first[0], held.next[0], held.t = last
            begins[0] = False
        # after so many empty frames no track is left
        empty = np.where(begins, 0, np.minimum(frame - before - 1, settings.keep + 2))
        total = np.cumsum(empty + 1)
        head = np.flatnonzero(np.append(True, clip[1:] != clip[:-1]))
        turn = total - np.repeat((total - empty - 1)[head], np.diff(np.append(head, len(clip)))) - 1
        turns = turn[np.append(head[1:], len(clip)) - 1] + 1
        boxes, scores = np.column_stack([batch.column(c).to_numpy() for c in _INPUT[2:6]]), batch.column("score").to_numpy()
        order = np.argsort(turn, kind="stable")
        bounds = np.searchsorted(turn[order], np.arange(turns.max() + 1))
        ends = set(turns[:-1].tolist())
        now, out = np.where(goes_on & (np.arange(len(row)) == 0), before[0], 0), []
        for k in range(int(turns.max())):
            some = order[bounds[k] : bounds[k + 1]]
            active = turns > k
            now = now + active
            now[clip[some]] = frame[some]
            rows = np.repeat(group[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(int(size[some].sum()))
            given = np.zeros(len(row), dtype=bool)
            given[clip[some]] = True
            of, number, places, score = held.step(active, now, np.repeat(clip[some], size[some]), boxes[rows], scores[rows])
            told = given[of]
            out.append((of[told], now[of[told]], number[told], places[told], score[told]))
            # clips that end here need no tracks
            if k + 1 in ends:
                held.keep((turns[held.t["clip"]] > k + 1) | (held.t["clip"] == len(row) - 1))
        held.keep(held.t["clip"] == len(row) - 1)
        held.t["clip"][:] = 0
        last = (batch.column("clip_id").slice(len(batch) - 1), frame[-1], held.first[-1], held.next[-1], held.t)
        of, at, number, places, score = (np.concatenate(x) for x in zip(*out, strict=True))
        columns = [batch.column("clip_id").take(pa.array(row[of])), *map(pa.array, (at, number, *np.ascontiguousarray(places.T), score))]
        yield pa.RecordBatch.from_arrays(columns, ["clip_id", "frame_id", "track_id", "x1", "y1", "x2", "y2", "score"])


_SCHEMA = "clip_id {clip}, frame_id long, track_id long, x1 double, y1 double, x2 double, y2 double, score double"
_INPUT = ("clip_id", "frame_id", "x1", "y1", "x2", "y2", "score")


def _valid(detections: DataFrame) -> DataFrame:
    """Boxes that are whole and have an area; others are no detections."""
    return detections.select(*_INPUT).where("clip_id is not null and frame_id is not null and score is not null and x2 > x1 and y2 > y1")


def _frames(tracker: Tracker, rows: Iterator[tuple]) -> Iterator[tuple]:
    """``frame, tracks`` of one clip's sorted rows ``(frame_id, x1, y1, x2, y2, score)``."""
    for frame, some in groupby(rows, key=lambda r: r[0]):
        x = np.array([r[1:] for r in some], dtype=float)
        for found in tracker.update(frame, x[:, :4], x[:, 4]):
            yield (frame, *found)


def track(detections: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``clip_id, frame_id, track_id, x1, y1, x2, y2, score`` of ``clip_id, frame_id, x1, y1, x2, y2, score``; other columns are ignored.

    Rows without a clip, frame or score and boxes without an area are left out. Within a frame detections are taken in
    order of score, then place, so ties and repeated rows fall alike in any partitioning.
    """
    settings = settings or Settings()
    rows = _valid(detections)
    clip = rows.schema["clip_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_step(batches, settings)

    order = ("clip_id", "frame_id", F.desc("score"), "x1", "y1", "x2", "y2")
    typed = rows.select("clip_id", F.col("frame_id").cast("long"), *(F.col(c).cast("double") for c in _INPUT[2:]))
    return typed.repartition("clip_id").sortWithinPartitions(*order).mapInArrow(run, _SCHEMA.format(clip=clip))


class ClipTracker(StatefulProcessor):
    """Keeps a clip's tracker between micro-batches; frames up to the last one seen are late and dropped."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("tracker", "state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tracker = Tracker(self.settings, self.held.get()[0] if self.held.exists() else None)
        all_ = pd.concat(list(rows)).sort_values(["frame_id", "score", "x1", "y1", "x2", "y2"], ascending=[True, False, True, True, True, True])
        if tracker.frame is not None:
            all_ = all_[all_["frame_id"] > tracker.frame]
        found = [(key[0], *f) for f in _frames(tracker, all_[list(_INPUT[1:])].itertuples(index=False, name=None))]
        self.held.update((tracker.state(),))
        yield pd.DataFrame(found, columns=["clip_id", "frame_id", "track_id", "x1", "y1", "x2", "y2", "score"])

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, settings: Settings | None = None) -> DataFrame:
    """As ``track``, for a stream whose micro-batches hold whole frames in order for each clip (needs the RocksDB state store)."""
    rows = _valid(detections)
    clip = rows.schema["clip_id"].dataType.simpleString()
    typed = rows.select("clip_id", F.col("frame_id").cast("long"), *(F.col(c).cast("double") for c in _INPUT[2:]))
    return typed.groupBy("clip_id").transformWithStateInPandas(ClipTracker(settings or Settings()), _SCHEMA.format(clip=clip), "Append", "None")
