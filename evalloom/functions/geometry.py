"""Box arithmetic as column expressions. A box is a struct or a prefix of four columns x1, y1, x2, y2."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")))

    @property
    def area(self) -> Column:
        return (self.x2 - self.x1) * (self.y2 - self.y1)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def union(a: Box, b: Box) -> Column:
    return a.area + b.area - intersection(a, b)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union isn't positive."""
    u = union(a, b)
    return F.when(u > 0, intersection(a, b) / u).otherwise(F.lit(0.0))


def generalised_iou(a: Box, b: Box) -> Column:
    hull = (F.greatest(a.x2, b.x2) - F.least(a.x1, b.x1)) * (F.greatest(a.y2, b.y2) - F.least(a.y1, b.y1))
    return iou(a, b) - F.when(hull > 0, (hull - union(a, b)) / hull).otherwise(0.0)


def complete_iou_loss(a: Box, b: Box) -> Column:
    """1 - complete IoU: IoU less centre distance over hull diagonal, less the aspect-ratio term where IoU is over 0.5; within -1 and 1."""
    cw, ch = F.greatest(a.x2, b.x2) - F.least(a.x1, b.x1), F.greatest(a.y2, b.y2) - F.least(a.y1, b.y1)
    dx, dy = (a.x1 + a.x2 - b.x1 - b.x2) / 2, (a.y1 + a.y2 - b.y1 - b.y2) / 2
    away = F.try_divide(dx * dx + dy * dy, cw * cw + ch * ch)
    ratio = F.atan(F.try_divide(b.x2 - b.x1, b.y2 - b.y1)) - F.atan(F.try_divide(a.x2 - a.x1, a.y2 - a.y1))
    v = F.lit(4 / math.pi**2) * ratio * ratio
    over = iou(a, b)
    shape = F.when((over > 0.5) & (v > 0), v * v / (1 - over + v)).otherwise(0.0)
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), over - away - shape))


def to_cxcywh(b: Box) -> Column:
    return F.struct(((b.x1 + b.x2) / 2).alias("cx"), ((b.y1 + b.y2) / 2).alias("cy"), (b.x2 - b.x1).alias("w"), (b.y2 - b.y1).alias("h"))


def to_xywh(b: Box) -> Column:
    return F.struct(b.x1.alias("x"), b.y1.alias("y"), (b.x2 - b.x1).alias("w"), (b.y2 - b.y1).alias("h"))


def clip(b: Box, width: Column | float, height: Column | float, margin: float = 0.0) -> Box:
    """The box inside the image, at least ``margin`` wide and high."""
    w, h = (x if isinstance(x, Column) else F.lit(float(x)) for x in (width, height))
    zero, least = F.lit(0.0), F.lit(float(margin))
    x1, y1 = F.least(F.greatest(zero, b.x1), w - margin), F.least(F.greatest(zero, b.y1), h - margin)
    x2, y2 = F.least(F.greatest(least, b.x2), w), F.least(F.greatest(least, b.y2), h)
    return Box(x1, y1, x1 + F.greatest(least, x2 - x1), y1 + F.greatest(least, y2 - y1))


def scale_and_pad(b: Box, scale: float, pad_x: float, pad_y: float, width: float, height: float) -> Box:
    def at(x: Column, pad: float, most: float) -> Column:
        return F.least(F.greatest(x * scale + pad, F.lit(0.0)), F.lit(float(most)))

    return Box(at(b.x1, pad_x, width), at(b.y1, pad_y, height), at(b.x2, pad_x, width), at(b.y2, pad_y, height))


def centre_crop(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """scale, left and top of a resize that covers the target, then a centre crop (half-even rounding of the size, offsets in halves)."""
    scale = F.greatest(F.lit(float(to_width)) / width, F.lit(float(to_height)) / height)
    left = (F.bround(width * scale) - to_width) / 2
    top = (F.bround(height * scale) - to_height) / 2
    return F.struct(scale.alias("scale"), left.cast("double").alias("left"), top.cast("double").alias("top"))


def crop_point(nx: Column, ny: Column, width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """A normalised point after the centre crop, normalised to the target; outside 0..1 where it is cut off."""
    c = centre_crop(width, height, to_width, to_height)
    x = (nx * width * c["scale"] - c["left"]) / to_width
    y = (ny * height * c["scale"] - c["top"]) / to_height
    return F.struct(x.alias("x"), y.alias("y"))


def valid(b: Box) -> Column:
    return (b.x2 > b.x1) & (b.y2 > b.y1)
