"""Boxes, crops and resizing as column expressions: structs of ints, truncating where the sizes are computed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(x: Column) -> Column:
    return x.cast("int")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(_int(x1).alias("x1"), _int(y1).alias("y1"), _int(x2).alias("x2"), _int(y2).alias("y2"))


def pad_box(b: Column, width: Column, height: Column, ratio: float) -> Column:
    """The box widened by ``ratio`` of its own size on each side, inside the image."""
    dx, dy = _int((b["x2"] - b["x1"]) * F.lit(ratio)), _int((b["y2"] - b["y1"]) * F.lit(ratio))
    return box(F.greatest(F.lit(0), b["x1"] - dx), F.greatest(F.lit(0), b["y1"] - dy), F.least(width, b["x2"] + dx), F.least(height, b["y2"] + dy))


def centre_square(width: Column, height: Column) -> Column:
    side = F.least(width, height)
    x, y = F.floor((width - side) / 2), F.floor((height - side) / 2)
    return box(x, y, x + side, y + side)


def foreground(b: Column, width: Column, height: Column, least: float) -> Column:
    """The box, or null if it covers less than ``least`` of the image."""
    area = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    return F.when(area / (width * height) >= F.lit(least), b)


def quality_tier(width: Column, height: Column) -> Column:
    m = F.least(width, height)
    return F.when(m < 100, "small").when(m < 200, "medium").otherwise("large")


def letterbox(width: Column, height: Column, target: int) -> Column:
    """Size after scaling to fit a square of ``target``, the padding around it, and the kind of interpolation.

    The scale is computed first: a side can come out one short of the target, which the padding takes up."""
    scale = F.lit(float(target)) / F.greatest(width, height)
    w, h = _int(width * scale), _int(height * scale)
    left, top = _int(F.floor((target - w) / 2)), _int(F.floor((target - h) / 2))
    kind = F.when(scale > 1, "lanczos").when(scale < 0.5, "area").otherwise("cubic")
    return F.struct(w.alias("w"), h.alias("h"), left.alias("left"), top.alias("top"), (target - w - left).alias("right"), (target - h - top).alias("bottom"), kind.alias("interpolation"))
