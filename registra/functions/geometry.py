"""Boxes as columns x, y, w, h: overlap, containment, the 0-1000 grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x, y, w, h); 0 where they do not meet."""
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(zero, F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1]))
    union = a[2] * a[3] + b[2] * b[3] - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def holds_point(box: tuple[Column, ...], x: Column, y: Column) -> Column:
    return (x >= box[0]) & (x <= box[0] + box[2]) & (y >= box[1]) & (y <= box[1] + box[3])


def on_grid(value: Column, size: Column) -> Column:
    """A coordinate on the grid from 0 to 1000, rounded half to even."""
    return F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(value * 1000.0 / size).cast("int")))


def grid_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Left, top, right, bottom on the grid; never flat."""
    left, top = on_grid(x, width), on_grid(y, height)
    right, bottom = F.greatest(on_grid(x + w, width), left + 1), F.greatest(on_grid(y + h, height), top + 1)
    return F.array(left, top, right, bottom)
