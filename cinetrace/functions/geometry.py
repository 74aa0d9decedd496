"""Box arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two ``struct<x1,y1,x2,y2>``; 0 when the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    side = lambda lo, hi: F.greatest(F.lit(0.0), hi - lo)  # noqa: E731  an inverted box has no area
    area = lambda s: side(s["x1"], s["x2"]) * side(s["y1"], s["y2"])
    union = area(a) + area(b) - w * h
    return F.when(union <= 0, 0.0).otherwise(w * h / union)


def normalise_box(width: Column, height: Column) -> list[Column]:
    """Pixel corners to the unit square."""
    return [
        (F.col(c) / (width if c[0] == "x" else height)).alias(c) for c in ("x1", "y1", "x2", "y2")
    ]


def playback_time(t: Column, strip: Column, source: Column) -> Column:
    """Map a time on the source to a time on a shorter or longer strip."""
    scaled = t * strip / source
    return F.when(source <= 0, 0.0).otherwise(
        F.least(F.greatest(scaled, F.lit(0.0)), strip)
    )
