"""Predicates over boxes, structs of x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    both = F.when((w > 0) & (h > 0), w * h).otherwise(0.0)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def contains(outer: Column, inner: Column, slack: float = 0.0) -> Column:
    return (inner["x0"] >= outer["x0"] - slack) & (inner["y0"] >= outer["y0"] - slack) & (inner["x1"] <= outer["x1"] + slack) & (inner["y1"] <= outer["y1"] + slack)


def in_zone(b: Column, height: Column, top: float, bottom: float) -> Column:
    """Whether the vertical centre lies between two fractions of the page."""
    middle = (b["y0"] + b["y1"]) / 2 / height
    return (middle >= top) & (middle <= bottom)


def vertical_distance(a: Column, b: Column) -> Column:
    """From the bottom of ``a`` down to the top of ``b``; negative where they overlap."""
    return b["y0"] - a["y1"]


def to_pixels(b: Column, width: Column, height: Column, pixel_width: Column, pixel_height: Column) -> Column:
    x, y = pixel_width / width, pixel_height / height
    return F.struct((b["x0"] * x).alias("x0"), (b["y0"] * y).alias("y0"), (b["x1"] * x).alias("x1"), (b["y1"] * y).alias("y1"))
