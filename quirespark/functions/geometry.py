"""Boxes: overlaps, clamping, margins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The journal that running heads name; an option, not a rule.
JOURNAL = "Renewable Energy"


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def overlap_ratio(a: list[Column], b: list[Column]) -> Column:
    """Intersection over the area of ``a`` (1 at least); boxes that only touch have 0."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = F.greatest((a[2] - a[0]) * (a[3] - a[1]), F.lit(1)).cast("double")
    return F.when((width > 0) & (height > 0), width * height / area).otherwise(0.0)


def is_margin(text: Column, y0: Column, y1: Column, height: Column, journal: str = JOURNAL) -> Column:
    """Whether a block is a running head or foot."""
    head = (text == journal) | text.startswith("Contents lists") | text.startswith("journal homepage:") | text.contains(f" / {journal} ")
    foot = text.startswith("Please cite this article") | text.contains("doi.org/") | text.contains("All rights reserved")
    return (y1 < height * 0.09) | ((y1 < height * 0.18) & head) | (y0 > height * 0.94) | ((y0 > height * 0.90) & foot) | ((y0 > height * 0.86) & text.startswith("* Corresponding author."))


def clamped(value: Column, most: Column) -> Column:
    """A detector's coordinate as an integer within the page; it truncates towards zero."""
    return F.least(F.greatest(value.cast("int"), F.lit(0)), most.cast("int"))


def render_box(b: list[Column], page: list[Column], padding: float) -> Column:
    """``struct<x0, y0, x1, y1>`` to render, padded and cut to the page; null if a side is under 2."""
    if padding:
        b = [F.greatest(b[0] - padding, page[0]), F.greatest(b[1] - padding, page[1]), F.least(b[2] + padding, page[2]), F.least(b[3] + padding, page[3])]
    ok = (b[2] - b[0] >= 2) & (b[3] - b[1] >= 2)
    return F.when(ok, F.struct(*[x.cast("double").alias(n) for x, n in zip(b, ("x0", "y0", "x1", "y1"), strict=True)]))
