"""Whether a box of the custom model can be what it is called, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Thresholds


def aspect(box: Column) -> Column:
    """Width over height of a struct of pixels x1 to y2, each side 1 at least."""
    return F.greatest(box["x2"] - box["x1"], F.lit(1)) / F.greatest(box["y2"] - box["y1"], F.lit(1))


def share(box: Column, width: int, height: int) -> Column:
    """The part of the picture that a box covers."""
    return F.greatest(box["x2"] - box["x1"], F.lit(0)) * F.greatest(box["y2"] - box["y1"], F.lit(0)) / float(width * height)


def shape_ok(name: Column, box: Column, width: int, height: int, limits: Thresholds = DEFAULT) -> Column:
    """No sliver and not the whole picture; a reach stacker is wide, of middle size, and not an upright box at the lower edge."""
    flat, part = aspect(box), share(box, width, height)
    tall, low = (box["y2"] - box["y1"]) / float(height), box["y2"] / float(height)
    any_class = (flat >= 0.25) & (part <= 0.75)
    sides = flat.between(limits.stacker_least_aspect, limits.stacker_most_aspect) & ~((low > 0.85) & (flat < 0.90))
    size = part.between(0.010, limits.stacker_most_area) & (tall >= max(limits.stacker_least_height, 0.055))
    return F.coalesce(any_class & ((F.lower(name) != "reach stacker") | (sides & size)), F.lit(False))
