"""Boxes and polygons as column expressions. Polygons are array<struct<x, y>>; boxes are four columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sides(polygon: Column) -> Column:
    """array<struct<a, b>>: each corner with the next, the last with the first."""
    following = F.concat(F.slice(polygon, F.lit(2), F.size(polygon) - 1), F.slice(polygon, 1, 1))
    return F.zip_with(polygon, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _crosses(s: Column, x: Column, y: Column) -> Column:
    a, b = s["a"], s["b"]
    return ((a["y"] > y) != (b["y"] > y)) & (x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"])


def _touches(s: Column, x: Column, y: Column) -> Column:
    a, b = s["a"], s["b"]
    cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    return (F.abs(cross) <= 1e-12) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def ray_cast(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd rule with half-open sides."""
    return F.size(F.filter(sides(polygon), lambda s: _crosses(s, x, y))) % 2 == 1


def in_unit(point: Column) -> Column:
    """A drawn point <x, y>, in percents if either is over 1, as parts of one."""
    percent = (point["x"] > 1) | (point["y"] > 1)
    return F.struct(F.when(percent, point["x"] / 100).otherwise(point["x"]).alias("x"), F.when(percent, point["y"] / 100).otherwise(point["y"]).alias("y"))


def gate_contains(x: Column, y: Column, polygon: Column) -> Column:
    """Even-odd rule of gate zones: a side reaches from above its lower y to its upper one, points on a right side are inside.
    Each corner may be in percents. Under three corners, or none given, hold nothing."""

    def passes(s: Column) -> Column:
        a, b = s["a"], s["b"]
        at = F.try_divide((y - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"]) + a["x"]
        within = (y > F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"])) & (x <= F.greatest(a["x"], b["x"]))
        return within & ((a["x"] == b["x"]) | (x <= at))

    unit = F.transform(polygon, in_unit)
    return F.coalesce((F.size(polygon) >= 3) & (F.size(F.filter(sides(unit), passes)) % 2 == 1), F.lit(False))


def topmost(polygon: Column) -> Column:
    """The corner of least y, the first of equals."""
    ranked = F.transform(polygon, lambda p, k: F.struct(p["y"].alias("y"), k.alias("k"), p["x"].alias("x")))
    top = F.array_min(ranked)
    return F.struct(top["x"].alias("x"), top["y"].alias("y"))


def covers(x: Column, y: Column, polygon: Column) -> Column:
    """Inside or on the border."""
    return F.exists(sides(polygon), lambda s: _touches(s, x, y)) | ray_cast(x, y, polygon)


def side_distance(x: Column, y: Column, polygon: Column) -> Column:
    """Distance to the nearest side."""

    def one(s: Column) -> Column:
        a, b = s["a"], s["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((x - a["x"]) * dx + (y - a["y"]) * dy, dx * dx + dy * dy))), F.lit(0.0))
        return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)

    return F.array_min(F.transform(sides(polygon), one))


def near_covers(x: Column, y: Column, polygon: Column, buffer: float) -> Column:
    """Covered, or within `buffer` of a side."""
    return covers(x, y, polygon) | (side_distance(x, y, polygon) <= buffer)


def valid_polygon(polygon: Column) -> Column:
    fits = lambda v: v.isNotNull() & ~F.isnan(v) & v.between(0, 1)
    return F.coalesce((F.size(polygon) >= 3) & F.forall(polygon, lambda p: fits(p["x"]) & fits(p["y"])), F.lit(False))


def envelope(polygon: Column) -> dict[str, Column]:
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def centroid(polygon: Column) -> dict[str, Column]:
    """Plain mean of the corners."""
    mean = lambda k: F.aggregate(polygon, F.lit(0.0), lambda a, p: a + p[k]) / F.size(polygon)
    return {"x": mean("x"), "y": mean("y")}


Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + c) for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def iomin(a: Box, b: Box) -> Column:
    return F.coalesce(F.try_divide(intersection(a, b), F.least(area(a), area(b))), F.lit(0.0))


def overlap(a: Box, b: Box) -> Column:
    return F.greatest(iou(a, b), iomin(a, b))


def center_distance(a: Box, b: Box) -> Column:
    return F.hypot((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)


def distance_ratio(a: Box, b: Box) -> Column:
    """Distance of the centers in mean sides of the larger box."""
    side = lambda x: (x[2] - x[0] + x[3] - x[1]) / 2
    return center_distance(a, b) / F.greatest(F.lit(1.0), side(a), side(b))


def bottom_center(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, b[3]


def yolo_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """'cx cy w h' with six decimals."""
    return F.format_string("%.6f %.6f %.6f %.6f", x + w / 2, y + h / 2, w, h)


def pixel_clamp(v: Column, limit: int) -> Column:
    return F.greatest(F.lit(0), F.least(v.cast("int"), F.lit(limit)))


def picture_box(b: Box, width: int, height: int) -> dict[str, Column]:
    """A box cut to whole pixels of a picture, one wide and high at least, and nx1..ny2, its sides as parts to four digits (half up)."""
    x1 = F.greatest(F.lit(0), F.least(F.lit(width - 1), b[0].cast("int")))
    y1 = F.greatest(F.lit(0), F.least(F.lit(height - 1), b[1].cast("int")))
    own = {"x1": x1, "y1": y1, "x2": F.greatest(x1 + 1, F.least(F.lit(width), b[2].cast("int"))), "y2": F.greatest(y1 + 1, F.least(F.lit(height), b[3].cast("int")))}
    part = lambda v, size: F.floor((v.cast("long") * 20000 + size) / (2 * size)) / 10000
    return own | {f"n{k}": part(v, width if k[0] == "x" else height) for k, v in own.items()}


def tile_starts(size: int, tile: int, share: float = 0.25) -> Column:
    """Starts of tiles that overlap by a share, the last one anchored at the end."""
    step = max(1, int(tile * (1 - share)))
    last = max(size - tile, 0)
    return F.array_distinct(F.concat(F.sequence(F.lit(0), F.lit(last), F.lit(step)), F.array(F.lit(last))))
