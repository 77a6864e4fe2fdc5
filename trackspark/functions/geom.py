"""Box, point and polygon arithmetic as native Column expressions.

Image coordinates: origin top-left, a box is (x1, y1, x2, y2) in pixels. Sides are floored at
one pixel wherever a later division needs it.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# Duplicate-box limits and the smallest area used as a divisor.
DUPLICATE_IOU = 0.5
DUPLICATE_CONTAINMENT = 0.7
TINY_AREA = 1e-6


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


class Point(NamedTuple):
    x: Column
    y: Column


def box(prefix: str = "") -> Box:
    """Box from four columns named <prefix>x1 ... <prefix>y2."""
    return Box(*(F.col(f"{prefix}{side}") for side in ("x1", "y1", "x2", "y2")))


def box_of(struct: Column) -> Box:
    """Box from a struct column with fields x1 ... y2."""
    return Box(struct["x1"], struct["y1"], struct["x2"], struct["y2"])


def point(prefix: str) -> Point:
    return Point(F.col(f"{prefix}_x"), F.col(f"{prefix}_y"))


def centroid(b: Box) -> Point:
    return Point((b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0)


def width(b: Box) -> Column:
    return F.greatest(F.lit(1.0), b.x2 - b.x1)


def height(b: Box) -> Column:
    return F.greatest(F.lit(1.0), b.y2 - b.y1)


def floored_area(b: Box) -> Column:
    return width(b) * height(b)


def raw_area(b: Box) -> Column:
    """Area with no floor on the sides, kept positive so that it can divide."""
    return F.greatest(F.lit(TINY_AREA), (b.x2 - b.x1) * (b.y2 - b.y1))


def diagonal(b: Box) -> Column:
    return F.sqrt(width(b) * width(b) + height(b) * height(b))


def distance(a: Point, b: Point) -> Column:
    return F.sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))


def intersection(a: Box, b: Box) -> Column:
    across = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1))
    down = F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return across * down


def iou(a: Box, b: Box) -> Column:
    shared = intersection(a, b)
    return shared / (raw_area(a) + raw_area(b) - shared)


def containment(inner: Box, outer: Box) -> Column:
    """Share of `inner` that lies inside `outer`."""
    return intersection(inner, outer) / raw_area(inner)


def area_ratio(a: Box, b: Box) -> Column:
    return F.least(raw_area(a), raw_area(b)) / F.greatest(raw_area(a), raw_area(b))


def overlap_of_object(person: Box, item: Box) -> Column:
    """Share of the object box inside the person box, at most 1."""
    return F.least(F.lit(1.0), containment(item, person))


def is_duplicate(a: Box, b: Box) -> Column:
    return (iou(a, b) >= DUPLICATE_IOU) | (
        F.greatest(containment(a, b), containment(b, a)) >= DUPLICATE_CONTAINMENT
    )


def center_inside(inner: Box, outer: Box) -> Column:
    c = centroid(inner)
    return c.x.between(outer.x1, outer.x2) & c.y.between(outer.y1, outer.y2)


def carrying_zone(person: Box, item: Box, vertical_start: float = 0.45, side_margin: float = 0.75) -> Column:
    """Object centre inside the lower-body band, widened sideways by a share of the body width."""
    c, h, w = centroid(item), height(person), width(person)
    return c.y.between(person.y1 + h * vertical_start, person.y2 - h * 0.05) & c.x.between(
        person.x1 - w * side_margin, person.x2 + w * side_margin
    )


def nearest_point_distance(target: Point, *points: Point) -> Column:
    """Distance to the closest non-null point; NULL when all are missing."""
    gaps = [distance(p, target) for p in points]
    return F.least(*gaps) if len(gaps) > 1 else gaps[0]


def polygon_from_box(b: Box) -> Column:
    return F.array(*(F.struct(c.x.alias("x"), c.y.alias("y")) for c in box_corners(b)))


def polygon_edges(polygon: Column) -> Column:
    """Edges of ARRAY<STRUCT<x,y>> as structs (p = corner, q = the corner before it)."""
    before = F.concat(F.slice(polygon, -1, 1), F.slice(polygon, 1, F.greatest(F.size(polygon) - 1, F.lit(1))))
    return F.zip_with(polygon, before, lambda here, back: F.struct(here.alias("p"), back.alias("q")))


def _crossed(p: Point, q: Point, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) crosses the edge from q to p.

    The slope divisor is signed and floored at 1e-12, so a downward edge divides by that floor, as
    recorded zones expect.
    """
    cut = (q.x - p.x) * (y - p.y) / F.greatest(q.y - p.y, F.lit(1e-12)) + p.x
    return F.coalesce(((p.y > y) != (q.y > y)) & (x < cut), F.lit(False))


def in_edges(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd ray test; fewer than three edges is outside."""
    ends = lambda e: (Point(e[k]["x"], e[k]["y"]) for k in "pq")
    odd = F.aggregate(edges, F.lit(False), lambda inside, e: inside != _crossed(*ends(e), x, y))
    return F.when(F.size(edges) >= 3, odd).otherwise(F.lit(False))


def in_corners(corners: Sequence[Point], x: Column, y: Column) -> Column:
    """`in_edges` of a polygon whose corners are known by number: compiled, where the steps of an aggregate over an array are interpreted."""
    if len(corners) < 3:
        return F.lit(False)
    return functools.reduce(lambda inside, edge: inside != edge, (_crossed(p, q, x, y) for p, q in zip(corners, [corners[-1], *corners[:-1]])))


def box_corners(b: Box) -> list[Point]:
    return [Point(x.cast("double"), y.cast("double")) for x, y in ((b.x1, b.y1), (b.x2, b.y1), (b.x2, b.y2), (b.x1, b.y2))]


def in_polygon(polygon: Column, x: Column, y: Column) -> Column:
    return in_edges(polygon_edges(polygon), x, y)


def pad_and_clip(b: Box, ratio: float, frame_w: int, frame_h: int) -> Box:
    """Integer crop rectangle: grow by a share of each side, then clip to the frame."""
    dx, dy = (b.x2 - b.x1) * ratio, (b.y2 - b.y1) * ratio
    return Box(
        F.greatest(F.lit(0), F.floor(b.x1 - dx)),
        F.greatest(F.lit(0), F.floor(b.y1 - dy)),
        F.least(F.lit(frame_w), F.floor(b.x2 + dx)),
        F.least(F.lit(frame_h), F.floor(b.y2 + dy)),
    )


def yolo_normalised(b: Box, frame_w: float, frame_h: float) -> tuple[Column, Column, Column, Column]:
    """Centre and size as shares of the frame."""
    return (
        (b.x1 + b.x2) / 2.0 / frame_w,
        (b.y1 + b.y2) / 2.0 / frame_h,
        (b.x2 - b.x1) / frame_w,
        (b.y2 - b.y1) / frame_h,
    )
