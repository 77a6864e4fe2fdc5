"""Landmark expressions: wrists, shoulders, head box, frontality, pose score.

A missing landmark is a Point whose coordinates are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackspark.config import Thresholds
from trackspark.functions import geom
from trackspark.functions.geom import Box, Point

# Fixed value: landmarks below this confidence count as missing.
KEYPOINT_MIN_CONF = 0.2


def wrist_distance(item: Box, left: Point, right: Point) -> Column:
    """Pixels from the object centre to the nearer visible wrist, NULL without wrists."""
    return geom.nearest_point_distance(geom.centroid(item), left, right)


def wrist_ratio(person: Box, item: Box, left: Point, right: Point) -> Column:
    """Wrist distance as a share of the person diagonal, so it does not depend on camera distance."""
    return wrist_distance(item, left, right) / geom.diagonal(person)


def shoulder_line(left: Point, right: Point, torso: Point) -> Column:
    """Mean shoulder height, else torso height, else NULL."""
    return F.coalesce((left.y + right.y) / 2, left.y, right.y, torso.y)


def link_start(person: Box, lw: Point, rw: Point, torso: Point) -> Point:
    """Where the link to an object starts: wrist midpoint, one wrist, torso, body centre."""
    c = geom.centroid(person)

    def pick(axis: str) -> Column:
        left, right = getattr(lw, axis), getattr(rw, axis)
        return F.coalesce((left + right) / 2.0, left, right, getattr(torso, axis), getattr(c, axis))

    return Point(pick("x"), pick("y"))


def pose_score(person: Box, item: Box, lw: Point, rw: Point, top: Column, person_step: Column, object_step: Column,
               cfg: Thresholds) -> Column:
    """Weighted mean of the wrist, zone and motion cues, over the cues that exist.

    The fields of `cfg` are numbers, or Columns where several configs are rows of one table.
    """
    h, w, c = geom.height(person), geom.width(person), geom.centroid(item)
    positive = lambda value: F.greatest(F.lit(1e-6), F.lit(value))
    reach = wrist_distance(item, lw, rw) / F.greatest(F.lit(1e-6), h * positive(cfg.pose_wrist_norm_ratio))
    band_top = F.coalesce(top, person.y1 + h * cfg.carrying_zone_vertical_start) - h * cfg.pose_zone_vertical_above
    in_zone = c.y.between(band_top, person.y2 + h * cfg.pose_zone_vertical_below) & c.x.between(
        person.x1 - w * cfg.pose_zone_horizontal_margin, person.x2 + w * cfg.pose_zone_horizontal_margin)
    cues = [
        (F.lit(cfg.pose_weight_wrist), 1.0 / (1.0 + reach)),
        (F.lit(cfg.pose_weight_zone), F.when(in_zone, 1.0).otherwise(0.0)),
        (F.lit(cfg.pose_weight_motion), 1.0 / (1.0 + F.abs(person_step - object_step) / positive(cfg.pose_motion_norm_px))),
    ]
    weight = sum((F.when(v.isNotNull(), w_).otherwise(0.0) for w_, v in cues), F.lit(0.0))
    total = sum((F.coalesce(v * w_, F.lit(0.0)) for w_, v in cues), F.lit(0.0))
    return F.when(weight > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / weight)))


def missing_cues(**cues: Column) -> Column:
    """Sorted comma list of the cue names whose value is NULL."""
    return F.concat_ws(",", F.array_sort(F.array(*(F.when(v.isNull(), F.lit(k)) for k, v in cues.items()))))


def head_box(person: Box, nose: Point, ls: Point, rs: Point) -> Box:
    """Square around the nose sized by the shoulder span, or by body height without both shoulders."""
    radius = F.greatest(F.lit(12.0), F.coalesce(geom.distance(ls, rs) * 0.55, geom.height(person) * 0.12))
    return Box(nose.x - radius, nose.y - radius, nose.x + radius, nose.y + radius)


def frontality(ls: Point, rs: Point) -> Column:
    """How squarely the shoulders face the camera, 0.5 when they are not both seen."""
    span = F.abs(rs.x - ls.x)
    level = 1.0 - F.least(F.lit(1.0), F.abs(rs.y - ls.y) / F.greatest(span, F.lit(1.0)))
    return F.coalesce(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * level + 0.4 * F.least(F.lit(1.0), span / 80.0))), F.lit(0.5))


def shot_quality(sharpness: Column, size: Column, front: Column, sharp_ref: float = 120.0, size_ref: float = 80.0) -> Column:
    return (0.5 * F.least(F.lit(1.0), sharpness / sharp_ref) + 0.3 * F.least(F.lit(1.0), size / size_ref) + 0.2 * front)


def frame_keypoints(raw: Column, person: Box) -> Column:
    """Crop-relative ARRAY<STRUCT<y,x,c>> to frame points; low-confidence entries become NULL."""
    h, w = F.greatest(F.lit(1.0), person.y2 - person.y1), F.greatest(F.lit(1.0), person.x2 - person.x1)
    return F.transform(raw, lambda k: F.when(
        k["c"] >= KEYPOINT_MIN_CONF, F.struct((person.x1 + k["x"] * w).alias("x"), (person.y1 + k["y"] * h).alias("y"))))
