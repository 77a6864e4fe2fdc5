"""Person-object candidates of a tick, zones, and who owns what."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.config import Thresholds
from trackspark.functions import geom, pose, scoring
from trackspark.functions.geom import Box

# Zones are configuration drawn by hand; beyond this many rows the join is left to Catalyst.
# Zones are looked up by the cell of a grid of this many columns and rows.
ZONE_GRID = 16


def handheld(person: Box, item: Box) -> Column:
    """small enough to be carried by this person."""
    w, h = geom.width(item), geom.height(item)
    return ~((w * h > 0.40 * F.greatest(F.lit(1.0), geom.floored_area(person))) | (w > 1.15 * geom.width(person))
             | (h > 0.80 * geom.height(person)) | (w * h > 65000))


def candidates(pairs: DataFrame, cfg: Thresholds) -> DataFrame:
    """J1 over person-object rows of a frame: size gate, reach gate, scores and flags.

    `pairs` comes from the (video, frame) equi-join; all of this is a residual filter and
    projection on top of it, so nothing is shuffled again.
    """
    pb, ob = geom.box("p_"), geom.box("o_")
    sized = pairs.where(handheld(pb, ob) & (F.col("p_conf") >= cfg.detection_low_conf) & (F.col("o_conf") >= cfg.detection_low_conf))
    lw, rw = geom.point("lw"), geom.point("rw")
    d = geom.distance(geom.centroid(pb), geom.centroid(ob))
    out = sized.withColumn("distance", d).withColumn("norm_distance", d / geom.height(pb))
    out = out.withColumn("contained", geom.overlap_of_object(pb, ob)).withColumn(
        "carry_zone", geom.carrying_zone(pb, ob, cfg.carrying_zone_vertical_start, cfg.carrying_zone_horizontal_margin))
    norm = F.col("norm_distance")
    out = out.withColumn("near", (norm <= cfg.near_distance_ratio) | (F.col("contained") >= 0.25) | F.col("carry_zone"))
    out = out.where(F.col("near") | (norm >= cfg.departure_distance_ratio) | (F.col("contained") > 0) | (norm <= cfg.association_radius_ratio))
    wrist = F.coalesce((pose.wrist_distance(ob, lw, rw) / geom.height(pb) <= cfg.near_distance_ratio)
                       | (pose.wrist_ratio(pb, ob, lw, rw) <= cfg.aidm_wrist_attach_ratio), F.lit(False))
    return out.withColumn("wrist_near", wrist).withColumn(
        "score", scoring.association_score(norm, F.col("contained"), F.col("o_conf"), cfg))


def primary_owner(cands: DataFrame, cfg: Thresholds, owners: DataFrame | None = None) -> DataFrame:
    """One person per object and frame: a known owner first, else best score, then distance.

    The runner-up is read from the same window, so ambiguity costs no second shuffle. `owners`
    (video_id, object_id, owner_id) comes from pairs already carried.
    """
    rows = cands
    if owners is not None:
        rows = rows.join(owners, ["video_id", "object_id"], "left").withColumn(
            "_owned", F.coalesce(F.col("person_id") == F.col("owner_id"), F.lit(False)))
    else:
        rows = rows.withColumn("_owned", F.lit(False))
    w = Window.partitionBy("video_id", "frame", "object_id").orderBy(
        F.col("_owned").desc(), F.col("score").desc(), "norm_distance", "person_id")
    ranked = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_s2", F.lead("score").over(w)).withColumn(
        "_d2", F.lead("norm_distance").over(w))
    contested = F.col("near") & ~F.col("_owned")
    return ranked.where("_rn = 1").withColumn(
        "ambiguous", F.coalesce(contested & (F.col("score") - F.col("_s2") < cfg.association_margin), F.lit(False))
    ).withColumn("other_closer", F.coalesce(contested & (F.col("_d2") < F.col("norm_distance") * 0.95), F.lit(False))
                 ).drop("_rn", "_s2", "_d2", "_owned")


def one_object_per_person(primary: DataFrame) -> DataFrame:
    """The person keeps one object: yolo first, then score, then distance."""
    w = Window.partitionBy("video_id", "frame", "person_id").orderBy(
        F.when(F.col("o_source") == "yolo", 0).otherwise(1), F.col("score").desc(), "norm_distance", "object_id")
    return primary.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def _cell(value: Column) -> Column:
    """Grid cell of a normalised coordinate; all that lies outside the picture shares the outer cells."""
    return F.greatest(F.lit(-1), F.least(F.lit(ZONE_GRID), F.floor(value * ZONE_GRID))).cast("int")


def zone_cells(zones: DataFrame) -> DataFrame:
    """Zones with their edges and y range, one row per grid cell that the bounding box touches (gx, gy)."""
    xs, ys = (F.transform("polygon", lambda corner: corner[axis]) for axis in ("x", "y"))
    across, down = (F.sequence(_cell(F.array_min(v)), _cell(F.array_max(v))) for v in (xs, ys))
    rows = zones.select("*", geom.polygon_edges(F.col("polygon")).alias("edges"), F.array_min(ys).alias("y_low"), F.array_max(ys).alias("y_high"), across.alias("_across"), down.alias("_down")).drop("polygon")
    return rows.withColumn("gx", F.explode("_across")).withColumn("gy", F.explode("_down")).drop("_across", "_down")


def in_zones(det: DataFrame, zones: DataFrame, frame_w: float, frame_h: float) -> DataFrame:
    """Zones of the box's own camera plus those for every camera (camera_id NULL).

    A box looks up two scopes, its camera and "*", in the grid cell of its centre, so the join is an equi-join
    on scope and cell whatever the number of zones. No edge is crossed outside a polygon's own y range, so that range
    is tested first.
    """
    scoped = zone_cells(zones.withColumn("scope", F.coalesce(F.col("camera_id").cast("string"), F.lit("*"))).drop("camera_id"))
    c = geom.centroid(geom.box())
    level = c.y / frame_h
    asked = det.withColumn("gx", _cell(c.x / frame_w)).withColumn("gy", _cell(level)).withColumn("scope", F.explode(F.array(F.col("camera_id").cast("string"), F.lit("*"))))
    hits = asked.join(scoped, ["scope", "gx", "gy"]).where(level.between(F.col("y_low"), F.col("y_high")))
    return hits.where(geom.in_edges(F.col("edges"), c.x / frame_w, level)).drop("scope", "edges", "y_low", "y_high", "gx", "gy")


def zone_counts(det: DataFrame, zones: DataFrame, by: Sequence[str], name: str, frame_w: float, frame_h: float) -> DataFrame:
    """J7 counted: boxes `n` of each `by` group in each zone, for boxes and zones that are many at once.

    Boxes with one centre are tested together, and so are zones with one scope and polygon, so what is tested are different
    positions against different polygons of their cell; names come back to the counts.
    """
    c = geom.centroid(geom.box())
    places = det.groupBy(*dict.fromkeys([*by, "camera_id"]), c.x.alias("x1"), c.y.alias("y1")).agg(F.count(F.lit(1)).alias("_boxes")).withColumns({"x2": F.col("x1"), "y2": F.col("y1")})
    shape = F.struct(F.coalesce(F.col("camera_id").cast("string"), F.lit("*")).alias("scope"), "polygon").alias("_shape")
    shapes = zones.select("camera_id", "polygon", shape).distinct()
    hits = in_zones(places, shapes, frame_w, frame_h).groupBy(*by, "_shape").agg(F.sum("_boxes").alias("_boxes"))
    return hits.join(zones.select(name, shape), "_shape").groupBy(*by, name).agg(F.sum("_boxes").alias("n"))


def flag_listed(det: DataFrame, polygons: Column, frame_w: float, frame_h: float) -> DataFrame:
    """`flag_zones` where a box comes with its camera's few zones, as an array: nothing is joined. Persons are never tested."""
    c = geom.centroid(geom.box())
    inside = F.exists(polygons, lambda p: geom.in_polygon(p, c.x / frame_w, c.y / frame_h))
    return det.withColumn("in_zone", F.when(~F.col("is_person") & polygons.isNotNull(), F.coalesce(inside, F.lit(False))).otherwise(F.lit(False)))


def flag_zones(det: DataFrame, zones: DataFrame, frame_w: float, frame_h: float) -> DataFrame:
    """J7 as a flag: `in_zone` per box, without multiplying or regrouping the boxes.

    The zones of a camera and grid cell become one array row, those for every camera one per cell, so both joins are
    one to one. Persons are never tested.
    """
    cells = zone_cells(zones)
    own = cells.where("camera_id is not null").groupBy("camera_id", "gx", "gy").agg(F.collect_list("edges").alias("_own"))
    shared = cells.where("camera_id is null").groupBy("gx", "gy").agg(F.collect_list("edges").alias("_all"))
    c = geom.centroid(geom.box())
    placed = det.withColumn("gx", _cell(c.x / frame_w)).withColumn("gy", _cell(c.y / frame_h))
    joined = placed.join(own, ["camera_id", "gx", "gy"], "left").join(shared, ["gx", "gy"], "left")
    zone_list = F.concat(F.coalesce("_own", F.array()), F.coalesce("_all", F.array()))
    inside = F.exists(zone_list, lambda e: geom.in_edges(e, c.x / frame_w, c.y / frame_h))
    wanted = F.when(F.col("is_person") | (F.size(zone_list) == 0), F.lit(False)).otherwise(inside)
    return joined.withColumn("in_zone", F.coalesce(wanted, F.lit(False))).drop("_own", "_all", "gx", "gy")
