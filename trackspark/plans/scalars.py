"""Registered projections: geometry, landmarks, labels and scores over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.config import STATES, TIERS, Thresholds
from trackspark.functions import geom, labels, pose, scoring
from trackspark.plans import views
from trackspark.plans.registry import ORACLES, QUERIES, query

CFG = Thresholds()
PB, OB = geom.box("p_"), geom.box("o_")
LW, RW, LS, RS, TORSO = (geom.point(n) for n in ("lw", "rw", "ls", "rs", "torso"))


def r9(value: Column) -> Column:
    return F.round(value, 9)


def project(name: str, view: Callable[[SparkSession, str], DataFrame], with_sql: str, source: str, keys: list[str],
            columns: dict[str, tuple[Column, str]], where: tuple[Column, str] | None = None) -> None:
    """Register a projection of a view, pairing each Column with its SQL text."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = view(spark, sf)
        if where is not None:
            df = df.where(where[0])
        return df.select(*keys, *(c.alias(n) for n, (c, _) in columns.items()))

    cols = ", ".join([*keys, *(f"{sql} AS {n}" for n, (_, sql) in columns.items())])
    QUERIES[name] = run
    ORACLES[name] = f"{with_sql}SELECT {cols} FROM {source}" + (f" WHERE {where[1]}" if where else "")


DET_KEYS = ["video_id", "frame", "det_id"]
PAIR_KEYS = ["video_id", "frame", "person_id", "object_id"]
B = geom.box()

# SQL fragments shared by the oracles below.
PW, PH = "greatest(1.0, p_x2 - p_x1)", "greatest(1.0, p_y2 - p_y1)"
OW, OH = "greatest(1.0, o_x2 - o_x1)", "greatest(1.0, o_y2 - o_y1)"
PA, OA = "greatest(1e-6, (p_x2 - p_x1) * (p_y2 - p_y1))", "greatest(1e-6, (o_x2 - o_x1) * (o_y2 - o_y1))"
INTER = ("(greatest(0.0, least(p_x2, o_x2) - greatest(p_x1, o_x1)) * "
         "greatest(0.0, least(p_y2, o_y2) - greatest(p_y1, o_y1)))")
PCX, PCY, OCX, OCY = "(p_x1 + p_x2) / 2.0", "(p_y1 + p_y2) / 2.0", "(o_x1 + o_x2) / 2.0", "(o_y1 + o_y2) / 2.0"
DIST = f"sqrt(({PCX} - {OCX}) * ({PCX} - {OCX}) + ({PCY} - {OCY}) * ({PCY} - {OCY}))"
NORM = f"({DIST} / {PH})"
IOU = f"({INTER} / ({PA} + {OA} - {INTER}))"
CONT = f"least(1.0, {INTER} / {OA})"


def wrist_sql(side: str) -> str:
    return f"sqrt(({side}_x - {OCX}) * ({side}_x - {OCX}) + ({side}_y - {OCY}) * ({side}_y - {OCY}))"


WRIST = f"CASE WHEN lw_x IS NULL THEN {wrist_sql('rw')} WHEN rw_x IS NULL THEN {wrist_sql('lw')} ELSE least({wrist_sql('lw')}, {wrist_sql('rw')}) END"
WRIST_NORM = f"(({WRIST}) / sqrt({PW} * {PW} + {PH} * {PH}))"
ZONE = (f"({OCY} BETWEEN p_y1 + {PH} * 0.45 AND p_y2 - {PH} * 0.05 AND "
        f"{OCX} BETWEEN p_x1 - {PW} * 0.75 AND p_x2 + {PW} * 0.75)")

c = geom.centroid(B)
project("p01_centroid", views.det, views.ON_DET, "det", DET_KEYS,
        {"cx": (c.x, "(x1 + x2) / 2.0"), "cy": (c.y, "(y1 + y2) / 2.0")})
project("p02_box_sides", views.det, views.ON_DET, "det", DET_KEYS, {
    "w": (geom.width(B), "greatest(1.0, x2 - x1)"), "h": (geom.height(B), "greatest(1.0, y2 - y1)"),
    "area": (geom.floored_area(B), "greatest(1.0, x2 - x1) * greatest(1.0, y2 - y1)")})
project("p03_person_diagonal", views.pose, views.ON_POSE, "pose", DET_KEYS,
        {"diagonal": (r9(geom.diagonal(B)), "round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 9)")})
project("p04_distance", views.pairs, views.ON_PAIRS, "pairs", PAIR_KEYS, {
    "distance": (r9(geom.distance(geom.centroid(PB), geom.centroid(OB))), f"round({DIST}, 9)")})
project("p05_iou", views.pairs, views.ON_PAIRS, "pairs", PAIR_KEYS, {"iou": (r9(geom.iou(PB, OB)), f"round({IOU}, 9)")})
project("p06_containment", views.pairs, views.ON_PAIRS, "pairs", PAIR_KEYS, {
    "person_in_object": (r9(geom.containment(PB, OB)), f"round({INTER} / {PA}, 9)"),
    "object_in_person": (r9(geom.containment(OB, PB)), f"round({INTER} / {OA}, 9)"),
    "area_ratio": (r9(geom.area_ratio(PB, OB)), f"round(least({PA}, {OA}) / greatest({PA}, {OA}), 9)"),
    "center_dist": (r9(geom.distance(geom.centroid(PB), geom.centroid(OB))), f"round({DIST}, 9)")})
project("p07_object_overlap", views.pairs, views.ON_PAIRS, "pairs", PAIR_KEYS,
        {"overlap": (r9(geom.overlap_of_object(PB, OB)), f"round({CONT}, 9)")})
project("p08_duplicate_boxes", views.pairs, views.ON_PAIRS, "pairs", PAIR_KEYS, {"duplicate": (
    geom.is_duplicate(PB, OB), f"({IOU} >= 0.5 OR greatest({INTER} / {PA}, {INTER} / {OA}) >= 0.7)")})
project("p09_carrying_zone", views.pairs, views.ON_PAIRS, "pairs", PAIR_KEYS,
        {"in_zone": (geom.carrying_zone(PB, OB), ZONE)})
project("p10_wrist_distance", views.pairs, views.ON_PAIRS, "pairs", PAIR_KEYS, {
    "wrist_available": (LW.x.isNotNull() | RW.x.isNotNull(), "(lw_x IS NOT NULL OR rw_x IS NOT NULL)"),
    "wrist_px": (r9(pose.wrist_distance(OB, LW, RW)), f"round({WRIST}, 9)"),
    "wrist_ratio": (r9(pose.wrist_ratio(PB, OB, LW, RW)), f"round({WRIST_NORM}, 9)")})

start = pose.link_start(B, LW, RW, TORSO)
project("p11_landmark_fallbacks", views.pose, views.ON_POSE, "pose", DET_KEYS, {
    "shoulder_y": (pose.shoulder_line(LS, RS, TORSO),
                   "CASE WHEN ls_y IS NOT NULL AND rs_y IS NOT NULL THEN (ls_y + rs_y) / 2 ELSE coalesce(ls_y, rs_y, torso_y) END"),
    "start_x": (start.x, "CASE WHEN lw_x IS NOT NULL AND rw_x IS NOT NULL THEN (lw_x + rw_x) / 2.0 "
                "ELSE coalesce(lw_x, rw_x, torso_x, (x1 + x2) / 2.0) END"),
    "start_y": (start.y, "CASE WHEN lw_y IS NOT NULL AND rw_y IS NOT NULL THEN (lw_y + rw_y) / 2.0 "
                "ELSE coalesce(lw_y, rw_y, torso_y, (y1 + y2) / 2.0) END")})

TOP = f"coalesce(CASE WHEN ls_y IS NOT NULL AND rs_y IS NOT NULL THEN (ls_y + rs_y) / 2 ELSE coalesce(ls_y, rs_y, torso_y) END, p_y1 + {PH} * 0.45)"
POSE_ZONE = (f"CASE WHEN {OCY} BETWEEN {TOP} AND p_y2 AND {OCX} BETWEEN p_x1 - {PW} * 0.3 AND p_x2 + {PW} * 0.3 "
             "THEN 1.0 ELSE 0.0 END")
# Steps per tick are given columns here; some are missing, as at the start of a track.
P_STEP, O_STEP = F.when(F.col("frame") % 9 != 0, F.col("frame") % 17 + 0.0), F.when(F.col("object_id") != 2, F.col("frame") % 11 + 0.5)
MOTION = ("CASE WHEN frame % 9 <> 0 AND object_id <> 2 THEN 1.0 / (1.0 + abs((frame % 17 + 0.0) - (frame % 11 + 0.5)) / 20.0) END")
WRIST_CUE = f"(1.0 / (1.0 + ({WRIST}) / greatest(1e-6, {PH} * 0.5)))"
score12 = pose.pose_score(PB, OB, LW, RW, pose.shoulder_line(LS, RS, TORSO), P_STEP, O_STEP, CFG)
POSE_SQL = (f"((coalesce({WRIST_CUE} * 0.4, 0.0) + ({POSE_ZONE}) * 0.3 + coalesce(({MOTION}) * 0.3, 0.0)) / "
            f"((CASE WHEN lw_x IS NULL AND rw_x IS NULL THEN 0.0 ELSE 0.4 END) + 0.3 + "
            "(CASE WHEN frame % 9 <> 0 AND object_id <> 2 THEN 0.3 ELSE 0.0 END)))")
project("p12_pose_score", views.pairs, views.ON_PAIRS, "pairs", PAIR_KEYS, {
    "pose_score": (r9(score12), f"round({POSE_SQL}, 9)"),
    "missing": (pose.missing_cues(wrist=pose.wrist_distance(OB, LW, RW), motion=P_STEP + O_STEP),
                "concat_ws(',', CASE WHEN frame % 9 = 0 OR object_id = 2 THEN 'motion' END, "
                "CASE WHEN lw_x IS NULL AND rw_x IS NULL THEN 'wrist' END)")})

norm = geom.distance(geom.centroid(PB), geom.centroid(OB)) / geom.height(PB)
legacy = scoring.association_score(norm, geom.overlap_of_object(PB, OB), F.col("o_conf"), CFG)
LEGACY = f"(0.55 * greatest(0.0, 1.0 - {NORM} / 0.5) + 0.25 * {CONT} + 0.20 * least(1.0, o_conf / 0.25))"
project("p13_association_score", views.pairs, views.ON_PAIRS, "pairs", PAIR_KEYS, {
    "score": (r9(legacy), f"round({LEGACY}, 9)"),
    "blended_score": (r9(scoring.blended(legacy, score12, 0.5)), f"round(0.5 * {LEGACY} + 0.5 * {POSE_SQL}, 9)")})

ZONES = [("A", [(0.05, 0.05), (0.30, 0.05), (0.20, 0.40), (0.05, 0.30)]), ("B", [(0.1, 0.1), (0.2, 0.3), (0.3, 0.1)])]


def _corners(points):
    return [geom.Point(F.lit(float(x)), F.lit(float(y))) for x, y in points]


def _polygon_sql(points, x: str, y: str) -> str:
    tests = []
    for i, (xi, yi) in enumerate(points):
        xj, yj = points[i - 1]
        tests.append(f"CASE WHEN (({yi} > {y}) <> ({yj} > {y})) AND {x} < ({xj} - {xi}) * ({y} - {yi}) / "
                     f"greatest({yj} - {yi}, 1e-12) + {xi} THEN 1 ELSE 0 END")
    return f"(({' + '.join(tests)}) % 2 = 1)"


NX, NY = c.x / views.FRAME_W, c.y / views.FRAME_H
project("p14_point_in_polygon", views.det, views.ON_DET, "det", DET_KEYS, {
    **{f"in_{n.lower()}": (geom.in_corners(_corners(p), NX, NY), _polygon_sql(
        [(f"CAST({x} AS DOUBLE)", f"CAST({y} AS DOUBLE)") for x, y in p], "((x1 + x2) / 2.0 / 640)", "((y1 + y2) / 2.0 / 480)"))
       for n, p in ZONES},
    "in_line": (geom.in_corners(_corners(ZONES[0][1][:2]), NX, NY), "false"),
    "in_own_box": (geom.in_corners(geom.box_corners(B), c.x, c.y), _polygon_sql(
        [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")], "((x1 + x2) / 2.0)", "((y1 + y2) / 2.0)"))})

oc = geom.centroid(OB)
feet, near_ground = oc.y >= PB.y2 - CFG.bag_move_norm * geom.height(PB), oc.y >= PB.y2 - CFG.ground_plane_margin_ratio * geom.height(PB)
project("p15_ground_plane", views.pairs, views.ON_PAIRS, "pairs", PAIR_KEYS, {
    "below_feet": (feet, f"{OCY} >= p_y2 - 0.05 * {PH}"), "near_ground": (near_ground, f"{OCY} >= p_y2 - 0.40 * {PH}"),
    "release_pose_on_ground": (
        (geom.height(PB) > 1.0) & (oc.y >= geom.centroid(PB).y + 0.5 * geom.height(PB) - max(CFG.ground_plane_margin_ratio, 0.25) * geom.height(PB)),
        f"({PH} > 1.0 AND {OCY} >= {PCY} + 0.5 * {PH} - 0.40 * {PH})")})

contained = geom.overlap_of_object(PB, OB)
zone = geom.carrying_zone(PB, OB)
near = (norm <= CFG.near_distance_ratio) | (contained >= 0.25) | zone
NEAR = f"({NORM} <= 0.25 OR {CONT} >= 0.25 OR {ZONE})"
wrist_near = F.coalesce((pose.wrist_distance(OB, LW, RW) / geom.height(PB) <= CFG.near_distance_ratio)
                        | (pose.wrist_ratio(PB, OB, LW, RW) <= CFG.aidm_wrist_attach_ratio), F.lit(False))
WRIST_NEAR = f"coalesce(({WRIST}) / {PH} <= 0.25 OR {WRIST_NORM} <= 0.15, false)"
project("p16_pair_flags", views.pairs, views.ON_PAIRS, "pairs", PAIR_KEYS, {
    "near": (near, NEAR), "departed": (norm >= CFG.departure_distance_ratio, f"{NORM} >= 1.25"),
    "associated": (norm <= CFG.association_radius_ratio, f"{NORM} <= 1.0"), "wrist_near": (wrist_near, WRIST_NEAR),
    "carried": ((wrist_near | (zone & ~near_ground & LW.x.isNull() & RW.x.isNull())) & (norm <= CFG.near_distance_ratio * 1.5),
                f"(({WRIST_NEAR} OR ({ZONE} AND NOT ({OCY} >= p_y2 - 0.40 * {PH}) AND lw_x IS NULL AND rw_x IS NULL)) AND {NORM} <= 0.375)")})

ns = labels.namespaced(F.col("track_no"), F.col("is_person"), F.col("source"))
NS = ("CASE WHEN is_person THEN track_no WHEN source = 'color' THEN track_no + 60000 "
      "WHEN source = 'novelty' THEN track_no + 110000 ELSE track_no + 10000 END")
project("p17_id_spaces", views.det, views.ON_DET, "det", [*DET_KEYS, "source", "is_person"], {
    "global_id": (ns, NS), "raw_id": (labels.raw_id_of(ns), f"CASE WHEN ({NS}) >= 10000 THEN ({NS}) - 10000 ELSE ({NS}) END"),
    "is_object": (labels.is_object_id(ns), f"({NS}) >= 10000")})


def part_names(spark: SparkSession, sf: str) -> DataFrame:
    """Class-like names: the part name plus a thing word that varies with the key."""
    p = views.table(spark, sf, "part")
    words = F.array(*(F.lit(w) for w in PART_WORDS))
    return p.select("p_partkey", F.concat_ws(" ", F.split("p_name", " ")[0], F.get(words, (F.col("p_partkey") % len(PART_WORDS)).cast("int"))).alias("name"),
                    F.get(words, (F.col("p_partkey") % len(PART_WORDS)).cast("int")).alias("word"))


PART_WORDS = ["Drink can", "Plastic bag", "tissue paper", "juice-cup", "Foam cup", "waste", "Newspaper", "ring", "Garbage bag", "glove box", "litter"]
PARTS_SQL = f"""WITH parts AS (
  SELECT p_partkey, split_part(p_name, ' ', 1) || ' ' || w AS name, w AS word
  FROM (SELECT *, ({PART_WORDS!r})[p_partkey % {len(PART_WORDS)} + 1] AS w FROM part) t)
"""
_FAMILY_SQL = "list_filter({words}, lambda w: contains(lower({col}), w))"
project("p18_class_family", part_names, PARTS_SQL, "parts", ["p_partkey"], {
    "family_words": (F.concat_ws("|", labels.family(F.col("name"))),
                     f"array_to_string(list_filter({labels.FAMILY_WORDS!r}, lambda w: contains(lower(name), w)), '|')"),
    "matches_bag": (labels.same_family(labels.family(F.col("name")), labels.family(F.lit("bag"))),
                    f"(len(list_filter({labels.FAMILY_WORDS!r}, lambda w: contains(lower(name), w))) = 0 OR contains(lower(name), 'bag'))")})

MAP_VALUES = ", ".join(f"({i}, {str(e).lower()}, '{raw}', {cid})" for i, e, raw, cid in labels.mapping_rows())


@query("p19_canonical_class", oracle=f"""{PARTS_SQL}, names AS (SELECT DISTINCT n FROM (SELECT name AS n FROM parts UNION ALL SELECT word FROM parts) t),
  m(ordinal, exact, raw, cid) AS (VALUES {MAP_VALUES}),
  hit AS (SELECT n, arg_min(cid, ordinal) AS cid FROM names JOIN m ON (exact AND lower(trim(n)) = raw) OR (NOT exact AND contains(lower(trim(n)), raw)) GROUP BY n)
SELECT names.n AS class_name, CAST(coalesce(cid, -1) AS INTEGER) AS class_id,
  CASE WHEN cid IS NULL THEN 'unknown' ELSE ({labels.CANONICAL!r})[cid + 1] END AS canonical
FROM names LEFT JOIN hit ON names.n = hit.n""")
def p19(spark, sf):
    """The lookup runs once per distinct class name, not once per box."""
    parts = part_names(spark, sf)
    names = parts.select(F.explode(F.array("name", "word")).alias("class_name")).distinct()
    out = labels.canonical_ids(names, "class_name")
    return out.withColumn("canonical", labels.canonical_name(F.col("class_id")))


yolo = geom.yolo_normalised(B, views.FRAME_W, views.FRAME_H)
project("p20_box_normalisation", views.det, views.ON_DET, "det", DET_KEYS, {
    "ncx": (yolo[0], "(x1 + x2) / 2.0 / 640"), "ncy": (yolo[1], "(y1 + y2) / 2.0 / 480"),
    "nw": (yolo[2], "(x2 - x1) / 640"), "nh": (yolo[3], "(y2 - y1) / 480"),
    "fx": (B.x1 / 640, "x1 / 640"), "fy": (B.y1 / 480, "y1 / 480"),
    "in_range": (yolo[0].between(0, 1) & yolo[1].between(0, 1) & (yolo[2] > 0) & (yolo[3] > 0),
                 "((x1 + x2) / 2.0 / 640 BETWEEN 0 AND 1 AND (y1 + y2) / 2.0 / 480 BETWEEN 0 AND 1 AND x2 > x1 AND y2 > y1)")})

crop = geom.pad_and_clip(B, 0.08, 180, 160)
CROP = {"cx1": "greatest(0, CAST(floor(x1 - (x2 - x1) * 0.08) AS BIGINT))", "cy1": "greatest(0, CAST(floor(y1 - (y2 - y1) * 0.08) AS BIGINT))",
        "cx2": "least(180, CAST(floor(x2 + (x2 - x1) * 0.08) AS BIGINT))", "cy2": "least(160, CAST(floor(y2 + (y2 - y1) * 0.08) AS BIGINT))"}
project("p21_crop_rectangle", views.det, views.ON_DET, "det", DET_KEYS,
        {k: (v, CROP[k]) for k, v in zip(CROP, crop)},
        where=((crop.x2 - crop.x1 >= 8) & (crop.y2 - crop.y1 >= 8), f"{CROP['cx2']} - {CROP['cx1']} >= 8 AND {CROP['cy2']} - {CROP['cy1']} >= 8"))

NOSE = geom.point("nose")
head = pose.head_box(B, NOSE, LS, RS)
RADIUS = "greatest(12.0, coalesce(sqrt((ls_x - rs_x) * (ls_x - rs_x) + (ls_y - rs_y) * (ls_y - rs_y)) * 0.55, greatest(1.0, y2 - y1) * 0.12))"
project("p22_head_box", views.pose, views.ON_POSE, "pose", DET_KEYS, {
    "head_visible": (NOSE.x.isNotNull(), "nose_x IS NOT NULL"),
    **{f"head_{n}": (r9(v), f"round(nose_{a} {s} {RADIUS}, 9)") for n, v, a, s in
       zip(("x1", "y1", "x2", "y2"), head, "xyxy", "--++")}})

front = pose.frontality(LS, RS)
FRONT = ("coalesce(greatest(0.0, least(1.0, 0.6 * (1.0 - least(1.0, abs(rs_y - ls_y) / greatest(abs(rs_x - ls_x), 1.0))) "
         "+ 0.4 * least(1.0, abs(rs_x - ls_x) / 80.0))), 0.5)")
project("p23_shot_quality", views.pose, views.ON_POSE, "pose", DET_KEYS, {
    "frontality": (r9(front), f"round({FRONT}, 9)"),
    "quality": (r9(pose.shot_quality(F.col("confidence") * 200, B.y2 - B.y1, front)),
                f"round(0.5 * least(1.0, confidence * 200 / 120.0) + 0.3 * least(1.0, (y2 - y1) / 80.0) + 0.2 * {FRONT}, 9)")})

area = geom.raw_area(B)
AREA = "greatest(1e-6, (x2 - x1) * (y2 - y1))"
project("p24_region_confidence", views.det, views.ON_DET, "det", DET_KEYS, {
    "colour_conf": (r9(scoring.colour_confidence(F.col("confidence"), area)),
                    f"round(greatest(0.0, least(0.95, 0.35 + 0.45 * confidence + 0.20 * least(1.0, {AREA} / 3600.0))), 9)"),
    "novelty_conf": (r9(scoring.novelty_confidence(F.col("frame") % 20, area)),
                     f"round(greatest(0.40, least(0.95, 0.35 + 0.30 * least(1.0, (frame % 20) / 16.0) + 0.35 * least(1.0, {AREA} / 2400.0))), 9)")})

# Crop-relative keypoints: (y, x, confidence) for the left and right shoulder and the nose.
_i = F.col("det_id") + F.col("frame")
_raw = F.array(*(F.struct((((_i * k) % 10) / 10.0).alias("y"), (((_i + k) % 10) / 10.0).alias("x"), (((_i * k + 1) % 10) / 10.0).alias("c"))
                 for k in (3, 7, 9)))
_kp = pose.frame_keypoints(_raw, B)


def _kp_sql(k: int, axis: str) -> str:
    value = f"y1 + (((det_id + frame) * {k}) % 10) / 10.0 * greatest(1.0, y2 - y1)" if axis == "y" else \
        f"x1 + ((det_id + frame + {k}) % 10) / 10.0 * greatest(1.0, x2 - x1)"
    return f"CASE WHEN (((det_id + frame) * {k} + 1) % 10) / 10.0 >= 0.2 THEN {value} END"


project("p25_keypoints_to_frame", views.pose, views.ON_POSE, "pose", DET_KEYS, {
    **{f"{n}_{a}": (r9(_kp[i][a]), f"round({_kp_sql(k, a)}, 9)") for i, (n, k) in enumerate((("ls", 3), ("rs", 7), ("nose", 9))) for a in "xy"},
    "torso_kx": (r9((_kp[0]["x"] + _kp[1]["x"]) / 2.0), f"round((({_kp_sql(3, 'x')}) + ({_kp_sql(7, 'x')})) / 2.0, 9)"),
    "torso_ky": (r9((_kp[0]["y"] + _kp[1]["y"]) / 2.0), f"round((({_kp_sql(3, 'y')}) + ({_kp_sql(7, 'y')})) / 2.0, 9)")})


def pair_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Finished pair rows, one per order: counters and flags vary with the keys so every gate is hit."""
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair_id"), *(F.expr(s).alias(n) for n, s in PAIR_FIELDS.items()))


PAIR_FIELDS = {
    "carried_frames": "o_orderkey % 13", "stationary_frames": "(o_orderkey + o_custkey) % 19",
    "departed_frames": "o_custkey % 11", "abandonment_frames": "(o_orderkey * 3) % 14",
    "max_departure_ratio": "((o_custkey * 7) % 20) / CAST(10 AS DOUBLE)", "mean_association": "((o_orderkey * 11) % 100) / CAST(100 AS DOUBLE)",
    "mean_confidence": "((o_custkey * 13) % 60) / CAST(100 AS DOUBLE)", "fallback_frames": "greatest(0, o_orderkey % 5 - 2)",
    "fallback_gap_frames": "CASE WHEN o_orderkey % 17 = 0 THEN 41 ELSE 0 END",
    "yolo_reconfirmed": "o_orderkey % 2 = 0", "other_person_closer_frames": "greatest(0, o_custkey % 9 - 4)",
    "ambiguous_frames": "o_orderkey % 7", "bag_seen_frames": "o_custkey % 23", "person_seen_frames": "o_custkey % 29",
    "release_frame": "CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey END",
    "departure_frame": "CASE WHEN o_custkey % 3 <> 0 THEN o_orderkey + 5 END",
    "state": "CASE o_orderkey % 3 WHEN 0 THEN 'BAG_CARRIED' WHEN 1 THEN 'BAG_ON_GROUND' ELSE 'PERSON_DEPARTED' END",
    "release_invalid": "o_orderkey % 19 = 0", "live_release_ground_ok": "o_custkey % 2 = 0",
    "ever_attached": "o_custkey % 5 = 0", "ever_wrist_near": "o_custkey % 4 = 0", "hand_separated": "o_orderkey % 3 = 0",
    "ever_contained": "o_custkey % 2 = 1", "ground_evidence_frames": "greatest(0, o_orderkey % 6 - 2)",
    "bin_zone_frames": "greatest(0, o_custkey % 8 - 5)", "separated_frames": "o_custkey % 6",
    "live_ground_ticks": "o_orderkey % 3", "max_post_release_norm_distance": "((o_orderkey * 7) % 50) / CAST(100 AS DOUBLE)",
    "max_object_displacement": "((o_orderkey * 17) % 60) + CAST(0 AS DOUBLE)", "release_person_height": "((o_custkey * 3) % 200) + CAST(0 AS DOUBLE)"}
PAIR_ROWS_SQL = "pair_rows AS (SELECT o_orderkey AS pair_id, " + ", ".join(f"{s} AS {n}" for n, s in PAIR_FIELDS.items()) + " FROM orders)"
ABANDONED, SETTLED = "abandonment_frames >= 8", "(stationary_frames >= 8 AND state IN ('BAG_ON_GROUND', 'PERSON_DEPARTED'))"
EVIDENCE_SQL = f"""scored AS (SELECT *, least(1.0, carried_frames / 6.0) AS carry_score,
    CASE WHEN release_frame IS NOT NULL THEN 1.0 ELSE 0.0 END AS release_score,
    CASE WHEN {ABANDONED} THEN 1.0 ELSE least(1.0, stationary_frames / 8.0) END AS stationary_score,
    CASE WHEN {ABANDONED} OR {SETTLED} THEN 1.0 ELSE least(1.0, max_departure_ratio) END AS departure_score,
    mean_association AS association_score, least(1.0, mean_confidence / 0.25) AS detection_score FROM pair_rows),
  ev AS (SELECT *, greatest(0.0, least(1.0, (0.25 * carry_score + 0.15 * release_score + 0.25 * stationary_score + 0.25 * departure_score
    + 0.10 * association_score) * detection_score
    * CASE WHEN fallback_frames <= 0 THEN 1.0 WHEN yolo_reconfirmed THEN 0.95 ELSE 0.90 END
    * CASE WHEN other_person_closer_frames > 3 THEN 0.0 WHEN other_person_closer_frames > 0
        THEN greatest(0.5, 1.0 - (other_person_closer_frames / 4.0) * 0.5) ELSE 1.0 END)) AS confidence FROM scored)"""
SCORES = ["carry_score", "release_score", "stationary_score", "departure_score", "association_score", "detection_score", "confidence"]


@query("p26_event_confidence", oracle=views.with_views(PAIR_ROWS_SQL, EVIDENCE_SQL)
       + f"SELECT pair_id, {', '.join(f'CAST(round({s}, 9) AS DOUBLE) AS {s}' for s in SCORES)} FROM ev")
def p26(spark, sf):
    scores = scoring.evidence(F.col, CFG)
    return pair_rows(spark, sf).select("pair_id", *(r9(v).alias(k) for k, v in scores.items()))


project("p27_location_status", pair_rows, views.with_views(PAIR_ROWS_SQL), "pair_rows", ["pair_id"], {"location_status": (
    scoring.location_status(F.col("bin_zone_frames"), F.col("ground_evidence_frames")),
    "CASE WHEN bin_zone_frames > 0 AND bin_zone_frames >= greatest(1, ground_evidence_frames) THEN 'BIN_ZONE' "
    "WHEN ground_evidence_frames > 0 THEN 'GROUND_CONFIRMED' WHEN bin_zone_frames > 0 THEN 'BIN_ZONE' ELSE 'LOCATION_AMBIGUOUS' END")})

GATE_SQL = """gate AS (SELECT *, (ever_attached OR ever_wrist_near) AS gripped, 0.15 AS sep_floor,
  (ground_evidence_frames <= 0 AND hand_separated AND (ever_attached OR ever_wrist_near) AND bin_zone_frames = 0 AND carried_frames <= 8) AS synthetic
  FROM ev), gate2 AS (SELECT *, CASE WHEN ground_evidence_frames <= 0 AND synthetic THEN 1 ELSE ground_evidence_frames END AS ground2 FROM gate),
  gate3 AS (SELECT *, CASE WHEN ground2 > 0 AND max_post_release_norm_distance >= 0.25 THEN 1 ELSE 3 END AS needed FROM gate2),
  gate4 AS (SELECT *, (max_post_release_norm_distance >= 0.15 AND separated_frames >= needed) AS apart FROM gate3)"""


@query("p28_rejection_ladder", oracle=views.with_views(PAIR_ROWS_SQL, EVIDENCE_SQL, GATE_SQL) + """
SELECT pair_id, CASE
  WHEN bag_seen_frames = 0 THEN 'BAG_NOT_DETECTED'
  WHEN release_invalid AND NOT live_release_ground_ok THEN 'NO_RELEASE_TRANSITION'
  WHEN fallback_gap_frames > 40 THEN 'BAG_NOT_DETECTED'
  WHEN mean_confidence < 0.10 THEN 'LOW_BAG_CONFIDENCE'
  WHEN person_seen_frames < 6 THEN 'PERSON_NOT_DETECTED'
  WHEN carried_frames < 6 AND NOT (carried_frames >= CASE WHEN ever_attached THEN 5 ELSE 4 END AND release_frame IS NOT NULL
       AND (max_post_release_norm_distance >= 0.15 OR separated_frames >= 2))
       AND NOT (ever_attached AND carried_frames >= 2 AND release_frame IS NOT NULL) THEN 'NOT_ENOUGH_CARRIED_FRAMES'
  WHEN release_frame IS NULL THEN 'NO_RELEASE_TRANSITION'
  WHEN NOT (abandonment_frames >= 8 OR (departure_frame IS NOT NULL AND max_departure_ratio >= 1.0)) THEN 'PERSON_DID_NOT_DEPART'
  WHEN stationary_frames < 8 AND abandonment_frames < 8 THEN 'BAG_NOT_STATIONARY'
  WHEN other_person_closer_frames > 3 THEN 'OTHER_PERSON_CLOSER'
  WHEN ambiguous_frames > 5 THEN 'ASSOCIATION_AMBIGUOUS'
  WHEN bin_zone_frames > 0 AND bin_zone_frames >= greatest(1, ground_evidence_frames) THEN 'BIN_ZONE_DEPOSIT'
  WHEN ground_evidence_frames <= 0 AND NOT synthetic AND bin_zone_frames > 0 THEN 'BIN_ZONE_DEPOSIT'
  WHEN ground_evidence_frames <= 0 AND NOT synthetic THEN 'BIN_DISPOSAL'
  WHEN ever_contained AND (NOT apart OR max_object_displacement < 0.12 * greatest(release_person_height, 80.0))
       AND NOT (hand_separated AND bin_zone_frames = 0 AND gripped) THEN 'NO_PHYSICAL_SEPARATION'
  WHEN confidence < 0.5 THEN 'EVENT_CONFIDENCE_TOO_LOW' END AS reason FROM gate4""")
def p28(spark, sf):
    confidence = scoring.evidence(F.col, CFG)["confidence"]
    return pair_rows(spark, sf).select("pair_id", scoring.rejection(F.col, confidence, CFG).alias("reason"))


_needed, _apart = scoring.separation(F.col, CFG)
project("p29_separation_gate", pair_rows, views.with_views(PAIR_ROWS_SQL), "pair_rows", ["pair_id"], {
    "sep_floor": (F.lit(scoring.separation_floor(CFG)), "CAST(0.15 AS DOUBLE)"),
    "ticks_needed": (_needed, "CASE WHEN ground_evidence_frames > 0 AND max_post_release_norm_distance >= 0.25 THEN 1 ELSE 3 END"),
    "separated": (_apart, "(max_post_release_norm_distance >= 0.15 AND separated_frames >= "
                          "CASE WHEN ground_evidence_frames > 0 AND max_post_release_norm_distance >= 0.25 THEN 1 ELSE 3 END)")})

project("p31_detector_source", views.det, views.ON_DET, "det GROUP BY video_id, frame", ["video_id", "frame"], {"detector_source": (
    F.lit(0), "CASE WHEN bool_or(source = 'yolo') AND bool_or(source = 'color') THEN 'yolo_and_color' WHEN bool_or(source = 'color') "
    "THEN 'color_fallback_only' WHEN bool_or(source = 'yolo') THEN 'yolo_only' ELSE 'none' END")})


@query("p31_detector_source", ORACLES["p31_detector_source"])
def p31(spark, sf):
    """The distinct sources of a frame are a handful, so collect_set stays small."""
    sources = views.det(spark, sf).groupBy("video_id", "frame").agg(F.collect_set("source").alias("s"))
    return sources.select("video_id", "frame", scoring.source_label(F.col("s")).alias("detector_source"))


def job_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Job rows with a nested JSON report; some are missing or not JSON."""
    ev = views.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    i, k = F.col("event_id"), F.col("k")
    nested = F.concat(F.lit('{"pipeline_telemetry":{"current_stage":"S'), k % 12, F.lit('","candidates_count":'), k,
                      F.lit(',"metrics":{"candidates_count":'), k + 1, F.lit(',"rejected_count":'), k % 7, F.lit("}}"),
                      F.when(i % 2 == 0, F.concat(F.lit(',"rejected_count":'), k % 3)).otherwise(""), F.lit("}"))
    return ev.select(i.alias("job_id"), k.alias("persons_detected"),
                     F.when(i % 10 == 9, F.lit(None)).when(i % 10 == 8, F.lit("not json")).otherwise(nested).alias("report_json"))


@query("p32_job_report_fields", oracle="""WITH r AS (SELECT event_id AS job_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id AS i FROM events)
SELECT job_id, CASE WHEN i % 10 < 8 THEN 'S' || (k % 12) END AS current_stage,
  CASE WHEN i % 10 < 8 THEN k + 1 ELSE 0 END AS candidates_count,
  CASE WHEN i % 10 >= 8 THEN 0 WHEN i % 2 = 0 THEN k % 3 ELSE k % 7 END AS rejected_count,
  k AS unique_persons_count, CAST(12 AS BIGINT) AS total_stages FROM r""")
def p32(spark, sf):
    """Later levels override earlier ones: report over telemetry metrics over telemetry."""

    def field(name: str, default: Column) -> Column:
        doc = F.col("report_json")
        return F.coalesce(*(F.get_json_object(doc, path + name) for path in
                            ("$.", "$.pipeline_telemetry.metrics.", "$.pipeline_telemetry.")), default)

    return job_reports(spark, sf).select(
        "job_id", field("current_stage", F.lit(None).cast("string")).alias("current_stage"),
        field("candidates_count", F.lit("0")).cast("bigint").alias("candidates_count"),
        field("rejected_count", F.lit("0")).cast("bigint").alias("rejected_count"),
        field("unique_persons_count", F.col("persons_detected").cast("string")).cast("bigint").alias("unique_persons_count"),
        field("total_stages", F.lit("12")).cast("bigint").alias("total_stages"))


project("p33_confidence_bucket", views.evt, views.ON_EVT, "evt", ["id"], {
    "bucket": (scoring.confidence_bucket(F.col("confidence")),
               "CASE WHEN confidence < 0.5 THEN '0-50%' WHEN confidence < 0.7 THEN '50-70%' WHEN confidence < 0.85 THEN '70-85%' ELSE '85-100%' END"),
    "percent": (scoring.percent_text(F.col("confidence")), "CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '%'")})

_KNOB_NAMES = ["min_carried_frames", "release_distance_ratio", "min_event_confidence", "smoothing_window"]


@query("p34_threshold_overrides", oracle=f"""WITH r AS (SELECT o_orderkey AS run_id, o_orderkey % 3 AS tier, o_custkey % 4 AS learned FROM orders),
  base(knob, value) AS (VALUES {", ".join(f"('{k}', CAST({getattr(CFG, k)} AS DOUBLE))" for k in _KNOB_NAMES)})
SELECT run_id, knob, CAST(coalesce(
  CASE tier {" ".join(f"WHEN {i} THEN " + ("CASE knob " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in t.items() if k in _KNOB_NAMES) + " END" if t else "NULL") for i, t in enumerate(TIERS))} END,
  CASE WHEN learned = 1 AND knob = 'min_carried_frames' THEN 4 WHEN learned = 2 AND knob = 'release_distance_ratio' THEN 0.22 END, value) AS DOUBLE) AS value
FROM r CROSS JOIN base""")
def p34(spark, sf):
    """Base, then learned, then tier: the last map that names a knob wins; unknown names drop out."""

    def as_map(values: dict) -> Column:
        entries = [x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))]
        return F.create_map(*entries) if entries else F.create_map().cast("map<string,double>")

    tiers = F.get(F.array(*(as_map(t) for t in TIERS)), (F.col("o_orderkey") % 3).cast("int"))
    learned = F.get(F.array(*(as_map(m) for m in ({}, {"min_carried_frames": 4}, {"release_distance_ratio": 0.22}, {"no_such_knob": 1}))),
                    (F.col("o_custkey") % 4).cast("int"))
    runs = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), learned.alias("learned"), tiers.alias("tier"))
    base = {k: getattr(CFG, k) for k in _KNOB_NAMES}
    knobs = F.array(*(F.struct(F.lit(k).alias("knob"), F.coalesce(F.try_element_at("tier", F.lit(k)), F.try_element_at("learned", F.lit(k)), F.lit(float(v))).alias("value"))
                      for k, v in base.items()))
    return runs.select("run_id", F.inline(knobs))


@query("p35_milestones", oracle=views.with_views(PAIR_ROWS_SQL) + """, m AS (
  SELECT pair_id, unnest(['CARRY','RELEASE','DEPARTURE']) AS phase, unnest([CASE WHEN carried_frames > 0 THEN carried_frames END, release_frame, departure_frame]) AS frame, state FROM pair_rows)
SELECT pair_id, phase, frame, frame / 8.0 AS sec,
  CAST(CASE state WHEN 'BAG_CARRIED' THEN 2 WHEN 'BAG_ON_GROUND' THEN 4 ELSE 5 END AS INTEGER) AS steps_reached FROM m WHERE frame IS NOT NULL""")
def p35(spark, sf):
    """Milestone rows without empty phases, and how many checklist steps the furthest state covers."""
    steps = [s for s in STATES if s not in ("NO_BAG", "PICKED_BACK_UP")]
    rows = pair_rows(spark, sf).withColumn("CARRY", F.when(F.col("carried_frames") > 0, F.col("carried_frames")))
    rows = rows.withColumnRenamed("release_frame", "RELEASE").withColumnRenamed("departure_frame", "DEPARTURE")
    long = rows.unpivot(["pair_id", "state"], ["CARRY", "RELEASE", "DEPARTURE"], "phase", "frame").where("frame is not null")
    reached = F.array_position(F.array(*(F.lit(s) for s in steps)), F.col("state")).cast("int")
    return long.select("pair_id", "phase", "frame", (F.col("frame") / 8.0).alias("sec"), reached.alias("steps_reached"))
