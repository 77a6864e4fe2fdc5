"""Registered queries inside one frame: filters, deduplication, frame joins and ownership."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.config import Thresholds
from trackspark.functions import geom, labels, scoring
from trackspark.operators import assoc, detect
from trackspark.plans import views
from trackspark.plans.registry import query
from trackspark.plans.scalars import CONT, LEGACY, NEAR, NORM, OH, OW, PAIR_KEYS, PH, PW, WRIST_NEAR, r9

CFG = Thresholds()
KEYS = ["video_id", "frame", "det_id"]
SEMANTIC = "(source IN ('yolo','color') AND class_name <> 'detected_object' AND NOT starts_with(class_name, 'color_candidate'))"


def box_sql(a: str, b: str) -> dict[str, str]:
    """IoU, containments and duplicate test between two box aliases."""
    inter = (f"(greatest(0.0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1)) * "
             f"greatest(0.0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1)))")
    aa, ab = (f"greatest(1e-6, ({p}x2 - {p}x1) * ({p}y2 - {p}y1))" for p in (a, b))
    iou = f"({inter} / ({aa} + {ab} - {inter}))"
    return {"inter": inter, "aa": aa, "ab": ab, "iou": iou, "a_in_b": f"({inter} / {aa})", "b_in_a": f"({inter} / {ab})",
            "dup": f"({iou} >= 0.5 OR greatest({inter} / {aa}, {inter} / {ab}) >= 0.7)"}


D = box_sql("d.", "k.")


@query("f01_confidence_floor", oracle=views.ON_DET + "SELECT video_id, frame, det_id, confidence FROM det WHERE confidence >= 0.10")
def f01(spark, sf):
    return views.det(spark, sf).where(F.col("confidence") >= CFG.detection_low_conf).select(*KEYS, "confidence")


@query("f02_semantic_admission", oracle=views.ON_DET + f"SELECT video_id, frame, det_id, CASE WHEN {SEMANTIC} THEN 'semantic' ELSE 'proposal' END AS admission FROM det WHERE NOT is_person")
def f02(spark, sf):
    det = views.det(spark, sf).where(~F.col("is_person"))
    admitted = labels.is_semantic(F.col("source"), F.col("class_name"))
    return det.select(*KEYS, F.when(admitted, "semantic").otherwise("proposal").alias("admission"))


HANDHELD = f"NOT ({OW} * {OH} > 0.40 * greatest(1.0, {PW} * {PH}) OR {OW} > 1.15 * {PW} OR {OH} > 0.80 * {PH} OR {OW} * {OH} > 65000)"


@query("f03_handheld_size", oracle=views.ON_PAIRS + f"SELECT video_id, frame, person_id, object_id FROM pairs WHERE {HANDHELD}")
def f03(spark, sf):
    return views.pairs(spark, sf).where(assoc.handheld(geom.box("p_"), geom.box("o_"))).select(*PAIR_KEYS)


@query("f08_ground_clutter", oracle=views.ON_PAIRS + f"""
SELECT video_id, frame, person_id, object_id FROM pairs WHERE o_conf < 0.40 AND NOT {NEAR} AND (o_y1 + o_y2) / 2.0 >= p_y2 - 0.40 * {PH}""")
def f08(spark, sf):
    """Pairs refused as clutter: unsure, not near anyone, already resting on the ground plane."""
    pb, ob = geom.box("p_"), geom.box("o_")
    pairs = views.pairs(spark, sf)
    norm = geom.distance(geom.centroid(pb), geom.centroid(ob)) / geom.height(pb)
    near = (norm <= CFG.near_distance_ratio) | (geom.overlap_of_object(pb, ob) >= 0.25) | geom.carrying_zone(pb, ob)
    resting = geom.centroid(ob).y >= pb.y2 - CFG.ground_plane_margin_ratio * geom.height(pb)
    return pairs.where((F.col("o_conf") < CFG.min_carry_origin_confidence) & ~near & resting).select(*PAIR_KEYS)


@query("f09_candidate_classes", oracle=views.ON_DET + f"SELECT video_id, frame, det_id, class_name FROM det WHERE len(list_filter({labels.CANDIDATE_WORDS!r}, lambda w: contains(lower(class_name), w))) > 0")
def f09(spark, sf):
    return views.det(spark, sf).where(labels.is_candidate(F.col("class_name"))).select(*KEYS, "class_name")


@query("f10_region_shape", oracle=views.ON_DET + """SELECT video_id, frame, det_id FROM det WHERE NOT is_person
  AND (x2 - x1) * (y2 - y1) BETWEEN 900 AND 250000 AND (x2 - x1) / (y2 - y1) BETWEEN 0.25 AND 4.0 AND (x2 - x1) * (y2 - y1) <= 0.45 * 180 * 160""")
def f10(spark, sf):
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    shaped = (w * h).between(900, 250_000) & (w / h).between(0.25, 4.0) & (w * h <= 0.45 * 180 * 160)
    return views.det(spark, sf).where(~F.col("is_person") & shaped).select(*KEYS)


@query("u01_pooled_union", oracle=views.ON_DET + """SELECT source, count(*) AS n, count(*) FILTER (WHERE is_person) AS persons
  FROM det WHERE source <> 'yolo' OR is_person OR class_name <> 'detected_object' GROUP BY source""")
def u01(spark, sf):
    """Union of per-detector outputs with provenance; each detector drops what it may not report."""
    det = views.det(spark, sf)
    yolo = det.where((F.col("source") == "yolo") & (F.col("is_person") | (F.col("class_name") != "detected_object")))
    pooled = yolo.unionByName(det.where("source = 'color'")).unionByName(det.where("source = 'novelty'"))
    return pooled.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_person").alias("persons"))


def fold_sql(group: str, order: str, suppressed: str) -> str:
    """Greedy keep-list in rank order as a recursive fold over each group."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS r FROM det),
  fold AS (SELECT {group}, r, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'det_id': det_id}}] AS kept FROM ranked WHERE r = 1
    UNION ALL SELECT {", ".join("d." + g.strip() for g in group.split(","))}, d.r, CASE WHEN len(list_filter(f.kept, lambda k: {suppressed})) > 0 THEN f.kept
      ELSE list_append(f.kept, {{'x1': d.x1, 'y1': d.y1, 'x2': d.x2, 'y2': d.y2, 'det_id': d.det_id}}) END
    FROM fold f JOIN ranked d ON {" AND ".join(f"f.{g.strip()} = d.{g.strip()}" for g in group.split(","))} AND d.r = f.r + 1),
  done AS (SELECT {group}, unnest(arg_max(kept, r)) AS k FROM fold GROUP BY {group})"""


AREA_D = "greatest(1e-6, (x2 - x1) * (y2 - y1))"
U2_SQL = views.with_views(views.DET_SQL, fold_sql(
    "video_id, frame, is_person", f"CASE source WHEN 'yolo' THEN 0 WHEN 'color' THEN 1 ELSE 2 END, -confidence, {AREA_D}, x1, y1, x2, y2, det_id",
    D["dup"]), recursive=True)


@query("u02_pooled_dedup", oracle=U2_SQL + "SELECT video_id, frame, is_person, k.det_id AS det_id FROM done")
def u02(spark, sf):
    return detect.pooled_dedup(views.det(spark, sf)).select("video_id", "frame", "is_person", "det_id")


@query("u03_containment_nms", oracle=views.with_views(views.DET_SQL, fold_sql(
    "video_id, frame, source, is_person", "-confidence, det_id", D["a_in_b"] + " >= 0.7"), recursive=True)
    + "SELECT video_id, frame, source, is_person, k.det_id AS det_id FROM done")
def u03(spark, sf):
    return detect.containment_dedup(views.det(spark, sf)).select("video_id", "frame", "source", "is_person", "det_id")


@query("a25_dedup_accounting", oracle=U2_SQL + """, per_frame AS (SELECT d.video_id, d.frame, count(*) AS raw FROM det d GROUP BY 1, 2),
  kept AS (SELECT video_id, frame, count(*) AS after FROM done GROUP BY 1, 2)
SELECT video_id, count(*) AS frames, CAST(sum(raw) AS BIGINT) AS raw, CAST(sum(raw - after) AS BIGINT) AS removed,
  CAST(sum(after) AS BIGINT) AS after, count(*) FILTER (WHERE raw > after) AS frames_with_dup FROM per_frame JOIN kept USING (video_id, frame) GROUP BY video_id""")
def a25(spark, sf):
    det = views.det(spark, sf)
    raw = det.groupBy(*detect.FRAME).agg(F.count(F.lit(1)).alias("raw"))
    kept = detect.pooled_dedup(det).groupBy(*detect.FRAME).agg(F.count(F.lit(1)).alias("after"))
    return raw.join(kept, detect.FRAME).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("raw").alias("raw"), F.sum(F.col("raw") - F.col("after")).alias("removed"),
        F.sum("after").alias("after"), F.count_if(F.col("raw") > F.col("after")).alias("frames_with_dup"))


AB = box_sql("a.", "b.")
J2_TYPE = f"""CASE WHEN NOT ({AB['iou']} > 0.02 OR greatest({AB['a_in_b']}, {AB['b_in_a']}) > 0.05) THEN 'DISTINCT'
  WHEN NOT {AB['dup']} THEN 'LEGITIMATE_OVERLAP' WHEN a.source = b.source THEN 'SAME_PHYSICAL_OBJECT' ELSE 'LIKELY_DUPLICATE' END"""


@query("j02_duplicate_pairs", oracle=views.ON_DET + f"""SELECT a.video_id, a.frame, a.det_id AS a_id, b.det_id AS b_id, round({AB['iou']}, 9) AS iou,
  round(least({AB['aa']}, {AB['ab']}) / greatest({AB['aa']}, {AB['ab']}), 9) AS area_ratio, {J2_TYPE} AS verdict
  FROM det a JOIN det b ON a.video_id = b.video_id AND a.frame = b.frame AND a.is_person = b.is_person AND a.det_id < b.det_id
  WHERE {J2_TYPE} <> 'DISTINCT'""")
def j02(spark, sf):
    return detect.overlapping_pairs(views.det(spark, sf)).select(
        "video_id", "frame", F.col("a_det_id").alias("a_id"), F.col("b_det_id").alias("b_id"), r9(F.col("iou")).alias("iou"),
        r9(F.col("area_ratio")).alias("area_ratio"), "verdict")


@query("a25_pair_verdict_counts", oracle=views.ON_DET + f"""SELECT a.video_id,
  count(*) FILTER (WHERE a.is_person = b.is_person AND {J2_TYPE} = 'SAME_PHYSICAL_OBJECT') AS same_physical,
  count(*) FILTER (WHERE a.is_person = b.is_person AND {J2_TYPE} = 'LIKELY_DUPLICATE') AS likely_duplicate,
  count(*) FILTER (WHERE a.is_person <> b.is_person OR {J2_TYPE} = 'LEGITIMATE_OVERLAP') AS legitimate_overlap,
  count(*) FILTER (WHERE a.is_person = b.is_person AND {J2_TYPE} = 'DISTINCT') AS distinct_pairs
  FROM det a JOIN det b ON a.video_id = b.video_id AND a.frame = b.frame AND a.det_id < b.det_id GROUP BY a.video_id""")
def a25_pairs(spark, sf):
    return detect.pair_verdict_counts(views.det(spark, sf))


@query("j03_unknown_novelty", oracle=views.ON_DET + f"""SELECT video_id, frame, det_id FROM det d WHERE source = 'novelty' AND NOT is_person
  AND NOT EXISTS (SELECT 1 FROM det k WHERE k.video_id = d.video_id AND k.frame = d.frame AND k.source <> 'novelty' AND NOT k.is_person AND {D['dup']})""")
def j03(spark, sf):
    return detect.drop_known_novelty(views.det(spark, sf)).select(*KEYS)


CD = "sqrt(((d.x1 + d.x2) / 2.0 - (k.x1 + k.x2) / 2.0) * ((d.x1 + d.x2) / 2.0 - (k.x1 + k.x2) / 2.0) + ((d.y1 + d.y2) / 2.0 - (k.y1 + k.y2) / 2.0) * ((d.y1 + d.y2) / 2.0 - (k.y1 + k.y2) / 2.0))"
D_IN_K = "((d.x1 + d.x2) / 2.0 BETWEEN k.x1 AND k.x2 AND (d.y1 + d.y2) / 2.0 BETWEEN k.y1 AND k.y2)"


@query("j04_nearest_person", oracle=views.ON_DET + f"""SELECT d.video_id, d.frame, d.det_id, coalesce(bool_or({D_IN_K}), false) AS inside,
  CASE WHEN NOT coalesce(bool_or({D_IN_K}), false) THEN arg_min(k.det_id, ({CD}, k.det_id)) FILTER (WHERE {CD} < 60) END AS person_id
  FROM det d LEFT JOIN det k ON k.video_id = d.video_id AND k.frame = d.frame AND k.is_person WHERE NOT d.is_person GROUP BY 1, 2, 3""")
def j04(spark, sf):
    det = views.det(spark, sf)
    return detect.nearest_person(det.where(~F.col("is_person")), det.where("is_person"), 60.0)


@query("j04_near_person_gate", oracle=views.ON_DET + """SELECT video_id, frame, det_id FROM det d WHERE NOT is_person AND EXISTS (
  SELECT 1 FROM det k WHERE k.is_person AND k.video_id = d.video_id AND k.frame = d.frame
  AND (d.x1 + d.x2) / 2.0 BETWEEN k.x1 - 0.1 * greatest(1.0, k.y2 - k.y1) AND k.x2 + 0.1 * greatest(1.0, k.y2 - k.y1)
  AND (d.y1 + d.y2) / 2.0 BETWEEN k.y1 - 0.1 * greatest(1.0, k.y2 - k.y1) AND k.y2 + 0.1 * greatest(1.0, k.y2 - k.y1))""")
def j04_gate(spark, sf):
    det = views.det(spark, sf)
    return detect.near_any_person(det.where(~F.col("is_person")), det.where("is_person"), 0.1).select(*KEYS)


SMALL_DET = """small AS (SELECT video_id, frame, det_id, is_person, class_name, CASE WHEN is_person THEN x1 ELSE x1 + 10 END AS x1,
  CASE WHEN is_person THEN y1 ELSE y1 + 60 END AS y1, CASE WHEN is_person THEN x2 ELSE x1 + 10 + (x2 - x1) / 4 END AS x2,
  CASE WHEN is_person THEN y2 ELSE y1 + 60 + (y2 - y1) / 4 END AS y2 FROM det)"""
RATIO = "(greatest(1.0, d.x2 - d.x1) * greatest(1.0, d.y2 - d.y1)) / (greatest(1.0, k.x2 - k.x1) * greatest(1.0, k.y2 - k.y1))"
KW, KH = "greatest(1.0, k.x2 - k.x1)", "greatest(1.0, k.y2 - k.y1)"


@query("j05_promote_colour", oracle=views.with_views(views.DET_SQL, SMALL_DET) + f""", fit AS (SELECT d.video_id, d.frame, d.det_id, min({RATIO}) AS best_ratio
  FROM small d JOIN small k ON k.video_id = d.video_id AND k.frame = d.frame AND k.is_person
  WHERE NOT d.is_person AND starts_with(d.class_name, 'color_candidate_')
    AND (d.x1 + d.x2) / 2.0 BETWEEN k.x1 - 0.25 * {KW} AND k.x2 + 0.25 * {KW} AND (d.y1 + d.y2) / 2.0 BETWEEN k.y1 + 0.30 * {KH} AND k.y2 + 0.15 * {KH}
    AND {RATIO} BETWEEN 0.003 AND 0.12 AND NOT (d.class_name = 'color_candidate_red' AND ({RATIO} > 0.06 OR greatest(1.0, d.y2 - d.y1) > 0.25 * {KH}))
  GROUP BY 1, 2, 3)
SELECT d.video_id, d.frame, d.det_id, CASE WHEN best_ratio IS NULL THEN class_name ELSE replace(class_name, 'color_candidate_', '') || '_waste_bag' END AS promoted_class
FROM small d LEFT JOIN fit USING (video_id, frame, det_id) WHERE NOT d.is_person AND starts_with(d.class_name, 'color_candidate_')""")
def j05(spark, sf):
    """Objects are shrunk to a quarter and moved to the lower body, so that all outcomes occur."""
    det = views.det(spark, sf)
    obj = ~F.col("is_person")
    small = det.select("video_id", "frame", "det_id", "is_person", "class_name",
                       F.when(obj, F.col("x1") + 10).otherwise(F.col("x1")).alias("x1"),
                       F.when(obj, F.col("y1") + 60).otherwise(F.col("y1")).alias("y1"),
                       F.when(obj, F.col("x1") + 10 + (F.col("x2") - F.col("x1")) / 4).otherwise(F.col("x2")).alias("x2"),
                       F.when(obj, F.col("y1") + 60 + (F.col("y2") - F.col("y1")) / 4).otherwise(F.col("y2")).alias("y2"))
    return detect.promote_colour(small).select(*KEYS, "promoted_class")


LATCH = f"""latched AS (SELECT DISTINCT d.video_id, d.frame, d.det_id FROM det d JOIN det k ON k.is_person AND k.video_id = d.video_id AND k.frame = d.frame
  WHERE NOT d.is_person AND (d.x1 + d.x2) / 2.0 BETWEEN k.x1 - 0.1 * {KW} AND k.x2 + 0.1 * {KW} AND (d.y1 + d.y2) / 2.0 BETWEEN k.y1 + 0.15 * {KH} AND k.y2 - 0.15 * {KH}
  AND {D['inter']} / greatest(1.0, (d.x2 - d.x1) * (d.y2 - d.y1)) >= 0.45)"""


@query("j06_body_latch", oracle=views.with_views(views.DET_SQL, LATCH) + "SELECT * FROM latched")
def j06(spark, sf):
    det = views.det(spark, sf)
    return detect.latched_on_body(det.where(~F.col("is_person")), det.where("is_person")).select(*KEYS)


@query("j06_colour_fallback_frames", oracle=views.with_views(views.DET_SQL, LATCH) + """SELECT DISTINCT video_id, frame FROM det f WHERE NOT EXISTS (
  SELECT 1 FROM det d WHERE d.video_id = f.video_id AND d.frame = f.frame AND NOT d.is_person
    AND NOT EXISTS (SELECT 1 FROM latched l WHERE l.video_id = d.video_id AND l.frame = d.frame AND l.det_id = d.det_id))""")
def j06_frames(spark, sf):
    return detect.needs_colour_fallback(views.det(spark, sf))


ZONE_SQL = """zones AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 16 END AS camera_id, s_name AS zone,
  (s_suppkey % 10) / CAST(10 AS DOUBLE) * 0.25 AS zx, (s_suppkey % 7) / CAST(7 AS DOUBLE) * 0.25 AS zy FROM supplier)"""


@query("j07_zone_membership", oracle=views.with_views(views.DET_SQL, ZONE_SQL) + """, hit AS (
  SELECT d.video_id, zone FROM det d JOIN zones ON camera_id IS NULL OR camera_id = d.video_id
  WHERE ((zy > (y1 + y2) / 2.0 / 480) <> (zy + 0.05 > (y1 + y2) / 2.0 / 480)) AND (x1 + x2) / 2.0 / 640 < zx + 0.08 AND NOT is_person
    AND NOT (x1 + x2) / 2.0 / 640 < (0.0 * ((y1 + y2) / 2.0 / 480 - (zy + 0.05)) / 1e-12 + zx))
SELECT video_id, zone, count(*) AS n FROM hit GROUP BY 1, 2""")
def j07(spark, sf):
    """Zones are drawn from the suppliers: a quarter apply to every camera, the rest to one."""
    sup = views.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    x, y = (k % 10) / F.lit(10.0) * 0.25, (k % 7) / F.lit(7.0) * 0.25
    zones = sup.select(F.when(k % 4 != 0, k % 16).alias("camera_id"), F.col("s_name").alias("zone"),
                       geom.polygon_from_box(geom.Box(x, y, x + 0.08, y + 0.05)).alias("polygon"))
    det = views.det(spark, sf).where(~F.col("is_person")).withColumn("camera_id", F.col("video_id"))
    return assoc.zone_counts(det, zones, ["video_id"], "zone", views.FRAME_W, views.FRAME_H)


@query("j13_best_overlap", oracle=views.ON_DET + f"""SELECT d.video_id, d.frame, d.det_id, round(coalesce(max({D['iou']}), 0.0), 9) AS person_iou,
  coalesce(max({D['iou']}), 0.0) >= 0.4 AS wraps_person FROM det d LEFT JOIN det k ON k.is_person AND k.video_id = d.video_id AND k.frame = d.frame
  WHERE NOT d.is_person GROUP BY 1, 2, 3""")
def j13(spark, sf):
    det = views.det(spark, sf)
    out = detect.best_overlap(det.where(~F.col("is_person")), det.where("is_person"))
    return out.withColumn("person_iou", r9(F.col("person_iou")))


TIGHT = """CASE WHEN person_iou >= 0.40 THEN 'unusable_contains_person' WHEN area_share >= 0.40 OR height_share >= 0.80 THEN 'unusable_huge_box'
  WHEN area_share >= 0.08 THEN 'loose' ELSE 'tight' END"""


@query("p30_box_tightness", oracle=views.ON_DET + f""", b AS (SELECT d.video_id, d.frame, d.det_id, coalesce(max({D['iou']}), 0.0) AS person_iou,
  any_value((d.x2 - d.x1) * (d.y2 - d.y1) / (320.0 * 140.0)) AS area_share, any_value((d.y2 - d.y1) / 140.0) AS height_share
  FROM det d LEFT JOIN det k ON k.is_person AND k.video_id = d.video_id AND k.frame = d.frame WHERE NOT d.is_person GROUP BY 1, 2, 3)
SELECT video_id, {TIGHT} AS tightness, count(*) AS n FROM b GROUP BY 1, 2""")
def p30(spark, sf):
    det = views.det(spark, sf)
    objects = det.where(~F.col("is_person"))
    shares = objects.withColumn("area_share", geom.raw_area(geom.box()) / (320.0 * 140.0)).withColumn("height_share", (F.col("y2") - F.col("y1")) / 140.0)
    rated = shares.join(detect.best_overlap(objects, det.where("is_person")), KEYS)
    label = scoring.box_tightness(F.col("person_iou"), F.col("area_share"), F.col("height_share"))
    return rated.groupBy("video_id", label.alias("tightness")).agg(F.count(F.lit(1)).alias("n"))


@query("j25_source_agreement", oracle=views.ON_DET + f""", hit AS (SELECT video_id, frame, track_no FROM det d WHERE source = 'novelty' AND NOT is_person AND EXISTS (
  SELECT 1 FROM det k WHERE k.source = 'yolo' AND NOT k.is_person AND k.video_id = d.video_id AND k.frame = d.frame AND ({D_IN_K} OR {D['iou']} > 0.1)))
SELECT video_id, count(*) AS boxes, count(DISTINCT frame) AS frames, count(DISTINCT track_no) AS tracks FROM hit GROUP BY video_id""")
def j25(spark, sf):
    return detect.agreeing_proposals(views.det(spark, sf)).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("boxes"), F.countDistinct("frame").alias("frames"), F.countDistinct("track_no").alias("tracks"))


CAND_SQL = f"""cand AS (SELECT *, {NORM} AS norm_distance, {CONT} AS contained, {LEGACY} AS score, {NEAR} AS near, {WRIST_NEAR} AS wrist_near
  FROM pairs WHERE {HANDHELD} AND p_conf >= 0.10 AND o_conf >= 0.10 AND ({NEAR} OR {NORM} >= 1.25 OR {CONT} > 0 OR {NORM} <= 1.0))"""
ON_CAND = views.with_views(views.DET_SQL, views.POSE_SQL, views.PAIRS_SQL, CAND_SQL)


@query("j01_pair_candidates", oracle=ON_CAND + """SELECT video_id, frame, person_id, object_id, round(norm_distance, 9) AS norm_distance, round(score, 9) AS score, near, wrist_near FROM cand""")
def j01(spark, sf):
    return assoc.candidates(views.pairs(spark, sf), CFG).select(
        *PAIR_KEYS, r9(F.col("norm_distance")).alias("norm_distance"), r9(F.col("score")).alias("score"), "near", "wrist_near")


# Scores are rounded before they are ranked, so both engines order near-ties alike.
W9_SQL = """owner_rank AS (SELECT video_id, frame, object_id, person_id, o_source, near, round(score, 9) AS score, round(norm_distance, 9) AS norm_distance,
    row_number() OVER w AS rn, lead(round(score, 9)) OVER w AS s2, lead(round(norm_distance, 9)) OVER w AS d2 FROM cand
  WINDOW w AS (PARTITION BY video_id, frame, object_id ORDER BY round(score, 9) DESC, round(norm_distance, 9), person_id)),
  prim AS (SELECT *, coalesce(near AND score - s2 < 0.15, false) AS ambiguous, coalesce(near AND d2 < norm_distance * 0.95, false) AS other_closer FROM owner_rank WHERE rn = 1)"""
W10_SQL = """kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame, person_id
  ORDER BY CASE WHEN o_source = 'yolo' THEN 0 ELSE 1 END, score DESC, norm_distance, object_id) AS pr FROM prim) t WHERE pr = 1)"""


def ranked_candidates(det, pose):
    rows = assoc.candidates(views.pairs_of(pose, det.where(~F.col("is_person"))), CFG)
    return rows.withColumn("score", r9(F.col("score"))).withColumn("norm_distance", r9(F.col("norm_distance")))


@query("w09_primary_person", oracle=ON_CAND + "," + W9_SQL + " SELECT video_id, frame, object_id, person_id, ambiguous, other_closer FROM prim")
def w09(spark, sf):
    primary = assoc.primary_owner(ranked_candidates(views.det(spark, sf), views.pose(spark, sf)), CFG)
    return primary.select("video_id", "frame", "object_id", "person_id", "ambiguous", "other_closer")


@query("w10_one_object_per_person", oracle=ON_CAND + "," + W9_SQL + "," + W10_SQL + " SELECT video_id, frame, person_id, object_id FROM kept")
def w10(spark, sf):
    primary = assoc.primary_owner(ranked_candidates(views.det(spark, sf), views.pose(spark, sf)), CFG)
    return assoc.one_object_per_person(primary).select("video_id", "frame", "person_id", "object_id")


@query("w09_known_owner", oracle=ON_CAND + """, ranked AS (SELECT c.video_id, c.frame, c.object_id, c.person_id, c.person_id = c.object_id % 3 + 1 AS owned, row_number() OVER (
    PARTITION BY c.video_id, c.frame, c.object_id ORDER BY (c.person_id = c.object_id % 3 + 1) DESC, round(score, 9) DESC, round(norm_distance, 9), person_id) AS rn FROM cand c)
SELECT video_id, frame, object_id, person_id FROM ranked WHERE rn = 1""")
def w09_owned(spark, sf):
    """With an owners table: the known owner keeps the object whoever is closer."""
    det = views.det(spark, sf)
    owners = det.select("video_id", F.col("det_id").alias("object_id")).distinct().withColumn("owner_id", F.col("object_id") % 3 + 1)
    primary = assoc.primary_owner(ranked_candidates(det, views.pose(spark, sf)), CFG, owners)
    return primary.select("video_id", "frame", "object_id", "person_id")


@query("flagship_object_owners", oracle=U2_SQL + """, kept_ids AS (SELECT video_id, frame, is_person, k.det_id AS det_id FROM done),
  clean AS (SELECT d.* FROM det d JOIN kept_ids i ON d.video_id = i.video_id AND d.frame = i.frame AND d.is_person = i.is_person AND d.det_id = i.det_id),
  """ + views.POSE_SQL.replace("FROM det", "FROM clean") + ", " + views.PAIRS_SQL.replace("JOIN det o", "JOIN clean o") + f", {CAND_SQL}, {W9_SQL}, {W10_SQL}" + """
SELECT video_id, count(*) AS owned_ticks, count(DISTINCT person_id) AS persons, count(*) FILTER (WHERE ambiguous) AS ambiguous_ticks,
  count(*) FILTER (WHERE other_closer) AS closer_ticks, round(avg(score), 6) AS mean_score FROM kept GROUP BY video_id""")
def flagship(spark, sf):
    """Per video: deduplicate, pair, choose owners, and count how often the owner is unclear."""
    clean = detect.pooled_dedup(views.det(spark, sf))
    kept = assoc.one_object_per_person(assoc.primary_owner(ranked_candidates(clean, views.with_pose(clean)), CFG))
    return kept.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("owned_ticks"), F.countDistinct("person_id").alias("persons"),
        F.count_if("ambiguous").alias("ambiguous_ticks"), F.count_if("other_closer").alias("closer_ticks"),
        F.round(F.avg("score"), 6).alias("mean_score"))
