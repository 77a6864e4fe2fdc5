"""Registered audits over detections and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import geom, pose
from trackspark.operators import assoc, audit, quantiles
from trackspark.plans import views
from trackspark.plans.frames import ON_CAND, box_sql
from trackspark.plans.registry import query
from trackspark.plans.scalars import CFG, LW, OB, PB, POSE_SQL, POSE_ZONE, RW, LS, RS, TORSO, O_STEP, P_STEP, r9

TRACK = ["video_id", "track_no", "is_person"]
TRACK_SQL = """tracks AS (SELECT video_id, track_no, is_person, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_boxes,
  avg((x1 + x2) / 2.0) AS mean_cx, avg((y1 + y2) / 2.0) AS mean_cy, arg_min(source, (frame, det_id)) AS source FROM det GROUP BY 1, 2, 3)"""


@query("a07_track_table", oracle=views.with_views(views.DET_SQL, TRACK_SQL) + "SELECT video_id, track_no, is_person, first_frame, last_frame, n_boxes, (last_frame - first_frame + 1) / 30.0 AS duration_s, round(mean_cx, 6) AS mean_cx, round(mean_cy, 6) AS mean_cy, source FROM tracks")
def a07(spark, sf):
    t = audit.track_table(views.det(spark, sf), TRACK)
    return t.select(*TRACK, "first_frame", "last_frame", "n_boxes", ((F.col("last_frame") - F.col("first_frame") + 1) / 30.0).alias("duration_s"),
                    F.round("mean_cx", 6).alias("mean_cx"), F.round("mean_cy", 6).alias("mean_cy"), "source")


T5_SQL = """r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY first_frame, track_id) AS rn FROM trk WHERE NOT is_person),
  f AS (SELECT video_id, rn, track_id, track_id AS object_id, [{'o': rn, 'name': track_id, 'lf': last_frame, 'x': cx, 'y': cy}] AS recs FROM r WHERE rn = 1
    UNION ALL SELECT video_id, rn, track_id, coalesce(m.name, track_id), CASE WHEN m IS NULL THEN list_append(recs, {'o': rn, 'name': track_id, 'lf': last_frame, 'x': cx, 'y': cy})
      ELSE list_transform(recs, lambda u: CASE WHEN u.o = -m.o AND last_frame > u.lf THEN {'o': u.o, 'name': u.name, 'lf': last_frame, 'x': cx, 'y': cy} ELSE u END) END
    FROM (SELECT r.*, f.recs, list_sort(list_transform(list_filter(f.recs, lambda u: r.first_frame - u.lf <= 8 AND sqrt((u.x - r.cx) ** 2 + (u.y - r.cy) ** 2) <= 30),
        lambda u: {'d': sqrt((u.x - r.cx) ** 2 + (u.y - r.cy) ** 2), 'o': -u.o, 'name': u.name}))[1] AS m FROM f JOIN r ON r.video_id = f.video_id AND r.rn = f.rn + 1) q)"""


def t05_base(spark, sf):
    return views.trk(spark, sf).where(~F.col("is_person"))


@query("t05_physical_objects", oracle=views.with_views(views.TRK_SQL, T5_SQL, recursive=True) + "SELECT video_id, track_id, object_id FROM f")
def t05(spark, sf):
    return audit.physical_objects(t05_base(spark, sf), 8, 30.0)


@query("t05_split_objects", oracle=views.with_views(views.TRK_SQL, T5_SQL, recursive=True) + "SELECT video_id, track_id, object_id FROM f")
def t05_split(spark, sf):
    """Physical objects with every video dealt over the groups of tracks that could meet."""
    return audit.physical_objects(t05_base(spark, sf), 8, 30.0, split=True)


@query("a08_track_quality", oracle=views.with_views(views.TRK_SQL, T5_SQL, recursive=True) + """, g AS (SELECT t.video_id, f.object_id, (max(t.last_frame) - min(t.first_frame) + 1) / 30.0 AS sec, count(*) AS raw FROM trk t JOIN f ON f.video_id = t.video_id AND f.track_id = t.track_id GROUP BY 1, 2)
SELECT video_id, count(*) AS n_tracks, round(avg(sec), 6) AS avg_s, max(sec) AS max_s, min(sec) AS min_s, CAST(sum(raw - 1) AS BIGINT) AS id_switches, count(*) FILTER (WHERE raw > 1) AS reassociated,
  count(*) FILTER (WHERE sec < 1.0) AS short_lt_1s, list_sort(list(sec))[count(*) // 2 + 1] AS median_s FROM g GROUP BY video_id""")
def a08(spark, sf):
    tracks = t05_base(spark, sf)
    named = audit.physical_objects(tracks, 8, 30.0)
    grouped = tracks.join(named, ["video_id", "track_id"]).groupBy("video_id", "object_id").agg(
        F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"), F.count(F.lit(1)).alias("raw_ids"))
    return audit.track_quality(grouped, ["video_id"], 30.0).withColumn("avg_s", F.round("avg_s", 6))


@query("a08_raw_track_quality", oracle=views.ON_TRK + """, d AS (SELECT video_id, is_person, (last_frame - first_frame + 1) / 30.0 AS sec FROM trk)
SELECT video_id, is_person, count(*) AS n_tracks, round(avg(sec), 6) AS avg_s, max(sec) AS max_s, min(sec) AS min_s, CAST(0 AS BIGINT) AS id_switches, CAST(0 AS BIGINT) AS reassociated,
  count(*) FILTER (WHERE sec < 1.0) AS short_lt_1s, list_sort(list(sec))[count(*) // 2 + 1] AS median_s FROM d GROUP BY 1, 2""")
def a08_raw(spark, sf):
    """Track quality when every raw id counts as its own object."""
    raw = views.trk(spark, sf).withColumn("raw_ids", F.lit(1).cast("bigint"))
    return audit.track_quality(raw, ["video_id", "is_person"], 30.0).withColumn("avg_s", F.round("avg_s", 6))


@query("a09_tracker_comparison", oracle=views.ON_DET + """, s AS (SELECT video_id, source, track_no, (max(frame) - min(frame) + 1) / 30.0 AS sec FROM det GROUP BY 1, 2, 3),
  c AS (SELECT video_id, source, max(n) AS max_concurrent FROM (SELECT video_id, source, frame, count(DISTINCT track_no) AS n FROM det GROUP BY 1, 2, 3) t GROUP BY 1, 2)
SELECT video_id, source, count(*) AS unique_ids, max(sec) AS longest_s, count(*) FILTER (WHERE sec < 1.0) AS short_lt_1s, count(*) FILTER (WHERE sec < 0.5) AS short_lt_05s,
  list_sort(list(sec))[count(*) // 2 + 1] AS median_s, any_value(max_concurrent) AS max_concurrent, greatest(0, count(*) - any_value(max_concurrent)) AS fragmentation
FROM s JOIN c USING (video_id, source) GROUP BY 1, 2""")
def a09(spark, sf):
    return audit.tracker_comparison(views.det(spark, sf), ["video_id", "source"], "track_no", 30.0)


D = box_sql("d.", "k.")


@query("a10_counts_by_model_class", oracle=views.ON_DET + f""", w AS (SELECT d.video_id, d.frame, d.det_id, d.source, d.class_name, coalesce(max({D['iou']}), 0.0) >= 0.4 AS wraps
  FROM det d LEFT JOIN det k ON k.is_person AND k.video_id = d.video_id AND k.frame = d.frame WHERE NOT d.is_person GROUP BY 1, 2, 3, 4, 5)
SELECT source, class_name, count(*) AS n, count(*) FILTER (WHERE wraps) AS wrapped, round(count(*) FILTER (WHERE wraps) / count(*), 9) AS wrap_share FROM w GROUP BY 1, 2""")
def a10(spark, sf):
    from trackspark.operators import detect
    det = views.det(spark, sf)
    objects = det.where(~F.col("is_person"))
    best = objects.join(detect.best_overlap(objects, det.where("is_person")), ["video_id", "frame", "det_id"])
    return best.groupBy("source", "class_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("wraps_person").alias("wrapped")).withColumn(
        "wrap_share", r9(F.col("wrapped") / F.col("n")))


@query("a10_counts_by_video", oracle=views.ON_DET + """SELECT video_id, count(*) FILTER (WHERE source = 'yolo') AS yolo, count(*) FILTER (WHERE source = 'color') AS color,
  count(*) FILTER (WHERE source = 'novelty') AS novelty FROM det GROUP BY video_id""")
def a10_video(spark, sf):
    """A pivot over the fixed list of sources."""
    counts = views.det(spark, sf).groupBy("video_id").pivot("source", ["yolo", "color", "novelty"]).count()
    return counts.na.fill(0)


@query("a11_scene_statistics", oracle=views.ON_TICK + """SELECT video_id, count(*) AS n, round(avg(value), 6) AS motion_mean, round(stddev_pop(value), 6) AS motion_stdev, max(value) AS motion_max,
  count(*) FILTER (WHERE value > 30) AS frames_above, CASE WHEN avg(value) < 25.0 THEN 'STATIC' ELSE 'POSSIBLE_MOTION' END AS viewpoint FROM tick GROUP BY video_id""")
def a11(spark, sf):
    ev = views.table(spark, sf, "events")
    return ev.groupBy(F.col("user_id").alias("video_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("motion_mean"), F.round(F.stddev_pop("value"), 6).alias("motion_stdev"), F.max("value").alias("motion_max"),
        F.count_if(F.col("value") > 30).alias("frames_above"), F.when(F.avg("value") < 25.0, "STATIC").otherwise("POSSIBLE_MOTION").alias("viewpoint"))


@query("a12_peak_concurrent", oracle=views.ON_DET + """SELECT video_id, is_person, max(n) AS max_concurrent FROM (SELECT video_id, is_person, frame, count(DISTINCT det_id) AS n FROM det GROUP BY 1, 2, 3) t GROUP BY 1, 2""")
def a12(spark, sf):
    return audit.peak_concurrent(views.det(spark, sf), ["video_id", "is_person"], "det_id")


@query("a13_identity_audit", oracle=views.ON_DET + """, s AS (SELECT video_id, track_no % 15 AS uid, count(DISTINCT track_no) AS raw_ids FROM det GROUP BY 1, 2),
  c AS (SELECT video_id, count(*) FILTER (WHERE n <> u) AS collisions FROM (SELECT video_id, frame, count(*) AS n, count(DISTINCT track_no % 15) AS u FROM det GROUP BY 1, 2) t GROUP BY 1)
SELECT video_id, count(*) AS uids, count(*) FILTER (WHERE raw_ids > 1) AS switched, any_value(collisions) AS collisions FROM s JOIN c USING (video_id) GROUP BY video_id""")
def a13(spark, sf):
    switches, frames = audit.identity_audit(views.det(spark, sf), F.col("track_no") % 15, "track_no")
    s = switches.groupBy("video_id").agg(F.count(F.lit(1)).alias("uids"), F.count_if(F.col("raw_ids") > 1).alias("switched"))
    return s.join(frames.groupBy("video_id").agg(F.count_if("collides").alias("collisions")), "video_id")


@query("a14_corpus_rollup", oracle=views.ON_DET + """, v AS (SELECT video_id, count(DISTINCT CASE WHEN is_person THEN track_no END) AS p, count(DISTINCT CASE WHEN NOT is_person THEN track_no END) AS o,
  count(*) FILTER (WHERE is_person) AS pr, count(*) FILTER (WHERE NOT is_person) AS orr FROM det GROUP BY video_id)
SELECT count(*) AS videos_ok, CAST(sum(p) AS BIGINT) AS person_tracks, CAST(sum(o) AS BIGINT) AS object_tracks, count(*) FILTER (WHERE p >= 2) AS multi_person,
  count(*) FILTER (WHERE o >= 2) AS multi_object, CAST(sum(pr) AS BIGINT) AS person_records, CAST(sum(orr) AS BIGINT) AS object_records FROM v""")
def a14(spark, sf):
    per = views.det(spark, sf).groupBy("video_id").agg(
        F.countDistinct(F.when(F.col("is_person"), F.col("track_no"))).alias("p"), F.countDistinct(F.when(~F.col("is_person"), F.col("track_no"))).alias("o"),
        F.count_if("is_person").alias("pr"), F.count_if(~F.col("is_person")).alias("orr"))
    return per.agg(F.count(F.lit(1)).alias("videos_ok"), F.sum("p").alias("person_tracks"), F.sum("o").alias("object_tracks"), F.count_if(F.col("p") >= 2).alias("multi_person"),
                   F.count_if(F.col("o") >= 2).alias("multi_object"), F.sum("pr").alias("person_records"), F.sum("orr").alias("object_records"))


@query("a18_stage_latency", oracle="""SELECT l_returnflag AS stage, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_ms, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50,
  round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(sum(l_extendedprice), 2) AS total_ms, round(sum(l_extendedprice) / sum(sum(l_extendedprice)) OVER (), 9) AS share FROM lineitem GROUP BY 1""")
def a18(spark, sf):
    """Latency per stage; quantiles are exact and never sort a whole stage in one task."""
    rows = views.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("stage"), F.col("l_extendedprice").alias("ms"))
    q = quantiles.quantiles(rows, ["stage"], "ms", {"p50": 0.5, "p95": 0.95}, width=100.0).drop("n")
    agg = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"), F.sum("ms").alias("total"))
    whole = rows.agg(F.sum("ms").alias("whole")).withColumn("k", F.lit(1))
    out = agg.withColumn("k", F.lit(1)).join(whole, "k").join(q, "stage")
    return out.select("stage", "n", F.round("mean_ms", 4).alias("mean_ms"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"),
                      F.round("total", 2).alias("total_ms"), r9(F.col("total") / F.col("whole")).alias("share"))


@query("a19_scene_calibration", oracle=views.ON_DET + """, p AS (SELECT * FROM det WHERE is_person AND frame < 24), h AS (SELECT video_id, median(y2 - y1) AS med_h FROM p WHERE y2 - y1 > 8 GROUP BY 1),
  st AS (SELECT video_id, sqrt(((x1 + x2) / 2.0 - lag((x1 + x2) / 2.0) OVER w) ** 2 + ((y1 + y2) / 2.0 - lag((y1 + y2) / 2.0) OVER w) ** 2) AS step FROM p WINDOW w AS (PARTITION BY video_id, track_no ORDER BY frame, det_id)),
  m AS (SELECT video_id, median(step) AS med_step FROM st GROUP BY 1),
  c AS (SELECT video_id, med_h, med_step, greatest(2.0, least(48.0, 8.0 * greatest(0.5, least(3.0, med_h / 160.0)))) AS base FROM h JOIN m USING (video_id))
SELECT video_id, med_h, round(med_step, 9) AS med_step, round(CASE WHEN med_step > 0 THEN greatest(2.0, least(base, med_step / 3.0)) ELSE base END, 9) AS carry_motion_norm_px,
  round(CASE WHEN med_step > 0 THEN greatest(0.30, least(0.80, med_step / med_h * 8.0)) ELSE CAST(0.65 AS DOUBLE) END, 9) AS departure_motion_ratio FROM c""")
def a19(spark, sf):
    from trackspark.operators import calibrate
    return calibrate.motion_thresholds(views.det(spark, sf), "track_no", CFG).select(
        "video_id", "med_h", r9(F.col("med_step")).alias("med_step"), r9(F.col("carry_motion_norm_px")).alias("carry_motion_norm_px"),
        r9(F.col("departure_motion_ratio")).alias("departure_motion_ratio"))


@query("a20_pair_means", oracle=ON_CAND + """SELECT video_id, person_id, object_id, count(*) AS ticks, round(avg(o_conf), 9) AS mean_confidence, max(o_conf) AS max_confidence, round(avg(score), 9) AS mean_association,
  count(*) FILTER (WHERE o_source <> 'yolo') AS fallback_ticks FROM cand GROUP BY 1, 2, 3""")
def a20(spark, sf):
    return assoc.candidates(views.pairs(spark, sf), CFG).groupBy("video_id", "person_id", "object_id").agg(
        F.count(F.lit(1)).alias("ticks"), r9(F.avg("o_conf")).alias("mean_confidence"), F.max("o_conf").alias("max_confidence"),
        r9(F.avg("score")).alias("mean_association"), F.count_if(F.col("o_source") != "yolo").alias("fallback_ticks"))


MISSING_SQL = "concat_ws(',', CASE WHEN frame % 9 = 0 OR object_id = 2 THEN 'motion' END, CASE WHEN lw_x IS NULL AND rw_x IS NULL THEN 'wrist' END)"


@query("a21_cue_availability", oracle=views.with_views(views.DET_SQL, views.POSE_SQL, views.PAIRS_SQL) + f""", m AS (SELECT video_id, {MISSING_SQL} AS missing FROM pairs),
  g AS (SELECT coalesce(CAST(video_id AS VARCHAR), 'ALL') AS scope, missing, count(*) AS n FROM m GROUP BY GROUPING SETS ((video_id, missing), (missing)))
SELECT scope, missing, n, round(n / sum(n) OVER (PARTITION BY scope), 9) AS share FROM g""")
def a21(spark, sf):
    missing = pose.missing_cues(wrist=pose.wrist_distance(OB, LW, RW), motion=P_STEP + O_STEP)
    rows = views.pairs(spark, sf).select("video_id", missing.alias("missing"))
    sets = rows.groupingSets([[F.col("video_id"), F.col("missing")], [F.col("missing")]], F.col("video_id"), F.col("missing")).agg(
        F.coalesce(F.col("video_id").cast("string"), F.lit("ALL")).alias("scope"), F.count(F.lit(1)).alias("n"))
    total = sets.groupBy("scope").agg(F.sum("n").alias("total"))
    return sets.join(total, "scope").select("scope", "missing", "n", r9(F.col("n") / F.col("total")).alias("share"))


RACE_SQL = f"""rc AS (SELECT video_id, frame, object_id, person_id, round(score, 9) AS legacy, round({POSE_SQL}, 9) AS pose, round(0.5 * round(score, 9) + 0.5 * round({POSE_SQL}, 9), 9) AS blended FROM cand),
  rr AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame, object_id ORDER BY legacy DESC, person_id) AS r, row_number() OVER (PARTITION BY video_id, frame, object_id ORDER BY blended DESC, person_id) AS rb FROM rc),
  race AS (SELECT video_id, frame, object_id, max(CASE WHEN r = 1 THEN person_id END) AS winner, max(CASE WHEN rb = 1 THEN person_id END) AS blended_winner,
    max(CASE WHEN r = 1 THEN pose END) - max(CASE WHEN r = 2 THEN pose END) AS gap, max(CASE WHEN rb = 1 THEN blended END) - max(CASE WHEN rb = 2 THEN blended END) AS margin
    FROM rr GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""


def race_candidates(spark, sf):
    cands = assoc.candidates(views.pairs(spark, sf), CFG)
    posed = pose.pose_score(PB, OB, LW, RW, pose.shoulder_line(LS, RS, TORSO), P_STEP, O_STEP, CFG)
    rows = cands.withColumn("legacy", r9(F.col("score"))).withColumn("pose", r9(posed))
    return rows.withColumn("blended", r9(0.5 * F.col("legacy") + 0.5 * F.col("pose")))


@query("j20_association_races", oracle=ON_CAND + f", {RACE_SQL} SELECT video_id, frame, object_id, winner, blended_winner, round(gap, 6) AS gap, round(margin, 6) AS margin FROM race")
def j20(spark, sf):
    return audit.races(race_candidates(spark, sf)).select("video_id", "frame", "object_id", "winner", "blended_winner", F.round("gap", 6).alias("gap"), F.round("margin", 6).alias("margin"))


@query("a22_race_quality", oracle=ON_CAND + f""", {RACE_SQL}, z AS (SELECT video_id, round(avg({POSE_ZONE}), 9) AS zone_fire FROM cand GROUP BY 1)
SELECT video_id, count(*) AS n, count(*) FILTER (WHERE gap > 0) AS agrees, round(avg(gap), 6) AS mean_gap, round(avg(margin), 6) AS mean_margin, round(median(margin), 6) AS median_margin,
  round(min(margin), 6) AS min_margin, round(max(margin), 6) AS max_margin, count(*) FILTER (WHERE winner <> blended_winner) AS flips, any_value(zone_fire) AS zone_fire FROM race JOIN z USING (video_id) GROUP BY video_id""")
def a22(spark, sf):
    cands = race_candidates(spark, sf)
    r = audit.races(cands)
    top = pose.shoulder_line(LS, RS, TORSO)
    h, w, c = geom.height(PB), geom.width(PB), geom.centroid(OB)
    fired = c.y.between(F.coalesce(top, PB.y1 + h * 0.45), PB.y2) & c.x.between(PB.x1 - w * 0.3, PB.x2 + w * 0.3)
    zone = cands.groupBy("video_id").agg(r9(F.avg(fired.cast("double"))).alias("zone_fire"))
    base = r.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > 0).alias("agrees"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.avg("margin"), 6).alias("mean_margin"),
        F.round(F.min("margin"), 6).alias("min_margin"), F.round(F.max("margin"), 6).alias("max_margin"), F.count_if(F.col("winner") != F.col("blended_winner")).alias("flips"))
    med = quantiles.quantiles(r, ["video_id"], "margin", {"median_margin": 0.5}, width=0.01).drop("n")
    return base.join(med.withColumn("median_margin", F.round("median_margin", 6)), "video_id").join(zone, "video_id")


@query("a23_drift_survivors", oracle=views.ON_TICK + """, s AS (SELECT video_id, list_sort(list(value)) AS xs, count(*) AS n FROM tick GROUP BY 1)
SELECT video_id, n, xs[n // 2 + 1] AS p50, xs[CAST(floor(n * 0.75) AS BIGINT) + 1] AS p75, xs[CAST(floor(n * 0.9) AS BIGINT) + 1] AS p90, xs[n] AS max_value, cap, len(list_filter(xs, lambda x: x <= cap)) AS survivors
FROM s, (VALUES (10), (20), (40)) c(cap)""")
def a23(spark, sf):
    rows = views.tick(spark, sf).select("video_id", "value")
    stats = quantiles.order_statistics(rows, ["video_id"], "value", {
        "p50": quantiles.upper_median, "p75": quantiles.index_quantile(0.75), "p90": quantiles.index_quantile(0.9), "max_value": lambda n: n - 1}, width=5.0)
    caps = (10, 20, 40)
    kept = rows.groupBy("video_id").agg(*(F.count_if(F.col("value") <= c).alias(f"c{c}") for c in caps))
    per_cap = F.array(*(F.struct(F.lit(c).alias("cap"), F.col(f"c{c}").alias("survivors")) for c in caps))
    return stats.join(kept, "video_id").select("video_id", "n", "p50", "p75", "p90", "max_value", F.inline(per_cap))


@query("a26_run_fingerprint", oracle=views.ON_EVT + """, h AS (SELECT id % 3 AS run, sha256(concat_ws('|', actor_uid, object_uid, status, object_type)) AS h FROM evt),
  w AS (SELECT run, count(*) AS n, """ + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::BIGINT AS w{i}" for i in range(8)) + """ FROM h GROUP BY run)
SELECT run, sha256(concat_ws(':', n, w0, w1, w2, w3, w4, w5, w6, w7)) AS sha, n AS n_decisions FROM w""")
def a26(spark, sf):
    e = views.evt(spark, sf).withColumn("run", F.col("id") % 3)
    return audit.fingerprint(e, "run", F.concat_ws("|", "actor_uid", "object_uid", "status", "object_type"))


@query("f13_possible_false", oracle=views.with_views(views.DET_SQL, """t AS (SELECT video_id, track_no, any_value(source) AS source, class_name, (max(frame) - min(frame) + 1) / 30.0 AS sec, avg((y1 + y2) / 2.0) AS mean_cy
    FROM det WHERE NOT is_person GROUP BY video_id, track_no, source, class_name)""") + """, r AS (SELECT *, concat_ws('|', CASE WHEN class_name = 'detected_object' THEN 'NOVELTY_CLASS_UNKNOWN_OBJECT' END, CASE WHEN sec < 1.0 THEN 'SHORT_TRACK_LT_1S' END,
  CASE WHEN mean_cy > 100 * 0.92 THEN 'BOTTOM_STRIP_POSSIBLE_SHADOW_OR_BIN_EDGE' END, CASE WHEN source = 'color' AND sec < 1.5 THEN 'HSV_SHORT_FRAGMENT' END) AS reasons FROM t)
SELECT video_id, track_no, source, class_name, reasons FROM r WHERE reasons <> ''""")
def f13(spark, sf):
    t = audit.track_table(views.det(spark, sf).where(~F.col("is_person")).withColumn("src", F.col("source")), ["video_id", "track_no", "src", "class_name"])
    return audit.possible_false(t, 30.0, 100.0).select("video_id", "track_no", "source", "class_name", F.array_join("reasons", "|").alias("reasons"))


@query("j16_vanished_near_person", oracle=views.ON_TRK + """SELECT o.video_id, o.track_id AS object_id, arg_min(p.track_id, (p.first_frame, p.track_id)) AS person_id FROM trk o JOIN trk p ON p.is_person AND NOT o.is_person AND p.video_id = o.video_id
  AND p.first_frame <= o.last_frame AND p.last_frame >= o.first_frame AND o.last_frame < p.last_frame AND p.last_frame - o.last_frame <= 60 GROUP BY 1, 2""")
def j16(spark, sf):
    return audit.vanished_near_person(views.trk(spark, sf))


@query("j16_appeared_after_person", oracle=views.ON_TRK + """SELECT o.video_id, o.track_id AS object_id, count(*) AS n_persons, arg_max(p.track_id, (p.last_frame, p.track_id)) AS last_person_id FROM trk o JOIN trk p ON p.is_person AND NOT o.is_person AND p.video_id = o.video_id
  AND o.first_frame > p.last_frame AND o.first_frame - p.last_frame <= 30 GROUP BY 1, 2""")
def j16b(spark, sf):
    return audit.appeared_after_person(views.trk(spark, sf))


@query("j19_run_difference", oracle=views.ON_EVT + """, k AS (SELECT actor_uid * 100 + analysis_job_id AS run_key, object_type, confidence FROM evt),
  a AS (SELECT run_key, round(avg(confidence), 9) AS v FROM k WHERE object_type <> 'click' GROUP BY 1), b AS (SELECT run_key, round(avg(confidence), 9) AS v FROM k WHERE object_type <> 'view' GROUP BY 1)
SELECT run_key, a.v AS expected, b.v AS actual, CASE WHEN b.v IS NULL THEN 'MISSING' WHEN a.v IS NULL THEN 'EXTRA' WHEN abs(a.v - b.v) < 0.01251 THEN 'MATCH' ELSE 'DIFF' END AS verdict FROM a FULL OUTER JOIN b USING (run_key)""")
def j19(spark, sf):
    """Two runs over the same keys, each blind to one kind of event."""
    e = views.evt(spark, sf).withColumn("run_key", F.col("actor_uid") * 100 + F.col("analysis_job_id"))

    def run(blind: str):
        return e.where(F.col("object_type") != blind).groupBy("run_key").agg(r9(F.avg("confidence")).alias("value"))

    return audit.run_difference(run("click"), run("view"), "run_key", 0.01251)
