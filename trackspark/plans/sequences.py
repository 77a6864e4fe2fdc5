"""Registered queries over ordered ticks: windows W1-W17, sampling F4-F7, sessions T14."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.config import Thresholds
from trackspark.functions import labels
from trackspark.functions.geom import Point
from trackspark.operators import detect, features, folds, longseq
from trackspark.plans import views
from trackspark.plans.registry import query
from trackspark.plans.scalars import r9

CFG = Thresholds()
V = ["video_id"]
KEY = ["video_id", "frame"]
AT = Point(F.col("cx"), F.col("cy"))
W = "WINDOW w AS (PARTITION BY video_id ORDER BY frame)"
MOVED = "sqrt((cx - coalesce(lag(cx, 2) OVER w, lag(cx, 1) OVER w)) ** 2 + (cy - coalesce(lag(cy, 2) OVER w, lag(cy, 1) OVER w)) ** 2)"
SIZE_SQL = "(30 + event_id % 100)"
STILL_SQL = f"coalesce({MOVED} / greatest(1.0, {SIZE_SQL}) < 0.15, false)"
STEP_SQL = "sqrt((cx - lag(cx) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2)"


def sized(spark, sf):
    return views.tick(spark, sf).withColumn("size", (30 + F.col("event_id") % 100).cast("double"))


@query("w01_stationarity", oracle=views.ON_TICK + f"SELECT video_id, frame, {STILL_SQL} AS still, coalesce({MOVED} / greatest(1.0, {SIZE_SQL}) < 0.15 AND {MOVED} <= 6.0, false) AS still_capped FROM tick {W}")
def w01(spark, sf):
    capped = CFG.with_overrides(stationary_max_pixel_step=6.0)
    return longseq.bounded(sized(spark, sf), V, "frame", lambda w: {
        "still": features.stationary(AT, w, F.col("size"), CFG), "still_capped": features.stationary(AT, w, F.col("size"), capped)},
        before=2).select(*KEY, "still", "still_capped")


@query("w02_mean_step", oracle=views.with_views(views.TICK_SQL, f"s AS (SELECT *, {STEP_SQL} AS step FROM tick {W})")
       + f"SELECT video_id, frame, round(avg(step) OVER (w ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 9) AS mean_step FROM s {W}")
def w02(spark, sf):
    return longseq.bounded(views.tick(spark, sf), V, "frame", lambda w: {
        "step": features.step(AT, w), "mean_step": r9(features.mean_step("step", w, 3))}, before=3).select(*KEY, "mean_step")


@query("w03_vote_smoothing", oracle=views.ON_TICK + f"SELECT video_id, frame, sum(flag::INT) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) >= 3 AS smooth FROM tick {W}")
def w03(spark, sf):
    return longseq.bounded(views.tick(spark, sf), V, "frame", lambda w: {"smooth": features.voted(F.col("flag"), w, 5)},
                           before=4).select(*KEY, "smooth")


@query("w04_longest_runs", oracle=views.with_views(views.TICK_SQL, """t AS (SELECT *, event_id % 3 <> 0 AS ok FROM tick),
  g AS (SELECT video_id, frame, ok, frame - row_number() OVER (PARTITION BY video_id, ok ORDER BY frame) AS run_id FROM t),
  runs AS (SELECT video_id, count(*) AS n FROM g WHERE ok GROUP BY video_id, run_id),
  p AS (SELECT video_id, frame, lag(frame) OVER (PARTITION BY video_id ORDER BY frame) AS prev FROM t WHERE ok),
  q AS (SELECT video_id, sum(CASE WHEN prev IS NULL OR frame - prev > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY frame) AS isl FROM p),
  tol AS (SELECT video_id, count(*) AS n FROM q GROUP BY video_id, isl)""") + """
SELECT video_id, coalesce((SELECT max(n) FROM runs r WHERE r.video_id = v.video_id), 0) AS longest_run,
  coalesce((SELECT max(n) FROM tol r WHERE r.video_id = v.video_id), 0) AS longest_tolerant FROM (SELECT DISTINCT video_id FROM tick) v""")
def w04(spark, sf):
    return features.longest_runs(views.tick(spark, sf), V, "frame", F.col("event_id") % 3 != 0, tolerance=2)


@query("w05_ever_and_running_max", oracle=views.with_views(views.TICK_SQL, f"t AS (SELECT *, bool_or(flag) OVER w AS ever FROM tick {W})") + f"""
SELECT video_id, frame, ever, max(value) OVER w AS max_ever, max(CASE WHEN ever THEN value END) OVER w AS max_since FROM t {W}""")
def w05(spark, sf):
    out = features.ever_and_since(views.tick(spark, sf), V, "frame", F.col("flag"), F.col("value"))
    return out.select(*KEY, "ever", "max_ever", "max_since")


@query("w06_growth", oracle=views.ON_TICK + f"""SELECT video_id, frame, count(value) OVER b >= 3 AND value > first_value(value) OVER b AS grew_over_window,
  coalesce(value > lag(value) OVER w, false) AS increasing FROM tick {W}, b AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def w06(spark, sf):
    return longseq.bounded(views.tick(spark, sf), V, "frame", lambda w: features.grew("value", w, 4), before=3).select(
        *KEY, "grew_over_window", "increasing")


OSTEP_SQL = "sqrt((value / 10 - lag(value / 10) OVER w) ** 2 + (cy - lag(cy) OVER w) ** 2)"


@query("w07_motion_synchrony", oracle=views.with_views(views.TICK_SQL, f"s AS (SELECT *, {STEP_SQL} AS ps, {OSTEP_SQL} AS os, {STILL_SQL} AS still FROM tick {W})",
       f"m AS (SELECT *, avg(ps) OVER b AS p, avg(os) OVER b AS o FROM s WINDOW b AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))") + """
SELECT video_id, frame, coalesce(p > 8.0, false) AS person_moving, CASE WHEN coalesce(p > 8.0, false) THEN NOT still AND coalesce(o >= 0.4 * p, false) ELSE NOT (still AND NOT flag) END AS together FROM m""")
def w07(spark, sf):
    other = Point(F.col("value") / 10, F.col("cy"))
    return longseq.bounded(sized(spark, sf), V, "frame", lambda w: {
        "ps": features.step(AT, w), "os": features.step(other, w), "still": features.stationary(AT, w, F.col("size"), CFG),
        "p": features.mean_step("ps", w, 3), "o": features.mean_step("os", w, 3),
        "person_moving": F.coalesce(F.col("p") > CFG.carry_motion_norm_px, F.lit(False)),
        "together": features.moves_together(F.col("p"), F.col("o"), F.col("still"), F.col("flag"), CFG)},
        before=4).select(*KEY, "person_moving", "together")


@query("w08_release_threshold", oracle=views.ON_TICK + f"""SELECT video_id, frame, round(least(0.35, greatest(0.15, 1.6 * max(CASE WHEN event_id % 2 = 0 THEN value / 1000 END) OVER w)), 9) AS threshold
  FROM tick {W}""")
def w08(spark, sf):
    out = longseq.running(views.tick(spark, sf), V, "frame", {"m": ("max", F.when(F.col("event_id") % 2 == 0, F.col("value") / 1000))})
    return out.select(*KEY, F.when(F.col("m").isNull(), F.lit(CFG.release_distance_floor)).otherwise(r9(features.release_threshold(F.col("m"), CFG))).alias("threshold"))


STATE_SQL = "CAST(floor(value / 60) AS BIGINT)"


@query("w11_state_changes", oracle=views.with_views(views.TICK_SQL, f"t AS (SELECT video_id, frame, {STATE_SQL} AS state, lag({STATE_SQL}) OVER w AS previous FROM tick {W})")
       + "SELECT video_id, frame, state FROM t WHERE previous IS NULL OR previous <> state")
def w11(spark, sf):
    t = views.tick(spark, sf).withColumn("state", F.floor(F.col("value") / 60))
    return features.changes(t, V, "frame", "state").select(*KEY, "state")


@query("w12_trail", oracle=views.ON_TICK + f"""SELECT video_id, frame, array_to_string(list(event_id) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), ',') AS trail FROM tick {W}""")
def w12(spark, sf):
    return longseq.bounded(views.tick(spark, sf), V, "frame", lambda w: {
        "trail": F.array_join(F.collect_list(F.col("event_id").cast("string")).over(features.back(10, w)), ",")}, before=9).select(*KEY, "trail")


@query("w13_smoothed_box", oracle=views.ON_TICK + f"""SELECT video_id, frame, round(avg(cx) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 9) AS sx, round(avg(cy) OVER (w ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 9) AS sy,
  round(avg(value / 500) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) * CASE WHEN event_id % 7 > 0 THEN greatest(0.35, 1.0 - 0.08 * (event_id % 7)) ELSE 1.0 END, 9) AS conf FROM tick {W}""")
def w13(spark, sf):
    gap = F.col("event_id") % 7
    return longseq.bounded(views.tick(spark, sf), V, "frame", lambda w: {
        "sx": r9(F.avg("cx").over(features.back(8, w))), "sy": r9(F.avg("cy").over(features.back(8, w))),
        "conf": r9(F.avg(F.col("value") / 500).over(features.back(5, w)) * F.when(gap > 0, F.greatest(F.lit(0.35), 1.0 - 0.08 * gap)).otherwise(1.0))},
        before=7).select(*KEY, "sx", "sy", "conf")


@query("w14_baseline_change", oracle=views.with_views(views.TICK_SQL, "f AS (SELECT video_id, median(value) AS frozen FROM tick WHERE frame <= 9 GROUP BY video_id)",
       f"r AS (SELECT *, median(value) OVER (w ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS rolling FROM tick {W})") + """
SELECT video_id, frame, frozen, rolling, abs(value - frozen) > 25 AS off_frozen, abs(value - rolling) > 25 AS off_rolling FROM r JOIN f USING (video_id)""")
def w14(spark, sf):
    out = features.baseline_change(views.tick(spark, sf), V, "frame", "value", 9, 25.0)
    return out.select(*KEY, "frozen", "rolling", "off_frozen", "off_rolling")


@query("w15_coasting", oracle=views.with_views(views.TICK_SQL, f"""t AS (SELECT *, last_value(CASE WHEN flag THEN value END IGNORE NULLS) OVER w AS lv, max(CASE WHEN flag THEN frame END) OVER w AS la FROM tick {W})""") + """
SELECT video_id, frame, CASE WHEN frame - la <= 3 THEN lv END AS coasted, coalesce(frame - la BETWEEN 1 AND 3, false) AS fallback,
  CAST(CASE WHEN frame = la THEN 1.0 WHEN frame - la <= 3 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS coast_conf FROM t""")
def w15(spark, sf):
    out = features.carried_value(views.tick(spark, sf), V, "frame", F.when(F.col("flag"), F.col("value")), 3)
    return out.select(*KEY, "coasted", "fallback", "coast_conf")


STAGE_SQL = """stages AS (SELECT l_orderkey AS job_id, l_linenumber AS stage_order, l_partkey AS part_id,
  CASE WHEN l_suppkey % 9 = 0 THEN 'FAILED' WHEN l_returnflag = 'N' THEN 'PENDING' WHEN l_returnflag = 'R' THEN 'RUNNING' ELSE 'COMPLETED' END AS status FROM lineitem)"""


@query("w16_stage_cascade", oracle=views.with_views(STAGE_SQL) + """SELECT job_id, stage_order, part_id, CASE WHEN stage_order > min(CASE WHEN status = 'FAILED' THEN stage_order END) OVER (PARTITION BY job_id)
  AND status IN ('PENDING', 'RUNNING') THEN 'SKIPPED' ELSE status END AS final_status FROM stages""")
def w16(spark, sf):
    li = views.table(spark, sf, "lineitem")
    status = F.when(F.col("l_suppkey") % 9 == 0, "FAILED").when(F.col("l_returnflag") == "N", "PENDING").when(
        F.col("l_returnflag") == "R", "RUNNING").otherwise("COMPLETED")
    stages = li.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("stage_order"), F.col("l_partkey").alias("part_id"), status.alias("status"))
    return features.skip_after_failure(stages).select("job_id", "stage_order", "part_id", "final_status")


@query("w17_raw_id_switches", oracle=views.with_views(views.TICK_SQL, f"t AS (SELECT video_id, frame, event_id % 3 AS raw, lag(event_id % 3) OVER w AS previous FROM tick {W})")
       + "SELECT video_id, count(*) FILTER (WHERE previous IS NOT NULL AND previous <> raw) AS switches FROM t GROUP BY video_id")
def w17(spark, sf):
    t = views.tick(spark, sf).withColumn("raw", F.col("event_id") % 3)
    switched = features.changes(t, V, "frame", "raw")
    return switched.groupBy("video_id").agg(F.count_if(F.col("previous").isNotNull()).alias("switches"))


@query("f04_confirmed_tracks", oracle=views.with_views(views.DET_SQL, "t AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_no, is_person ORDER BY frame, det_id) AS hits FROM det)")
       + "SELECT video_id, frame, det_id FROM t WHERE hits >= 3")
def f04(spark, sf):
    seen = longseq.with_ordinal(views.det(spark, sf), ["video_id", "track_no", "is_person"], ["frame", "det_id"], F.floor(F.col("frame") / 4096), "hits")
    return detect.confirmed_observations(seen, "hits").select("video_id", "frame", "det_id")


@query("f05_active_tracks", oracle=views.with_views(views.DET_SQL, "s AS (SELECT video_id, track_no, max(frame) AS last_frame FROM det GROUP BY 1, 2)", "n AS (SELECT video_id, max(last_frame) AS newest FROM s GROUP BY 1)")
       + "SELECT video_id, track_no, last_frame, last_frame >= newest - 5 AS active, last_frame < newest - 60 AS stale FROM s JOIN n USING (video_id)")
def f05(spark, sf):
    return detect.last_seen(views.det(spark, sf), ["video_id", "track_no"], 5, 60)


@query("f06_stride_sampling", oracle=views.ON_DET + "SELECT video_id, frame, count(*) AS boxes FROM det WHERE frame % 8 = 0 GROUP BY 1, 2")
def f06(spark, sf):
    """Stride from native and sample rates; the filter sits on the scan's own columns."""
    stride = max(1, round(60 / 8))
    return views.det(spark, sf).where(F.pmod("frame", F.lit(stride)) == 0).groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("boxes"))


def timed(spark, sf):
    return views.table(spark, sf, "events").select(F.col("user_id").alias("video_id"), (views.micros() / 1e6).alias("sec"), "event_id")


SEC_SQL = "s AS (SELECT user_id AS video_id, epoch_us(ts) / 1e6 AS sec, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"


@query("f07_min_interval_throttle", oracle=views.with_views(SEC_SQL, """k AS (SELECT video_id, r, sec, event_id, sec AS last_kept, true AS kept FROM s WHERE r = 1
  UNION ALL SELECT s.video_id, s.r, s.sec, s.event_id, CASE WHEN s.sec >= k.last_kept + 14400 THEN s.sec ELSE k.last_kept END, s.sec >= k.last_kept + 14400
  FROM k JOIN s ON s.video_id = k.video_id AND s.r = k.r + 1)""", recursive=True) + "SELECT video_id, event_id FROM k WHERE kept")
def f07(spark, sf):
    """Keep a tick at least four hours after the last kept one (the data is hours apart)."""
    kept = folds.greedy_spacing(timed(spark, sf), ["video_id"], "sec", "event_id", 14400.0, 7 * 86400.0)
    return kept.where("kept").select("video_id", "event_id")


@query("t14_sessions", oracle=views.with_views(SEC_SQL, """g AS (SELECT *, coalesce(sec - lag(sec) OVER (PARTITION BY video_id ORDER BY r) >= 36000, true) AS quiet FROM s),
  k AS (SELECT video_id, r, sec, event_id, sec AS started, true AS fresh FROM g WHERE r = 1
  UNION ALL SELECT g.video_id, g.r, g.sec, g.event_id, CASE WHEN g.quiet OR g.sec >= k.started + 86400 THEN g.sec ELSE k.started END, g.quiet OR g.sec >= k.started + 86400
  FROM k JOIN g ON g.video_id = k.video_id AND g.r = k.r + 1)""", recursive=True) + "SELECT video_id, event_id, started AS session_start FROM k")
def t14(spark, sf):
    """Sessions split by ten quiet hours or one day of length, in the spacing of this data."""
    from trackspark.operators import sessions
    return sessions.split(timed(spark, sf), ["video_id"], "sec", "event_id", quiet=36000.0, longest=86400.0, bucket=7 * 86400.0).select("video_id", "event_id", "session_start")


@query("p17_track_census", oracle=views.ON_DET + """SELECT video_id, count(DISTINCT CASE WHEN is_person THEN track_no END) AS person_tracks,
  count(DISTINCT CASE WHEN NOT is_person THEN track_no END) AS object_tracks FROM det GROUP BY video_id""")
def census(spark, sf):
    ns = labels.namespaced(F.col("track_no"), F.col("is_person"))
    ids = views.det(spark, sf).select("video_id", ns.alias("gid")).distinct()
    return ids.groupBy("video_id").agg(F.count_if(~labels.is_object_id(F.col("gid"))).alias("person_tracks"), F.count_if(labels.is_object_id(F.col("gid"))).alias("object_tracks"))
