"""Registered queries of the pair state machine, its tiers, and identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackspark.config import STATES, Thresholds
from trackspark.functions import geom, labels
from trackspark.operators import detect, identity, incidents, pairfeatures, pairfsm, status, tiers
from trackspark.plans import scenes, views
from trackspark.plans.registry import query
from trackspark.session import written


def scene_sql(n: int) -> str:
    return f"WITH scn AS (SELECT c_custkey AS video_id, CAST(c_custkey % {n} AS INTEGER) AS scene FROM customer)\n"


def verdicts(spark: SparkSession, sf: str, family: Sequence) -> DataFrame:
    """Per video: confirmed and rejected events, the confirmed actors, whether anything was released, the rejection."""
    boxes, ticks, cast = scenes.play(spark, sf, family)
    events = pairfsm.pair_events(scenes.machine_rows(boxes, ticks, cast, ordered=True), scenes.CONFIGS, ordered=True)
    ok = F.col("confirmed")
    per = events.groupBy("video_id").agg(
        F.count_if(ok).alias("confirmed"), F.count_if(~ok).alias("rejected"), F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("person_track").cast("string")))), ",").alias("actors"),
        F.bool_or(F.col("release_frame").isNotNull()).alias("released"), F.max(F.when(~ok, F.col("reason"))).alias("reason"), F.bool_or("fallback_used").alias("fallback_used"),
        F.bool_or("walkaway").alias("walkaway"))
    out = cast.select("video_id", "scene").join(per, "video_id", "left")
    return out.na.fill(0, ["confirmed", "rejected"]).na.fill("", ["actors"]).na.fill(False, ["released", "fallback_used", "walkaway"])


@query("t06_scripted_scenes", oracle=scene_sql(7) + """SELECT video_id, scene, CAST(CASE WHEN scene IN (0, 1, 5) THEN 1 ELSE 0 END AS BIGINT) AS confirmed, CAST(CASE WHEN scene IN (2, 4, 6) THEN 1 ELSE 0 END AS BIGINT) AS rejected,
  CASE scene WHEN 2 THEN 'NO_RELEASE_TRANSITION' WHEN 4 THEN 'BIN_ZONE_DEPOSIT' WHEN 6 THEN 'PICKED_BACK_UP' END AS reason, scene = 5 AS fallback_used FROM scn""")
def t06(spark, sf):
    return verdicts(spark, sf, scenes.CORE).select("video_id", "scene", "confirmed", "rejected", "reason", "fallback_used")


@query("t07_release_patterns", oracle=scene_sql(4) + "SELECT video_id, scene, CAST(CASE WHEN scene < 3 THEN 1 ELSE 0 END AS BIGINT) AS confirmed FROM scn")
def t07(spark, sf):
    return verdicts(spark, sf, scenes.RELEASES).select("video_id", "scene", "confirmed")


@query("t08_wrist_gate", oracle=scene_sql(4) + "SELECT video_id, scene, scene < 3 AS released FROM scn")
def t08(spark, sf):
    return verdicts(spark, sf, scenes.HANDS).select("video_id", "scene", "released")


@query("t09_continuity", oracle=scene_sql(4) + "SELECT video_id, scene, CAST(CASE WHEN scene < 2 THEN 1 ELSE 0 END AS BIGINT) AS confirmed FROM scn")
def t09(spark, sf):
    return verdicts(spark, sf, scenes.CONTINUITY).select("video_id", "scene", "confirmed")


@query("t10_idle_and_end_of_stream", oracle=scene_sql(3) + "SELECT video_id, scene, CAST(CASE WHEN scene < 2 THEN 1 ELSE 0 END AS BIGINT) AS confirmed, scene = 1 AS walkaway FROM scn")
def t10(spark, sf):
    return verdicts(spark, sf, scenes.ENDINGS).select("video_id", "scene", "confirmed", "walkaway")


@query("t11_end_of_stream", oracle=scene_sql(3) + "SELECT video_id, scene, scene = 1 AS walkaway, CASE WHEN scene = 2 THEN 'NO_RELEASE_TRANSITION' END AS reason FROM scn")
def t11(spark, sf):
    """What the last word on a pair is when the stream stops."""
    return verdicts(spark, sf, scenes.ENDINGS).select("video_id", "scene", "walkaway", "reason")


@query("x01_pair_events", oracle=scene_sql(7) + """SELECT video_id, scene IN (0, 1, 5) AS confirmed, CASE scene WHEN 2 THEN 'BAG_CARRIED' WHEN 4 THEN 'PERSON_DEPARTED' WHEN 6 THEN 'PICKED_BACK_UP' ELSE 'VIOLATION_CONFIRMED' END AS state,
  scene NOT IN (2, 6) AS released, CAST(1 AS BIGINT) AS person_track FROM scn WHERE scene <> 3""")
def x01(spark, sf):
    """The event rows of the pair machine."""
    boxes, ticks, cast = scenes.play(spark, sf, scenes.CORE)
    events = pairfsm.pair_events(scenes.machine_rows(boxes, ticks, cast, ordered=True), scenes.CONFIGS, ordered=True)
    return events.select("video_id", "confirmed", "state", F.col("release_frame").isNotNull().alias("released"), "person_track")


@query("t06_actors_in_a_crowd", oracle=scene_sql(5) + "SELECT video_id, scene, CAST(CASE WHEN scene = 0 THEN 2 ELSE 1 END AS BIGINT) AS confirmed, CASE scene WHEN 0 THEN '1,2' WHEN 3 THEN '2' ELSE '1' END AS actors FROM scn")
def t06_crowd(spark, sf):
    return verdicts(spark, sf, scenes.CROWD).select("video_id", "scene", "confirmed", "actors")


@query("t01_person_uids", oracle=scene_sql(6) + "SELECT video_id, scene, CAST(CASE scene WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS BIGINT) AS uids FROM scn")
def t01(spark, sf):
    return uid_counts(spark, sf, True)


@query("t02_object_uids", oracle=scene_sql(6) + "SELECT video_id, scene, CAST(CASE scene WHEN 3 THEN 2 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS BIGINT) AS uids FROM scn")
def t02(spark, sf):
    return uid_counts(spark, sf, False)


def uid_counts(spark, sf, persons: bool):
    boxes, _, cast = scenes.play(spark, sf, scenes.IDENTITY)
    uids = identity.stable_uids(boxes.where(F.col("is_person") == persons), ["video_id", "session"]).groupBy("video_id").agg(F.countDistinct("uid").alias("uids"))
    return cast.select("video_id", "scene").join(uids, "video_id", "left").na.fill(0, ["uids"])


def det_tracks(spark, sf):
    """The detection view as tracked boxes of one session per video."""
    return views.with_pose_columns(views.det(spark, sf)).withColumn("session", F.lit(0).cast("bigint")).withColumn(
        "track_id", labels.namespaced(F.col("track_no"), F.col("is_person"))).drop("track_no")


@query("t01_uids_on_detections", oracle=views.ON_DET + "SELECT video_id, is_person, count(*) AS boxes FROM det GROUP BY 1, 2")
def t01_det(spark, sf):
    """Every detection gets exactly one uid; counted back per video (uid values are not compared)."""
    uids = identity.stable_uids(det_tracks(spark, sf), ["video_id", "session"])
    return uids.groupBy("video_id", "is_person").agg(F.count("uid").alias("boxes"))


def regions(spark, sf, source: str, gated: bool = True):
    """Boxes of a source with the nearest person, `gated` also with whether any person is `close`, and each video's last frame.

    The numbered boxes are read four or five times, so they are made once.
    """
    det = written(views.det(spark, sf), "det")
    persons = det.where("is_person")
    boxes = det.where(~F.col("is_person") & (F.col("source") == source))
    nearest = detect.nearest_person(boxes, persons, 150.0).select("video_id", "frame", "det_id", "inside", "person_id")
    started = boxes.join(nearest, ["video_id", "frame", "det_id"])
    last = det.groupBy("video_id").agg(F.max("frame").alias("last_frame"))
    if not gated:
        return started, last
    gate = detect.near_any_person(boxes, persons).select("video_id", "frame", "det_id", F.lit(True).alias("close"))
    return started.join(gate, ["video_id", "frame", "det_id"], "left").withColumn("close", F.coalesce("close", F.lit(False))), last


def linked_sql(source: str, may_start: str, reach: float, age: int) -> list[str]:
    """T3/T4 in SQL: the frames of a video one after the other, and inside a frame its tracks in order of birth, each taking the nearest free region."""
    centre = "(d.x1 + d.x2) / 2.0 AS cx, (d.y1 + d.y2) / 2.0 AS cy"
    far = "sqrt(((d.x1 + d.x2) / 2.0 - (k.x1 + k.x2) / 2.0) * ((d.x1 + d.x2) / 2.0 - (k.x1 + k.x2) / 2.0) + ((d.y1 + d.y2) / 2.0 - (k.y1 + k.y2) / 2.0) * ((d.y1 + d.y2) / 2.0 - (k.y1 + k.y2) / 2.0))"
    within = "(d.x1 + d.x2) / 2.0 BETWEEN k.x1 AND k.x2 AND (d.y1 + d.y2) / 2.0 BETWEEN k.y1 AND k.y2"
    pad = "0.75 * greatest(1.0, k.y2 - k.y1)"
    close = f"(d.x1 + d.x2) / 2.0 BETWEEN k.x1 - {pad} AND k.x2 + {pad} AND (d.y1 + d.y2) / 2.0 BETWEEN k.y1 - {pad} AND k.y2 + {pad}"
    track, region = "STRUCT(id BIGINT, seen BIGINT, x DOUBLE, y DOUBLE, d BIGINT)", "STRUCT(d BIGINT, x DOUBLE, y DOUBLE, m BOOLEAN)"
    best = f"list_sort(list_filter(list_transform(a.free, lambda r: {{'k': sqrt((r.x - e.t.x) * (r.x - e.t.x) + (r.y - e.t.y) * (r.y - e.t.y)), 'd': r.d, 'x': r.x, 'y': r.y}}), lambda r: r.k < {reach}))"
    taken = "{'free': list_filter(a.free, lambda r: r.d <> b[1].d), 'out': list_append(a.out, {'id': e.t.id, 'seen': e.f, 'x': b[1].x, 'y': b[1].y, 'd': b[1].d}), 't': e.t, 'f': e.f}"
    kept = "{'free': a.free, 'out': list_append(a.out, {'id': e.t.id, 'seen': e.t.seen, 'x': e.t.x, 'y': e.t.y, 'd': CAST(NULL AS BIGINT)}), 't': e.t, 'f': e.f}"
    return [
        f"""reg AS MATERIALIZED (SELECT d.video_id, d.frame, d.det_id, {centre}, d.x1, d.y1, d.x2, d.y2, d.confidence, coalesce(bool_or({within}), false) AS inside, coalesce(bool_or({close}), false) AS close,
        CASE WHEN NOT coalesce(bool_or({within}), false) THEN arg_min(k.det_id, ({far}, k.det_id)) FILTER (WHERE {far} < 150) END AS person_id
        FROM det d LEFT JOIN det k ON k.video_id = d.video_id AND k.frame = d.frame AND k.is_person WHERE NOT d.is_person AND d.source = '{source}' GROUP BY ALL)""",
        f"""fr AS MATERIALIZED (SELECT video_id, frame, list(CAST({{'d': det_id, 'x': cx, 'y': cy, 'm': {may_start}}} AS {region}) ORDER BY det_id) AS regions, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS rn FROM reg GROUP BY video_id, frame)""",
        f"""lk AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS frame, CAST([] AS {track}[]) AS tracks, CAST(1 AS BIGINT) AS nxt FROM fr
        UNION ALL SELECT video_id, rn, frame, list_concat(out, list_transform(born, lambda r, i: CAST({{'id': nxt + i - 1, 'seen': frame, 'x': r.x, 'y': r.y, 'd': r.d}} AS {track}))), nxt + len(born) FROM (
          SELECT video_id, rn, frame, nxt, res.out AS out, list_filter(res.free, lambda r: r.m) AS born FROM (
            SELECT f.video_id, f.rn, f.frame, lk.nxt, list_reduce(list_prepend({{'free': f.regions, 'out': CAST([] AS {track}[]), 't': CAST(NULL AS {track}), 'f': f.frame}},
                list_transform(list_filter(lk.tracks, lambda t: f.frame - t.seen <= {age + 1}), lambda t: {{'free': CAST([] AS {region}[]), 'out': CAST([] AS {track}[]), 't': t, 'f': f.frame}})),
              lambda a, e: list_transform([{best}], lambda b: CASE WHEN len(b) > 0 THEN {taken} ELSE {kept} END)[1]) AS res
            FROM lk JOIN fr f ON f.video_id = lk.video_id AND f.rn = lk.rn + 1) q) q2)""",
        """link AS (SELECT l.video_id, l.frame, l.t.id AS track, reg.*  EXCLUDE (video_id, frame) FROM (SELECT video_id, frame, unnest(tracks) AS t FROM lk) l JOIN reg ON reg.video_id = l.video_id AND reg.frame = l.frame AND reg.det_id = l.t.d AND l.t.seen = l.frame)""",
        """sight AS (SELECT *, row_number() OVER t AS hits, lead(frame) OVER t AS following, avg(x1) OVER (t ROWS 7 PRECEDING) AS sx1, avg(confidence) OVER (t ROWS 4 PRECEDING) AS mean_conf, first_value(person_id IGNORE NULLS) OVER (t ROWS UNBOUNDED PRECEDING) AS first_person
        FROM link WINDOW t AS (PARTITION BY video_id, track ORDER BY frame))""",
        f"""coast AS (SELECT *, unnest(range(frame, greatest(frame, until) + 1)) AS moment FROM (SELECT s.*, least(coalesce(s.following - 1, e.last_frame), s.frame + {age}) AS until FROM sight s JOIN (SELECT video_id, max(frame) AS last_frame FROM det GROUP BY 1) e USING (video_id)))"""]


COLOUR_SQL = views.with_views(views.DET_SQL, *linked_sql("color", "close", identity.COLOUR_REACH, identity.COLOUR_AGE), recursive=True) + """SELECT video_id, moment AS frame, track, hits, moment - frame AS gap, round(sx1, 6) AS sx1, round(sconf, 6) AS sconf
  FROM (SELECT *, mean_conf * CASE WHEN moment > frame THEN greatest(0.35, 1.0 - 0.08 * (moment - frame)) ELSE 1.0 END AS sconf FROM coast) WHERE hits >= 2 AND sconf >= 0.2"""
CHANGE_SQL = views.with_views(views.DET_SQL, *linked_sql("novelty", "NOT inside", identity.REGION_REACH, identity.REGION_AGE), recursive=True) + "SELECT video_id, moment AS frame, track, hits, moment - frame AS gap, first_person AS person_id FROM coast WHERE hits >= " + str(identity.REGION_HITS)


@query("t03_colour_tracks", oracle=COLOUR_SQL)
def t03(spark, sf):
    rows, last = regions(spark, sf, "color")
    out = identity.colour_tracks(rows.withColumn("may_start", F.col("close")), ["video_id"], last)
    return out.select("video_id", "frame", "track", "hits", "gap", F.round("sx1", 6).alias("sx1"), F.round("sconf", 6).alias("sconf"))


@query("t04_change_tracks", oracle=CHANGE_SQL)
def t04(spark, sf):
    rows, last = regions(spark, sf, "novelty", gated=False)
    return identity.change_tracks(rows.withColumn("may_start", ~F.col("inside")), ["video_id"], last).select("video_id", "frame", "track", "hits", "gap", "person_id")


@query("t12_tier_ladder", oracle=scene_sql(7) + "SELECT video_id, scene, CAST(CASE WHEN scene IN (0, 1, 5) THEN 1 ELSE 0 END AS BIGINT) AS accepted FROM scn")
def t12(spark, sf):
    """Three tiers on the same ticks; one incident stays one event and strict refusals hold."""
    boxes, ticks, cast = scenes.play(spark, sf, scenes.CORE)
    configs = tiers.ladder(scenes.FAST)
    events = pairfsm.pair_events(scenes.machine_rows(boxes, ticks, cast, configs, every=True, ordered=True), configs, ordered=True)
    keyed = events.withColumn("event_key", F.concat_ws("/", "config_id", "object_uid"))
    ends = ticks.groupBy("video_id", "session").agg(F.max("ts").alias("end_ts"))
    judged = tiers.arbitrate(tiers.candidates(keyed, ends), ["video_id", "session", "person_uid"], "event_key")
    kept = judged.where("outcome = 'accepted'").groupBy("video_id").agg(F.count(F.lit(1)).alias("accepted"))
    return cast.select("video_id", "scene").join(kept, "video_id", "left").na.fill(0, ["accepted"])


def ladder_events(spark, sf):
    """(scenes, events of all tiers, the last tick of every session) of the ladder's scenes, under production thresholds."""
    boxes, ticks, cast = scenes.play(spark, sf, scenes.LADDER)
    configs = tiers.ladder(Thresholds())
    events = pairfsm.pair_events(scenes.machine_rows(boxes, ticks, cast, configs, every=True, ordered=True), configs, ordered=True)
    keyed = events.withColumn("event", F.concat_ws("/", "config_id", "object_uid"))
    return cast, keyed, ticks.groupBy("video_id", "session").agg(F.max("ts").alias("end_ts"))


def ladder_outcomes(cast, judged):
    """Per video: the tier whose confirmation stands, and how many were duplicates or vetoed."""
    is_ = lambda o: F.col("outcome") == o
    per = judged.groupBy("video_id").agg(F.max(F.when(is_("accepted"), F.regexp_extract("event", r"^tier(\d+)", 1).cast("int"))).alias("tier"),
                                         *(F.count_if(is_(o)).alias(o) for o in ("accepted", "duplicate", "vetoed")))
    return cast.select("video_id", "scene").join(per, "video_id", "left").na.fill(0, ["accepted", "duplicate", "vetoed"])


LADDER_SQL = scene_sql(5) + """SELECT video_id, scene, CAST(CASE scene WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 4 THEN 2 END AS INTEGER) AS tier, CAST(CASE WHEN scene IN (0, 1, 4) THEN 1 ELSE 0 END AS BIGINT) AS accepted,
  CAST(CASE scene WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS BIGINT) AS duplicate, CAST(CASE scene WHEN 3 THEN 2 ELSE 0 END AS BIGINT) AS vetoed FROM scn"""


@query("t12_ladder_scenes", oracle=LADDER_SQL)
def t12_scenes(spark, sf):
    """A relaxed tier rescues, the strict one overtakes what is held, or vetoes it if it is still held."""
    cast, events, ends = ladder_events(spark, sf)
    return ladder_outcomes(cast, tiers.arbitrate(tiers.candidates(events, ends), ["video_id", "session", "person_uid"], "event"))


@query("j18_config_sweep", oracle=scene_sql(7) + """SELECT scene, config_id, count(*) AS videos, CAST(sum(CASE WHEN config_id = 'base' AND scene IN (0, 1, 5) THEN 1 ELSE 0 END) AS BIGINT) AS confirmed
  FROM scn, (VALUES ('base'), ('confident'), ('long_carry')) c(config_id) GROUP BY 1, 2""")
def j18(spark, sf):
    """Replay of every video under every config; parallelism is videos times configs."""
    boxes, ticks, cast = scenes.play(spark, sf, scenes.CORE)
    configs = {"base": scenes.FAST, "confident": scenes.FAST.with_overrides(min_event_confidence=1.01), "long_carry": scenes.FAST.with_overrides(min_carried_frames=50)}
    events = pairfsm.pair_events(scenes.machine_rows(boxes, ticks, cast, configs, every=True, ordered=True), configs, ordered=True)
    hits = events.groupBy("video_id", "config_id").agg(F.count_if("confirmed").alias("c"))
    runs = cast.select("video_id", "scene", F.explode(F.array(*(F.lit(c) for c in configs))).alias("config_id"))
    return runs.join(hits, ["video_id", "config_id"], "left").groupBy("scene", "config_id").agg(F.count(F.lit(1)).alias("videos"), F.coalesce(F.sum("c"), F.lit(0)).alias("confirmed"))


@query("a19_machine_calibration", oracle="""SELECT c_custkey AS video_id, s AS session, config_id, -1.0::DOUBLE AS before,
    CASE WHEN (c_custkey + s) % 2 = 1 THEN least(0.8::DOUBLE, greatest(0.3::DOUBLE, 20.0::DOUBLE / 160.0::DOUBLE * fps)) ELSE -1.0::DOUBLE END AS after
  FROM customer, (VALUES (0::BIGINT), (1::BIGINT)) t(s), (VALUES ('quick', 10.0::DOUBLE), ('slow', 3.0::DOUBLE), ('early', 4.0::DOUBLE)) c(config_id, fps)""")
def a19_machine(spark, sf):
    """Departure ratios the machine receives, per session and config: a standing and a walking session of each video.

    `before` is what it is told until the calibration is over (-1: nothing), `after` from then on; who stands teaches nothing.
    """
    cast = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("video_id"))
    parts = []
    for session in (0, 1):
        here = cast.withColumn("scene", ((F.col("video_id") + session) % 2).cast("int"))
        boxes, ticks, _ = scenes.staged(spark, here, scenes.CALIBRATION)
        parts.append([df.withColumn("session", F.lit(session).cast("bigint")).withColumn("frame", F.col("frame") + 30 * session) for df in (boxes, ticks)])
    boxes, ticks = (a.unionByName(b) for a, b in zip(*parts))
    configs = {"quick": scenes.FAST, "slow": scenes.FAST.with_overrides(analysis_fps=3.0, departure_motion_ratio=0.3), "early": scenes.FAST.with_overrides(analysis_fps=4.0, calibration_frames=10)}
    depth = F.when(F.col("config_id") == "early", 10).otherwise(scenes.FAST.calibration_frames)
    rows = pairfeatures.tick_rows(boxes.withColumn("in_zone", F.lit(False)), ticks, configs).where("kind = 0")
    over = F.col("frame") - 30 * F.col("session") >= depth - 1
    return rows.groupBy("video_id", "session", "config_id").agg(F.max(F.when(~over, F.col("norm"))).alias("before"), F.max(F.when(over, F.col("norm"))).alias("after"))


@query("j18_pose_sweep", oracle="""WITH p(track, dx, inside, wrist) AS (VALUES (1::BIGINT, 20.0::DOUBLE, 1.0::DOUBLE, sqrt(100.0::DOUBLE + 25600.0)), (2::BIGINT, 40.0::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE)),
  s AS (SELECT track, 0.55 * greatest(0.0, 1.0 - sqrt(dx * dx + 1600.0) / 160.0 / 0.5) + 0.25 * inside + 0.20 AS plain, 0.4 / (1.0 + wrist / 80.0) + 0.3 + 0.3 AS body FROM p),
  b(config_id, blend) AS (VALUES ('off', 0.0::DOUBLE), ('none', 0.0::DOUBLE), ('half', 0.5::DOUBLE), ('most', 0.9::DOUBLE)),
  o AS (SELECT config_id, track, (1.0 - blend) * plain + blend * body AS score FROM s, b)
  SELECT c_custkey AS video_id, config_id, arg_max(track, score) AS owner, round(max(score), 9) AS score FROM customer, o GROUP BY 1, 2""")
def j18_pose(spark, sf):
    """Owner of an object under pose blends of 0, one half and 0.9."""
    boxes, ticks, _ = scenes.play(spark, sf, scenes.POSE)
    configs = {n: scenes.FAST.with_overrides(pose_association_enabled=n != "off", pose_score_blend=b) for n, b in (("off", 0.9), ("none", 0.0), ("half", 0.5), ("most", 0.9))}
    rows = pairfeatures.tick_rows(boxes.withColumn("in_zone", F.lit(False)), ticks, configs).where("kind = 3 AND frame = 5")
    return rows.groupBy("video_id", "config_id").agg(F.max_by("p_track", "score").alias("owner"), F.round(F.max("score"), 9).alias("score"))


@query("t06_detections_pipeline", oracle=views.ON_DET + """, f AS (SELECT DISTINCT video_id, frame FROM det), g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY video_id ORDER BY frame) AS gap FROM f)
SELECT video_id, count(*) AS ticks, 1 + count(*) FILTER (gap >= 2) AS sessions, true AS has_boxes, 0::BIGINT AS repeated_uids, 0::BIGINT AS disordered, 0::BIGINT AS crossing, 0::BIGINT AS crowded, 0::BIGINT AS lost
FROM g GROUP BY video_id""")
def t06_detections(spark, sf):
    """Detections to incidents over all rows of the detection view, held against what must never happen.

    An object uid twice in a tick, milestones out of order, an event beyond its session, two accepted events of one actor within the
    duplicate window, and an accepted event whose incident is missing.
    """
    det = det_tracks(spark, sf).drop("session")
    everything = views.det(spark, sf).withColumn("track_id", labels.namespaced(F.col("track_no"), F.col("is_person"))).drop("track_no")
    marks = [c for c in det.columns if c not in everything.columns]
    det = det.unionByName(everything.where(~F.col("is_person")).select("*", *(F.lit(None).cast(dict(det.dtypes)[m]).alias(m) for m in marks)))
    ticks = everything.select("video_id", "frame").distinct().withColumn("ts", F.col("frame") * 10.0)
    zones = views.table(spark, sf, "supplier").select((F.col("s_suppkey") % 16).alias("camera_id"), geom.polygon_from_box(geom.Box(*(F.lit(v) for v in scenes.ZONE))).alias("polygon"))
    boxes, judged, found = incidents.incidents(det, ticks, zones, tiers.ladder(scenes.FAST), views.FRAME_W, views.FRAME_H, quiet=20.0, longest=1e9)
    clip = ["video_id", "session"]
    timed = incidents.session_ticks(ticks, 20.0, 1e9)
    ends = timed.groupBy(*clip).agg(F.max("tick").alias("last_tick"), F.count(F.lit(1)).alias("n"))
    per = ends.groupBy("video_id").agg(F.sum("n").alias("ticks"), F.count(F.lit(1)).alias("sessions"))
    known = identity.stable_uids(boxes, clip)
    # A returning raw person id may meet the id that took its uid over; an object's uid is taken once a tick.
    twice = known.where(~F.col("is_person")).groupBy(*clip, "frame", "uid").agg(F.count(F.lit(1)).alias("n")).groupBy("video_id").agg(F.count_if(F.col("n") > 1).alias("repeated_uids"), F.lit(True).alias("has_boxes"))
    # A pair confirmed without an observation is stamped with its last one, before the milestones that confirmed it.
    at = [F.col(f"{m}_frame") for m in pairfsm.MOMENTS if m != "confirmed"]
    disordered = F.exists(F.array(*(F.coalesce(a > b, F.lit(False)) for i, a in enumerate(at) for b in at[i + 1:])), lambda x: x)
    wrong = judged.join(ends, clip).groupBy("video_id").agg(
        F.count_if(disordered).alias("disordered"), F.count_if(F.coalesce(F.greatest(*at) > F.col("last_tick"), F.lit(False))).alias("crossing"))
    kept = judged.where("outcome = 'accepted'").withColumn("t", tiers.event_time())
    w = Window.partitionBy(*clip, "person_uid").orderBy("t")
    close = kept.where("t is not null").withColumn("gap", F.col("t") - F.lag("t").over(w)).groupBy("video_id").agg(F.count_if(F.col("gap") <= tiers.DUPLICATE_SEC).alias("crowded"))
    clips = kept.where("t is not null").select("video_id", F.concat_ws("/", *clip).alias("clip")).distinct()
    lost = clips.join(found.select("clip").distinct(), "clip", "left_anti").groupBy("video_id").agg(F.count(F.lit(1)).alias("lost"))
    out = per
    for part in (twice, wrong, close, lost):
        out = out.join(part, "video_id", "left")
    return out.na.fill(0).na.fill(False)


@query("x03_explain_states", oracle=scene_sql(7) + """SELECT video_id, scene, CASE scene WHEN 2 THEN 'BAG_CARRIED' WHEN 3 THEN NULL WHEN 4 THEN 'PERSON_DEPARTED' WHEN 6 THEN 'BAG_ON_GROUND' ELSE 'VIOLATION_CONFIRMED' END AS furthest FROM scn""")
def x03(spark, sf):
    """Per-tick explain rows, reduced to the furthest state each video reached."""
    boxes, ticks, cast = scenes.play(spark, sf, scenes.CORE)
    rows = pairfsm.pair_events(scenes.machine_rows(boxes, ticks, cast, ordered=True), scenes.CONFIGS, explain=True, ordered=True)
    order = F.array(*(F.lit(s) for s in STATES))
    best = rows.groupBy("video_id").agg(F.max_by("state", F.array_position(order, F.col("state"))).alias("furthest"))
    return cast.select("video_id", "scene").join(best, "video_id", "left")


ARB_SQL = """e0 AS (SELECT camera_id AS video_id, actor_uid, id, id % 3 AS tier, epoch_us(event_ts) / 1e6 AS ts, status = 'confirmed' AS confirmed, status = 'rejected' AS rejected, confidence > 0.02 AS separated FROM evt),
  e1 AS (SELECT *, CASE WHEN tier > 0 THEN ts + 10800 ELSE ts END AS due FROM e0 WHERE confirmed OR (rejected AND tier = 0)),
  e AS (SELECT *, row_number() OVER (PARTITION BY video_id, actor_uid ORDER BY due, tier, id) AS rn FROM e1),
  f AS (SELECT video_id, actor_uid, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[]) AS acc, CAST([] AS DOUBLE[]) AS veto, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS outcome FROM e WHERE e.rn = 1
    UNION ALL SELECT video_id, actor_uid, rn, CASE WHEN o = 'accepted' THEN list_append(acc, ts) ELSE acc END, CASE WHEN o = 'rejected' THEN list_append(veto, ts) ELSE veto END, id, o
    FROM (SELECT f.acc, f.veto, e.*, CASE WHEN NOT e.confirmed THEN 'rejected' WHEN len(list_filter(f.acc, lambda t: abs(e.ts - t) <= 21600)) > 0 THEN 'duplicate'
        WHEN e.tier > 0 AND NOT e.separated THEN 'unseparated' WHEN e.tier > 0 AND len(list_filter(f.veto, lambda t: abs(e.ts - t) <= 43200)) > 0 THEN 'vetoed' ELSE 'accepted' END AS o
      FROM f JOIN e ON e.video_id = f.video_id AND e.actor_uid = f.actor_uid AND e.rn = f.rn + 1) q)"""


@query("j21_tier_arbitration", oracle=views.with_views(views.EVT_SQL, ARB_SQL, recursive=True) + "SELECT video_id, actor_uid, id, outcome FROM f WHERE rn > 0")
def j21(spark, sf):
    return tiers.arbitrate(arbitration_rows(spark, sf), ["video_id", "actor_uid"], "id", near=21600.0)


def arbitration_rows(spark, sf):
    """Events as tiers of three, with windows in hours instead of seconds."""
    e = views.evt(spark, sf).withColumn("tier", (F.col("id") % 3).cast("int")).withColumn("ts", views.micros("event_ts") / 1e6)
    return e.where((F.col("status") == "confirmed") | ((F.col("status") == "rejected") & (F.col("tier") == 0))).select(
        F.col("camera_id").alias("video_id"), "actor_uid", "id", "tier", "ts", (F.col("status") == "confirmed").alias("confirmed"), F.lit("BIN_DISPOSAL").alias("reason"),
        (F.col("confidence") > 0.02).alias("separated"), F.when(F.col("tier") > 0, F.col("ts") + 10800).otherwise(F.col("ts")).alias("at"))


@query("t15_recent_ticks", oracle=views.ON_TICK + "SELECT video_id, event_id FROM (SELECT *, max(ts) OVER (PARTITION BY video_id) AS newest FROM tick) t WHERE epoch_us(newest) - epoch_us(ts) <= 172800000000")
def t15(spark, sf):
    """The last two days per camera: the newest time is one row per camera, joined back."""
    e = views.table(spark, sf, "events").select(F.col("user_id").alias("video_id"), "event_id", views.micros().alias("us"))
    newest = e.groupBy("video_id").agg(F.max("us").alias("newest"))
    return e.join(newest, "video_id").where(F.col("newest") - F.col("us") <= 172_800_000_000).select("video_id", "event_id")


@query("t16_latest_frame", oracle=views.ON_TICK + "SELECT video_id, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM tick GROUP BY video_id")
def t16(spark, sf):
    e = views.table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("video_id")).agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select("video_id", "m.ts", "m.value", "m.event_id")


@query("t17_status_upsert", oracle=views.ON_TICK + """SELECT user_id AS video_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS fps, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'view') AS camera_status,
  max(ts) AS updated_at FROM events GROUP BY 1""")
def t17(spark, sf):
    """Partial updates merged field by field: the last non-null value of each wins."""
    e = views.table(spark, sf, "events")
    at = F.struct("ts", "event_id")
    updates = e.select(F.col("user_id").alias("video_id"), "ts", at.alias("at"), F.when(F.col("event_type") == "view", F.col("value")).alias("fps"),
                       F.when(F.col("event_type") != "view", F.col("event_type")).alias("camera_status"))
    return updates.groupBy("video_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in ("fps", "camera_status")), F.max("ts").alias("updated_at"))


MERGE_SQL = """WITH e AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
ent AS (SELECT user_id AS video_id, n, unnest(CASE WHEN event_id % 4 = 0 THEN [{'p': 'camera', 'v': NULL}, {'p': 'camera.status', 'v': '"' || event_type || '"'}, {'p': 'camera.index', 'v': event_id::VARCHAR}]
  WHEN event_id % 4 = 1 THEN [{'p': 'processing', 'v': NULL}, {'p': 'processing.lag', 'v': NULL}, {'p': 'processing.lag.ms', 'v': event_id::VARCHAR}]
  WHEN event_id % 8 = 2 THEN [{'p': 'camera', 'v': '"offline"'}] WHEN event_id % 8 = 6 THEN [{'p': 'camera', 'v': NULL}, {'p': 'camera.fps', 'v': (event_id % 30)::VARCHAR}]
  WHEN event_id % 8 = 3 THEN [{'p': 'processing', 'v': NULL}, {'p': 'processing.lag', 'v': event_id::VARCHAR}] ELSE [{'p': 'processing', 'v': NULL}] END) AS x FROM e),
s AS (SELECT video_id, x.p AS path, arg_max(x.v, n) FILTER (WHERE x.v IS NOT NULL) AS v, coalesce(max(n) FILTER (WHERE x.v IS NOT NULL), 0) AS l, coalesce(max(n) FILTER (WHERE x.v IS NULL), 0) AS o FROM ent GROUP BY 1, 2),
a AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.video_id = s.video_id AND starts_with(s.path, p.path || '.') AND p.l > greatest(s.l, s.o)))
SELECT video_id, path, CASE WHEN l > o THEN v ELSE '{}' END AS value FROM a WHERE l > o OR NOT EXISTS (SELECT 1 FROM a c WHERE c.video_id = a.video_id AND starts_with(c.path, a.path || '.'))"""


def status_updates(spark, sf):
    """Every event as a partial status update of its camera, in the layouts that the live page is sent."""
    e = views.table(spark, sf, "events")
    i = F.col("event_id")
    nested = lambda **parts: F.to_json(F.struct(*(c.alias(k) for k, c in parts.items())))
    inner = lambda **parts: F.struct(*(c.alias(k) for k, c in parts.items()))
    doc = F.when(i % 4 == 0, nested(camera=inner(status=F.col("event_type"), index=i))).when(i % 4 == 1, nested(processing=inner(lag=inner(ms=i)))).when(
        i % 8 == 2, nested(camera=F.lit("offline"))).when(i % 8 == 6, nested(camera=inner(fps=i % 30))).when(i % 8 == 3, nested(processing=inner(lag=i))).otherwise(F.lit('{"processing": {}}'))
    return e.select(F.col("user_id").alias("video_id"), F.struct("ts", "event_id").alias("at"), "event_id", doc.alias("doc"))


@query("t17_deep_merge", oracle=MERGE_SQL)
def t17_merge(spark, sf):
    """Nested updates merged in order of time: values replace objects and the other way round."""
    state = status.latest(status.entries(status_updates(spark, sf), ["video_id"], "at", "doc"), ["video_id"], "at")
    return status.merged(state, ["video_id"]).select("video_id", F.array_join("path", ".").alias("path"), "value")
