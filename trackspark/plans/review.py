"""Registered queries over events, evidence, jobs and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.config import LEARNING_STEPS
from trackspark.functions import scoring
from trackspark.operators import relations
from trackspark.plans import views
from trackspark.plans.registry import query
from trackspark.plans.scalars import r9
from trackspark.session import scratch_path
from trackspark.sources import sinks

EVIDENCE_SQL = """evidence AS (SELECT o_orderkey AS evidence_id, o_custkey AS event_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'img/' || o_orderkey END AS image_path,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'vid/' || o_orderkey END AS video_path, o_orderkey % 7 AS image_bytes FROM orders)"""
JOBS_SQL = """jobs AS (SELECT analysis_job_id AS job_id, CASE WHEN analysis_job_id % 10 = 3 THEN 'processing' ELSE 'completed' END AS status, 'report-' || analysis_job_id AS report,
  count(*) AS n_events FROM evt GROUP BY 1)"""
ON_REVIEW = views.with_views(views.EVT_SQL, EVIDENCE_SQL, JOBS_SQL)


def evidence(spark, sf):
    o = views.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("evidence_id"), F.col("o_custkey").alias("event_id"), F.when(k % 5 != 0, F.concat(F.lit("img/"), k)).alias("image_path"),
                    F.when(k % 4 != 0, F.concat(F.lit("vid/"), k)).alias("video_path"), (k % 7).alias("image_bytes"))


def jobs(spark, sf):
    e = views.evt(spark, sf).groupBy(F.col("analysis_job_id").alias("job_id")).agg(F.count(F.lit(1)).alias("n_events"))
    return e.select("job_id", F.when(F.col("job_id") % 10 == 3, "processing").otherwise("completed").alias("status"),
                    F.concat(F.lit("report-"), "job_id").alias("report"), "n_events")


@query("a01_detector_summary", oracle=views.ON_EVT + """SELECT camera_id, count(*) AS total, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'rejected') AS rejected,
  round(count(*) FILTER (WHERE status = 'confirmed') / count(*), 4) AS acceptance_rate FROM evt WHERE status IN ('confirmed', 'rejected') GROUP BY 1""")
def a01(spark, sf):
    e = views.evt(spark, sf).where(F.col("status").isin("confirmed", "rejected"))
    ok = F.count_if(F.col("status") == "confirmed")
    return e.groupBy("camera_id").agg(F.count(F.lit(1)).alias("total"), ok.alias("confirmed"), F.count_if(F.col("status") == "rejected").alias("rejected"),
                                      F.round(ok / F.count(F.lit(1)), 4).alias("acceptance_rate"))


@query("a01_reason_counts", oracle=views.ON_EVT + "SELECT camera_id, object_type AS reason, count(*) AS n FROM evt WHERE status = 'rejected' GROUP BY 1, 2")
def a01_reasons(spark, sf):
    return views.evt(spark, sf).where(F.col("status") == "rejected").groupBy("camera_id", F.col("object_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("a02_system_statistics", oracle=views.ON_EVT + """SELECT coalesce(object_type, 'ALL') AS object_type, count(*) AS total, count(*) FILTER (WHERE event_ts >= TIMESTAMP '2024-01-08') AS since_midnight,
  round(coalesce(avg(confidence), 0.0), 4) AS avg_confidence, count(DISTINCT camera_id) AS cameras FROM evt GROUP BY GROUPING SETS ((object_type), ())""")
def a02(spark, sf):
    midnight = F.lit("2024-01-08").cast("timestamp_ntz")
    return views.evt(spark, sf).groupingSets([[F.col("object_type")], []], F.col("object_type")).agg(
        F.coalesce(F.col("object_type"), F.lit("ALL")).alias("scope"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_ts") >= midnight).alias("since_midnight"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"), F.countDistinct("camera_id").alias("cameras")).select(
        F.col("scope").alias("object_type"), "total", "since_midnight", "avg_confidence", "cameras")


@query("a15_histograms", oracle=views.ON_EVT + """, h AS (SELECT 'hour' AS kind, CAST(hour(event_ts) AS VARCHAR) AS bin FROM evt UNION ALL SELECT 'status', status FROM evt UNION ALL SELECT 'type', object_type FROM evt
  UNION ALL SELECT 'confidence', CASE WHEN confidence < 0.5 THEN '0-50%' WHEN confidence < 0.7 THEN '50-70%' WHEN confidence < 0.85 THEN '70-85%' ELSE '85-100%' END FROM evt),
  c AS (SELECT kind, bin, count(*) AS n FROM h GROUP BY 1, 2), z AS (SELECT 'hour' AS kind, CAST(x AS VARCHAR) AS bin FROM range(24) t(x))
SELECT coalesce(c.kind, z.kind) AS kind, coalesce(c.bin, z.bin) AS bin, coalesce(n, 0) AS n FROM c FULL OUTER JOIN z ON c.kind = z.kind AND c.bin = z.bin""")
def a15(spark, sf):
    """All histograms from one scan: bins are stacked, counted, and the 24 hours zero-filled."""
    e = views.evt(spark, sf)
    bins = F.array(F.struct(F.lit("hour").alias("kind"), F.hour("event_ts").cast("string").alias("bin")), F.struct(F.lit("status").alias("kind"), F.col("status").alias("bin")),
                   F.struct(F.lit("type").alias("kind"), F.col("object_type").alias("bin")), F.struct(F.lit("confidence").alias("kind"), scoring.confidence_bucket(F.col("confidence")).alias("bin")))
    counts = e.select(F.inline(bins)).groupBy("kind", "bin").agg(F.count(F.lit(1)).alias("n"))
    hours = spark.range(24).select(F.lit("hour").alias("kind"), F.col("id").cast("string").alias("bin"))
    return counts.join(hours, ["kind", "bin"], "full_outer").select("kind", "bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("a16_no_event_reason", oracle=views.ON_EVT + """, r AS (SELECT actor_uid, object_type, count(*) AS n FROM evt WHERE status = 'rejected' GROUP BY 1, 2), t AS (SELECT actor_uid, arg_max(object_type, (n, object_type)) AS top FROM r GROUP BY 1),
  v AS (SELECT actor_uid, count(*) FILTER (WHERE status <> 'new') AS persons, count(*) FILTER (WHERE status = 'reviewing') AS objects, count(*) FILTER (WHERE status IN ('confirmed', 'rejected')) AS candidates FROM evt GROUP BY 1)
SELECT actor_uid, CASE WHEN persons = 0 THEN 'PERSON_NOT_DETECTED' WHEN objects = 0 THEN 'OBJECT_NOT_DETECTED' WHEN top IS NOT NULL THEN top WHEN candidates = 0 THEN 'ASSOCIATION_FAILED' ELSE 'NO_LITTERING_EVENT_CANDIDATE' END AS reason
FROM v LEFT JOIN t USING (actor_uid)""")
def a16(spark, sf):
    e = views.evt(spark, sf)
    reasons = e.where(F.col("status") == "rejected").groupBy("actor_uid", "object_type").agg(F.count(F.lit(1)).alias("n"))
    top = reasons.groupBy("actor_uid").agg(F.max_by("object_type", F.struct("n", "object_type")).alias("top"))
    v = e.groupBy("actor_uid").agg(F.count_if(F.col("status") != "new").alias("persons"), F.count_if(F.col("status") == "reviewing").alias("objects"),
                                   F.count_if(F.col("status").isin("confirmed", "rejected")).alias("candidates"))
    reason = (F.when(F.col("persons") == 0, F.lit("PERSON_NOT_DETECTED")).when(F.col("objects") == 0, "OBJECT_NOT_DETECTED").when(F.col("top").isNotNull(), F.col("top"))
              .when(F.col("candidates") == 0, "ASSOCIATION_FAILED").otherwise("NO_LITTERING_EVENT_CANDIDATE"))
    return v.join(top, "actor_uid", "left").select("actor_uid", reason.alias("reason"))


RANKED = ["NO_BAG", "BAG_NEAR_PERSON", "BAG_CARRIED", "BAG_RELEASED", "BAG_ON_GROUND", "PERSON_DEPARTED", "VIOLATION_CONFIRMED"]


@query("a17_most_advanced_state", oracle=f"WITH s AS (SELECT l_orderkey AS tick_id, CAST(l_suppkey % 7 AS INTEGER) AS r FROM lineitem) SELECT tick_id, ({RANKED!r})[max(r) + 1] AS state FROM s GROUP BY tick_id")
def a17(spark, sf):
    """The near state ranks one, so it beats "nothing yet"."""
    names = F.array(*(F.lit(s) for s in RANKED))
    s = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("tick_id"), F.get(names, (F.col("l_suppkey") % 7).cast("int")).alias("state"))
    return s.groupBy("tick_id").agg(F.max_by("state", F.array_position(names, F.col("state"))).alias("state"))


@query("a27_job_progress", oracle="""SELECT o_orderkey AS job_id, CAST(CASE WHEN o_custkey % 9 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END ELSE least(100, floor((o_orderkey % 300) / (o_custkey % 9 * 30) * 100 + 0.5)) END AS BIGINT) AS percent,
  greatest(0, o_orderkey % 9 - o_orderkey % 4 - o_custkey % 3) AS active_candidates, round((o_orderkey % 300) / greatest(1e-6, o_custkey % 50 / 7.0), 9) AS total_fps FROM orders""")
def a27(spark, sf):
    o = views.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    done, total = k % 300, c % 9 * 30
    percent = F.when(total == 0, F.when(F.col("o_orderstatus") == "F", 100).otherwise(0)).otherwise(F.least(F.lit(100), F.floor(done / total * 100 + 0.5)))
    return o.select(k.alias("job_id"), percent.cast("bigint").alias("percent"), F.greatest(F.lit(0), k % 9 - k % 4 - c % 3).alias("active_candidates"),
                    r9(done / F.greatest(F.lit(1e-6), c % 50 / 7.0)).alias("total_fps"))


@query("a28_reason_totals", oracle=views.ON_EVT + "SELECT reason, CAST(sum(n) AS BIGINT) AS n, count(*) AS videos FROM (SELECT analysis_job_id, object_type AS reason, count(*) AS n FROM evt WHERE status = 'rejected' GROUP BY 1, 2) t GROUP BY reason")
def a28(spark, sf):
    per = views.evt(spark, sf).where(F.col("status") == "rejected").groupBy("analysis_job_id", F.col("object_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("reason").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("videos"))


@query("f12_event_search", oracle=views.ON_EVT + """SELECT id, camera_id, status FROM evt WHERE status IN ('confirmed', 'new') AND camera_id <> 3 AND contains(lower(object_type), 'c')
  AND contains(lower('#' || id || ' ' || object_type || ' ' || actor_uid || ' ' || status), '1')""")
def f12(spark, sf):
    hay = F.lower(F.concat_ws(" ", F.concat(F.lit("#"), "id"), "object_type", F.col("actor_uid").cast("string"), "status"))
    e = views.evt(spark, sf).where(F.col("status").isin("confirmed", "new") & (F.col("camera_id") != 3) & F.contains(F.lower("object_type"), F.lit("c")))
    return e.where(F.contains(hay, F.lit("1"))).select("id", "camera_id", "status")


MARKER_WORDS = ["CARRIED", "RELEASE", "GROUND", "DEPARTURE", "EVENT", "VIOLATION", "PERSON"]
MARKERS_SQL = """first_seen AS (SELECT video_id, is_person, track_no, min(frame) AS frame FROM det GROUP BY 1, 2, 3),
  heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, is_person ORDER BY frame, track_no) AS rn FROM first_seen) t WHERE rn <= 5),
  marker AS (SELECT video_id, (CASE WHEN is_person THEN 'PERSON #' ELSE 'OBJECT #' END) || track_no || ' FIRST SEEN' AS label, frame, CASE WHEN is_person THEN 'person' ELSE 'object' END AS kind FROM heads
    UNION ALL SELECT event_id % 16, unnest(['BAG CARRIED', 'RELEASE']), unnest([event_id % 90, CASE WHEN event_id % 3 <> 0 THEN event_id % 90 + 7 END]), 'event' FROM events WHERE event_type = 'error')"""


def markers(spark, sf):
    """First sightings (five per kind and video) and event milestones in one timeline."""
    seen = views.det(spark, sf).groupBy("video_id", "is_person", "track_no").agg(F.min("frame").alias("frame"))
    from pyspark.sql import Window
    w = Window.partitionBy("video_id", "is_person").orderBy("frame", "track_no")
    heads = seen.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    first = heads.select("video_id", F.concat(F.when(F.col("is_person"), F.lit("PERSON #")).otherwise("OBJECT #"), "track_no", F.lit(" FIRST SEEN")).alias("label"), "frame",
                         F.when(F.col("is_person"), "person").otherwise("object").alias("kind"))
    e = views.table(spark, sf, "events").where(F.col("event_type") == "error")
    i = F.col("event_id")
    wide = e.select((i % 16).alias("video_id"), i, (i % 90).alias("BAG CARRIED"), F.when(i % 3 != 0, i % 90 + 7).alias("RELEASE"))
    milestones = wide.unpivot(["video_id", "event_id"], ["BAG CARRIED", "RELEASE"], "label", "frame").where("frame is not null")
    return first.unionByName(milestones.select("video_id", "label", "frame", F.lit("event").alias("kind")))


@query("u06_marker_timeline", oracle=views.with_views(views.DET_SQL, MARKERS_SQL) + "SELECT video_id, label, frame, kind, round(frame / 30.0, 2) AS sec FROM marker WHERE frame IS NOT NULL")
def u06(spark, sf):
    return markers(spark, sf).withColumn("sec", F.round(F.col("frame") / 30.0, 2))


@query("f15_behavioural_markers", oracle=views.with_views(views.DET_SQL, MARKERS_SQL) + "SELECT video_id, count(*) FILTER (WHERE b) AS behavioural, count(*) FILTER (WHERE NOT b) AS proposals FROM (SELECT video_id, kind = 'event' OR contains(label, 'PERSON') AS b FROM marker WHERE frame IS NOT NULL) t GROUP BY 1")
def f15(spark, sf):
    words = F.array(*(F.lit(w) for w in MARKER_WORDS))
    behavioural = (F.col("kind") == "event") | F.exists(words, lambda w: F.contains(F.upper("label"), w))
    return markers(spark, sf).groupBy("video_id").agg(F.count_if(behavioural).alias("behavioural"), F.count_if(~behavioural).alias("proposals"))


@query("l06_first_tracks", oracle=views.with_views(views.DET_SQL, MARKERS_SQL) + "SELECT video_id, is_person, track_no, frame FROM heads")
def l06(spark, sf):
    from pyspark.sql import Window
    seen = views.det(spark, sf).groupBy("video_id", "is_person", "track_no").agg(F.min("frame").alias("frame"))
    w = Window.partitionBy("video_id", "is_person").orderBy("frame", "track_no")
    return seen.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query("f16_complete_artifacts", oracle=ON_REVIEW + """SELECT e.id AS event_id, EXISTS (SELECT 1 FROM evidence v WHERE v.event_id = e.id AND v.video_path IS NOT NULL AND v.image_bytes > 1) AS has_video
  FROM evt e WHERE EXISTS (SELECT 1 FROM evidence v WHERE v.event_id = e.id AND v.image_path IS NOT NULL AND v.image_bytes > 0)""")
def f16(spark, sf):
    ev = evidence(spark, sf)
    listing = ev.where("image_path is not null").select("event_id", F.lit("snapshot").alias("kind"), F.col("image_bytes").alias("length")).unionByName(
        ev.where("video_path is not null").select("event_id", F.lit("video").alias("kind"), (F.col("image_bytes") - 1).alias("length")))
    events = views.evt(spark, sf).select(F.col("id").alias("event_id"))
    return relations.complete_events(events, listing, "snapshot", {"has_video": "video"})


@query("j08_event_review", oracle=ON_REVIEW + """SELECT e.id, e.status, e.analysis_job_id, array_to_string(b.ids, ',') AS evidence_ids, j.report FROM evt e
  LEFT JOIN (SELECT event_id, list(evidence_id ORDER BY evidence_id) AS ids FROM evidence GROUP BY 1) b ON b.event_id = e.id LEFT JOIN jobs j ON j.job_id = e.analysis_job_id""")
def j08(spark, sf):
    out = relations.review_rows(views.evt(spark, sf), evidence(spark, sf), jobs(spark, sf))
    return out.select("id", "status", "analysis_job_id", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",").alias("evidence_ids"), "report")


@query("j09_job_events", oracle=ON_REVIEW + "SELECT j.job_id, j.status AS job_status, e.id AS event_id, e.confidence FROM jobs j JOIN evt e ON e.analysis_job_id = j.job_id")
def j09(spark, sf):
    e = views.evt(spark, sf).select(F.col("analysis_job_id").alias("job_id"), F.col("id").alias("event_id"), "confidence")
    return jobs(spark, sf).select("job_id", F.col("status").alias("job_status")).join(e, "job_id")


@query("j10_matching_violation", oracle="""WITH ev AS (SELECT event_id, event_id % 2000 AS job_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS actor_uid, CASE WHEN event_id % 3 <> 0 THEN event_id % 4 END AS object_uid,
    CASE WHEN event_id % 5 <> 0 THEN user_id % 20 END AS actor_track, CASE WHEN event_id % 5 <> 0 THEN event_id % 3 END AS object_track FROM events),
  v AS (SELECT event_id AS violation_id, event_id % 2000 AS job_id, user_id AS actor_uid, (event_id + 1) % 4 AS object_uid, user_id % 20 AS actor_track, event_id % 3 AS object_track FROM events WHERE event_type = 'purchase'),
  m AS (SELECT e.event_id, (SELECT min(violation_id) FROM v WHERE v.job_id = e.job_id AND v.actor_uid = e.actor_uid AND v.object_uid = e.object_uid) AS t0,
    (SELECT min(violation_id) FROM v WHERE v.job_id = e.job_id AND v.actor_track = e.actor_track AND v.object_track = e.object_track) AS t1,
    (SELECT CASE WHEN count(*) = 1 THEN min(violation_id) END FROM v WHERE v.job_id = e.job_id) AS only_one FROM ev e)
SELECT event_id, coalesce(t0, t1, only_one) AS violation_id, CASE WHEN t0 IS NOT NULL THEN 1 WHEN t1 IS NOT NULL THEN 2 WHEN only_one IS NOT NULL THEN 3 END AS tier FROM m""")
def j10(spark, sf):
    e = views.table(spark, sf, "events")
    i, u = F.col("event_id"), F.col("user_id")
    uid, trk = i % 3 != 0, i % 5 != 0
    events = e.select("event_id", (i % 2000).alias("job_id"), F.when(uid, u).alias("actor_uid"), F.when(uid, i % 4).alias("object_uid"),
                      F.when(trk, u % 20).alias("actor_track"), F.when(trk, i % 3).alias("object_track"))
    violations = e.where(F.col("event_type") == "purchase").select(i.alias("violation_id"), (i % 2000).alias("job_id"), u.alias("actor_uid"), ((i + 1) % 4).alias("object_uid"),
                                                                    (u % 20).alias("actor_track"), (i % 3).alias("object_track"))
    out = relations.matching_violation(events, violations, [["actor_uid", "object_uid"], ["actor_track", "object_track"]])
    return out.select("event_id", "violation_id", "tier")


NEAR_SQL = """tgt AS (SELECT event_id, user_id AS video_id, epoch_us(ts) / 1e6 AS sec FROM events WHERE event_type = 'error'), rec AS (SELECT event_id AS record_id, user_id AS video_id, epoch_us(ts) / 1e6 AS sec FROM events WHERE event_type = 'view')"""


@query("j11_closest_record", oracle=views.with_views(NEAR_SQL) + "SELECT t.video_id, t.event_id, arg_min(r.record_id, (abs(r.sec - t.sec), r.sec, r.record_id)) AS record_id FROM tgt t LEFT JOIN rec r USING (video_id) GROUP BY 1, 2")
def j11(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", F.col("user_id").alias("video_id"), (views.micros() / 1e6).alias("sec"), "event_type")
    targets = e.where(F.col("event_type") == "error").drop("event_type")
    records = e.where(F.col("event_type") == "view").drop("event_type").withColumnRenamed("event_id", "record_id")
    return relations.nearest(targets, records, ["video_id"], "sec", "event_id", "record_id", 86400.0)


@query("j12_frames_around", oracle=views.with_views(NEAR_SQL) + """SELECT t.event_id, count(*) AS frames, min(r.sec) AS first_sec, max(r.sec) AS last_sec FROM tgt t JOIN rec r ON r.video_id = t.video_id AND r.sec BETWEEN t.sec - 43200 AND t.sec + 21600 GROUP BY 1""")
def j12(spark, sf):
    """Frames from half a day before to a quarter day after each event of the same camera."""
    e = views.table(spark, sf, "events").select("event_id", F.col("user_id").alias("video_id"), (views.micros() / 1e6).alias("sec"), "event_type")
    requests = e.where(F.col("event_type") == "error").select("event_id", "video_id", F.col("sec").alias("at"))
    frames = e.where(F.col("event_type") == "view").select("video_id", "sec")
    hit = relations.within(requests, frames, ["video_id"], F.col("at") - 43200, F.col("at") + 21600, "sec", 43200.0)
    return hit.groupBy("event_id").agg(F.count(F.lit(1)).alias("frames"), F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"))


FRAME_EVENTS_SQL = """fe AS (SELECT o_orderkey AS event_id, o_custkey % 16 AS video_id, o_orderkey % 1000 AS frame, o_custkey % 12 AS actor_uid, o_orderkey % 40 + 1 AS actor_track FROM orders)"""


def frame_events(spark, sf):
    o = views.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(k.alias("event_id"), (c % 16).alias("video_id"), (k % 1000).alias("frame"), (c % 12).alias("actor_uid"), (k % 40 + 1).alias("actor_track"))


@query("j14_event_entities", oracle=views.with_views(views.DET_SQL, FRAME_EVENTS_SQL) + """SELECT event_id, CAST(min(CASE WHEN track_no % 12 = actor_uid THEN 1 ELSE 2 END) AS INTEGER) AS rank,
  arg_min(det_id, (CASE WHEN track_no % 12 = actor_uid THEN 1 ELSE 2 END, det_id)) AS det_id FROM fe JOIN det USING (video_id, frame) WHERE is_person AND (track_no % 12 = actor_uid OR track_no = actor_track) GROUP BY 1""")
def j14(spark, sf):
    boxes = views.det(spark, sf).where("is_person").select("video_id", "frame", "det_id", (F.col("track_no") % 12).alias("box_uid"), F.col("track_no").alias("box_track"))
    return relations.found_entity(frame_events(spark, sf), boxes, "actor_uid", "actor_track")


@query("j15_trajectories", oracle=views.with_views(views.DET_SQL, FRAME_EVENTS_SQL) + """, j AS (SELECT event_id, det.frame AS frame, x1, row_number() OVER (PARTITION BY event_id ORDER BY det.frame DESC, det_id DESC) AS rn FROM fe JOIN det
    ON det.video_id = fe.video_id AND det.track_no = fe.actor_track AND det.is_person AND det.frame BETWEEN fe.frame AND fe.frame + 120)
SELECT event_id, count(*) AS points, min(frame) AS first_frame, max(frame) AS last_frame, CAST(sum(x1) AS DOUBLE) AS sum_x FROM j WHERE rn <= 4 GROUP BY 1""")
def j15(spark, sf):
    """Actor boxes between an event's first and last frame, the last four points of each."""
    ev = frame_events(spark, sf).select("event_id", "video_id", F.col("actor_track").alias("track_no"), F.col("frame").alias("f0"))
    boxes = views.det(spark, sf).where("is_person").select("video_id", "track_no", "frame", "det_id", "x1")
    pts = relations.within(ev, boxes, ["video_id", "track_no"], F.col("f0"), F.col("f0") + 120, "frame", 128)
    tail = relations.last_points(pts.withColumn("_at", F.struct("frame", "det_id")), ["event_id"], "_at", 4)
    return tail.groupBy("event_id").agg(F.count(F.lit(1)).alias("points"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.sum("x1").alias("sum_x"))


VERDICT_SQL = "vd AS (SELECT o_orderkey AS verdict_id, o_custkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN 'reject' ELSE 'confirm' END AS verdict, o_orderdate AS created_at FROM orders)"


@query("j22_apply_verdicts", oracle=views.with_views(views.EVT_SQL, VERDICT_SQL) + """, l AS (SELECT event_id, arg_max(verdict, (created_at, verdict_id)) AS verdict FROM vd GROUP BY 1)
SELECT id, CASE verdict WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' ELSE status END AS final_status, coalesce(verdict = 'reject', false) AS hard_negative FROM evt LEFT JOIN l ON event_id = id""")
def j22(spark, sf):
    o = views.table(spark, sf, "orders")
    verdicts = o.select(F.col("o_orderkey").alias("verdict_id"), F.col("o_custkey").alias("event_id"),
                        F.when(F.col("o_orderkey") % 3 == 0, "reject").otherwise("confirm").alias("verdict"), F.col("o_orderdate").alias("created_at"))
    return relations.apply_verdicts(views.evt(spark, sf), verdicts).select("id", "final_status", "hard_negative")


DELETED_SQL = ON_REVIEW + """, gone AS (SELECT job_id FROM jobs WHERE job_id % 2 = 1 AND status <> 'processing')
SELECT (SELECT count(*) FROM evt WHERE analysis_job_id NOT IN (SELECT job_id FROM gone)) AS events_left, (SELECT count(*) FROM evidence WHERE event_id NOT IN (SELECT id FROM evt WHERE analysis_job_id IN (SELECT job_id FROM gone))) AS evidence_left,
  (SELECT count(*) FROM jobs WHERE job_id NOT IN (SELECT job_id FROM gone)) AS jobs_left"""


@query("j23_cascade_delete", oracle=DELETED_SQL)
def j23(spark, sf):
    j = jobs(spark, sf)
    left = relations.delete_jobs(views.evt(spark, sf), evidence(spark, sf), j, j.where(F.col("job_id") % 2 == 1).select("job_id"))
    counts = [d.agg(F.count(F.lit(1)).alias(n)).withColumn("k", F.lit(1)) for d, n in zip(left, ("events_left", "evidence_left", "jobs_left"))]
    return counts[0].join(counts[1], "k").join(counts[2], "k").drop("k")


@query("j23_stored_delete", oracle=DELETED_SQL)
def j23_stored(spark, sf):
    """The same over stored tables: written, deleted from, deleted from again, and read back."""
    path, j = scratch_path(spark, "stored-jobs"), jobs(spark, sf)
    sinks.store_jobs(views.evt(spark, sf), evidence(spark, sf), j, path)
    for _ in range(2):
        sinks.delete_stored_jobs(j.where(F.col("job_id") % 2 == 1), path)
    counts = [spark.read.parquet(f"{path}/{t}").agg(F.count(F.lit(1)).alias(f"{t}_left")).withColumn("k", F.lit(1)) for t in ("events", "evidence", "jobs")]
    return counts[0].join(counts[1], "k").join(counts[2], "k").drop("k")


@query("j24_identity_checks", oracle=views.with_views(views.EVT_SQL) + """, c AS (SELECT id AS event_id, actor_uid, object_uid, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 9 = 0 THEN actor_uid + 1 ELSE actor_uid END AS da, CASE WHEN id % 8 = 0 THEN object_uid + 1 ELSE object_uid END AS dobj,
    CASE WHEN id % 6 = 0 THEN actor_uid + 2 WHEN id % 6 = 1 THEN NULL ELSE actor_uid END AS ma, id % 5 AS snapshot, CASE WHEN id % 4 <> 0 THEN id % 3 END AS clip FROM evt)
SELECT event_id, 'actor_uid != detector' AS failed_check FROM c WHERE da <> actor_uid UNION ALL SELECT event_id, 'object_uid != detector' FROM c WHERE dobj <> object_uid UNION ALL SELECT event_id, 'actor_uid != metadata' FROM c WHERE ma <> actor_uid
UNION ALL SELECT event_id, 'snapshot missing/empty' FROM c WHERE coalesce(snapshot, 0) = 0 UNION ALL SELECT event_id, 'clip missing/empty' FROM c WHERE coalesce(clip, 0) = 0""")
def j24(spark, sf):
    e = views.evt(spark, sf)
    i, a, o = F.col("id"), F.col("actor_uid"), F.col("object_uid")
    events = e.select(i.alias("event_id"), a, o)
    detector = e.select(i.alias("event_id"), F.when(i % 13 == 0, F.lit(None)).when(i % 9 == 0, a + 1).otherwise(a).alias("det_actor_uid"), F.when(i % 8 == 0, o + 1).otherwise(o).alias("det_object_uid"))
    metadata = e.select(i.alias("event_id"), F.when(i % 6 == 0, a + 2).when(i % 6 == 1, F.lit(None)).otherwise(a).alias("meta_actor_uid"), (i % 5).alias("snapshot"), F.when(i % 4 != 0, i % 3).alias("clip"))
    return relations.identity_checks(events, detector, metadata, ["snapshot", "clip"])


@query("l01_event_page", oracle=views.ON_EVT + "SELECT id, status, (SELECT count(*) FROM evt) AS total FROM evt ORDER BY id DESC LIMIT 50 OFFSET 100")
def l01(spark, sf):
    return relations.page(views.evt(spark, sf).select("id", "status"), F.col("id").desc(), 50, 100)


@query("l02_top_reasons", oracle=views.ON_EVT + "SELECT actor_uid, object_type AS reason, n FROM (SELECT actor_uid, object_type, count(*) AS n, row_number() OVER (PARTITION BY actor_uid ORDER BY count(*) DESC, object_type) AS r FROM evt GROUP BY 1, 2) t WHERE r <= 3")
def l02(spark, sf):
    from pyspark.sql import Window
    counts = views.evt(spark, sf).groupBy("actor_uid", F.col("object_type").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("actor_uid").orderBy(F.col("n").desc(), "reason")
    return counts.withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query("l03_latest_evidence", oracle=views.with_views(EVIDENCE_SQL) + "SELECT event_id, arg_max(coalesce(image_path, '-'), evidence_id) AS snapshot, arg_min(coalesce(video_path, '-'), evidence_id) AS video FROM evidence GROUP BY 1")
def l03(spark, sf):
    return evidence(spark, sf).groupBy("event_id").agg(F.max_by(F.coalesce("image_path", F.lit("-")), "evidence_id").alias("snapshot"), F.min_by(F.coalesce("video_path", F.lit("-")), "evidence_id").alias("video"))


@query("l04_best_frame", oracle=views.with_views(views.DET_SQL, """ef AS (SELECT o_orderkey AS event_id, o_custkey % 16 AS video_id, o_orderkey % 40 + 1 AS actor, o_custkey % 40 + 1 AS item, unnest([1, 2, 3]) AS pref, unnest([o_orderkey % 900, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 900 + 3 END, o_orderkey % 900 + 9]) AS frame FROM orders)""",
    "rec AS (SELECT DISTINCT video_id, frame FROM det)", "nr AS (SELECT event_id, pref, e.video_id, actor, item, arg_min(r.frame, (abs(r.frame - e.frame), r.frame)) AS rf FROM ef e JOIN rec r ON r.video_id = e.video_id WHERE e.frame IS NOT NULL GROUP BY 1, 2, 3, 4, 5)") + """
SELECT event_id, CAST(min(pref) AS INTEGER) AS pref, arg_min(rf, pref) AS frame FROM nr WHERE EXISTS (SELECT 1 FROM det d WHERE d.video_id = nr.video_id AND d.frame = rf AND is_person AND track_no = actor)
  OR EXISTS (SELECT 1 FROM det d WHERE d.video_id = nr.video_id AND d.frame = rf AND NOT is_person AND track_no = item) GROUP BY 1""")
def l04(spark, sf):
    """Closest recorded frame to each preferred moment, first one where an involved track is visible.

    With forty tracks and four boxes per frame both at once are rare, so either one counts here.
    """
    o = views.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    prefs = F.array(*(F.struct(F.lit(p).alias("pref"), f.alias("frame")) for p, f in ((1, k % 900), (2, F.when(k % 3 != 0, k % 900 + 3)), (3, k % 900 + 9))))
    asked = o.select(k.alias("event_id"), (c % 16).alias("video_id"), (k % 40 + 1).alias("actor"), (c % 40 + 1).alias("item"), F.inline(prefs)).where("frame is not null")
    asked = asked.withColumn("ask_id", F.col("event_id") * 4 + F.col("pref"))
    det = views.det(spark, sf)
    records = det.select("video_id", "frame").distinct().withColumn("record_frame", F.col("frame"))
    close = relations.nearest(asked, records, ["video_id"], "frame", "ask_id", "record_frame", 1024)
    at = asked.drop("frame").join(close, ["video_id", "ask_id"])
    boxes = det.select("video_id", F.col("frame").alias("record_frame"), "is_person", "track_no")
    seen = at.join(boxes, ["video_id", "record_frame"]).where((F.col("is_person") & (F.col("track_no") == F.col("actor"))) | (~F.col("is_person") & (F.col("track_no") == F.col("item"))))
    return seen.groupBy("event_id").agg(F.min("pref").alias("pref"), F.min_by("record_frame", "pref").alias("frame"))


@query("l05_best_shots", oracle=views.ON_DET + """SELECT video_id, track_no, arg_max(frame, (confidence, frame)) FILTER (WHERE y2 - y1 >= 60) AS frame, max(confidence) FILTER (WHERE y2 - y1 >= 60) AS score,
  CASE WHEN count(*) FILTER (WHERE y2 - y1 >= 60) = 0 THEN 'LOW_QUALITY' ELSE 'CAPTURED' END AS status FROM det WHERE is_person GROUP BY 1, 2""")
def l05(spark, sf):
    shots = views.det(spark, sf).where("is_person").select("video_id", "track_no", "frame", F.col("confidence").alias("score"), (F.col("y2") - F.col("y1")).alias("size"))
    return relations.best_shots(shots, "video_id,track_no", 60.0)


@query("l07_custom_order", oracle=views.ON_DET + "SELECT video_id, frame, det_id, class_name FROM det WHERE NOT is_person ORDER BY CASE class_name WHEN 'cup' THEN 0 WHEN 'trash_bag' THEN 1 WHEN 'bottle' THEN 2 ELSE 9 END, video_id, frame, det_id")
def l07(spark, sf):
    rank = F.when(F.col("class_name") == "cup", 0).when(F.col("class_name") == "trash_bag", 1).when(F.col("class_name") == "bottle", 2).otherwise(9)
    return views.det(spark, sf).where(~F.col("is_person")).orderBy(rank, "video_id", "frame", "det_id").select("video_id", "frame", "det_id", "class_name")


CLUSTER_SQL = """c0 AS (SELECT analysis_job_id AS job_id, id, epoch_us(event_ts) / 1e6 AS sec, actor_uid, object_uid, confidence, row_number() OVER (PARTITION BY analysis_job_id ORDER BY event_ts, id) AS rn FROM evt),
  f AS (SELECT job_id, rn, [{'o': rn, 'a': actor_uid, 'b': object_uid, 't': sec, 'id': id, 'c': confidence}] AS cl FROM c0 WHERE rn = 1
    UNION ALL SELECT job_id, rn, CASE WHEN m IS NULL THEN list_append(cl, {'o': rn, 'a': actor_uid, 'b': object_uid, 't': sec, 'id': id, 'c': confidence})
      ELSE list_transform(cl, lambda u: CASE WHEN u.o = m.o AND confidence > u.c THEN {'o': u.o, 'a': u.a, 'b': u.b, 't': u.t, 'id': id, 'c': confidence} ELSE u END) END
    FROM (SELECT c0.*, f.cl, list_filter(f.cl, lambda u: (u.a = c0.actor_uid AND u.b = c0.object_uid) OR (u.b = c0.object_uid AND c0.sec - u.t < 86400) OR (u.a = c0.actor_uid AND c0.sec - u.t < 43200))[1] AS m
      FROM f JOIN c0 ON c0.job_id = f.job_id AND c0.rn = f.rn + 1) q),
  z AS (SELECT job_id, unnest(arg_max(cl, rn)) AS c FROM f GROUP BY job_id)"""


@query("t13_event_clusters", oracle=views.with_views(views.EVT_SQL, CLUSTER_SQL, recursive=True) + "SELECT job_id, c.t AS anchor_sec, c.id AS event_id, c.c AS confidence FROM z")
def t13(spark, sf):
    """Windows of one day and half a day, in the spacing of this data."""
    e = views.evt(spark, sf).select(F.col("analysis_job_id").alias("job_id"), F.col("id").alias("event_id"), (views.micros("event_ts") / 1e6).alias("sec"), "actor_uid", "object_uid", "confidence")
    return relations.clusters(e, "job_id", 86400.0, 43200.0)


@query("t13_split_clusters", oracle=views.with_views(views.EVT_SQL, CLUSTER_SQL, recursive=True) + "SELECT job_id, c.t AS anchor_sec, c.id AS event_id, c.c AS confidence FROM z")
def t13_split(spark, sf):
    """The same, with every job dealt over the groups of events that could share a cluster."""
    e = views.evt(spark, sf).select(F.col("analysis_job_id").alias("job_id"), F.col("id").alias("event_id"), (views.micros("event_ts") / 1e6).alias("sec"), "actor_uid", "object_uid", "confidence")
    return relations.clusters(e, "job_id", 86400.0, 43200.0, split=True)


REASONS = list(LEARNING_STEPS)


@query("t18_threshold_ratchet", oracle=f"""WITH r AS (SELECT o_custkey AS store, ({REASONS!r})[o_orderkey % {len(REASONS)} + 1] AS reason, o_orderkey AS video FROM orders),
  k AS (SELECT store, reason, count(DISTINCT video) AS videos FROM r GROUP BY 1, 2),
  s(reason, ord, cap, pos, knob, value) AS (VALUES {", ".join(f"('{r}', {ri}, {len(st)}, {i + 1}, '{kn}', CAST({v} AS DOUBLE))" for ri, (r, st) in enumerate(LEARNING_STEPS.items()) for i, d in enumerate(st) for kn, v in d.items())})
SELECT store, knob, arg_max(value, (ord, pos)) AS value FROM k JOIN s USING (reason) WHERE pos <= least(cap, videos) GROUP BY 1, 2""")
def t18(spark, sf):
    """Each video with a reason moves it one bounded step; later steps and reasons overwrite knobs."""
    from trackspark.operators import tuning
    o = views.table(spark, sf, "orders")
    names = F.array(*(F.lit(r) for r in REASONS))
    seen = o.select(F.col("o_custkey").alias("store"), F.get(names, (F.col("o_orderkey") % len(REASONS)).cast("int")).alias("reason"), F.col("o_orderkey").alias("video"))
    return tuning.learned_overrides(seen)


@query("t19_override_source", oracle="""WITH r AS (SELECT o_orderkey AS run_id, o_orderkey % 2 = 0 AS deterministic, o_orderkey % 3 = 0 AS has_pin, CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'live' WHEN 2 THEN 'off' ELSE 'pin' END AS asked FROM orders)
SELECT run_id, CASE WHEN deterministic THEN CASE WHEN asked = 'off' THEN 'none' WHEN has_pin THEN 'pin' ELSE 'none' END WHEN asked = 'off' THEN 'none' WHEN asked IS NULL THEN 'live' ELSE asked END AS mode,
  CASE CASE WHEN deterministic THEN CASE WHEN asked = 'off' THEN 'none' WHEN has_pin THEN 'pin' ELSE 'none' END WHEN asked = 'off' THEN 'none' WHEN asked IS NULL THEN 'live' ELSE asked END
    WHEN 'pin' THEN CASE WHEN has_pin THEN 4 END WHEN 'live' THEN 3 END AS min_carried_override FROM r""")
def t19(spark, sf):
    from trackspark.operators import tuning
    o = views.table(spark, sf, "orders")
    asked = F.when(F.col("o_custkey") % 4 == 1, "live").when(F.col("o_custkey") % 4 == 2, "off").when(F.col("o_custkey") % 4 == 3, "pin")
    runs = o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 2 == 0).alias("deterministic"), (F.col("o_orderkey") % 3 == 0).alias("has_pin"), asked.alias("asked"))
    mode = tuning.override_mode(F.col("deterministic"), F.col("has_pin"), F.col("asked"))
    return runs.select("run_id", mode.alias("mode"), F.when((mode == "pin") & F.col("has_pin"), 4).when(mode == "live", 3).alias("min_carried_override"))
