"""Registered queries that write and read back recorded files, and that build label datasets.

Documents are written in bounded pieces (a few dozen frames, a few hundred clips), never one per table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import datasets, evaluate
from trackspark.plans import views
from trackspark.plans.metrics import METRIC_SQL
from trackspark.plans.registry import query
from trackspark.plans.review import EVIDENCE_SQL, JOBS_SQL, evidence, jobs
from trackspark.session import scratch_path
from trackspark.sources import readers, sinks

PIECE = 64
KEYS = ["video_id", "frame", "det_id"]
BOXES = ["x1", "y1", "x2", "y2"]


def tracked(spark, sf):
    return views.det(spark, sf).withColumnRenamed("track_no", "track_id")


@query("src01_frame_analysis", oracle=views.ON_DET + "SELECT video_id, frame, is_person, track_no AS track_id, class_name, confidence, x1, y1, x2, y2 FROM det")
def src01(spark, sf):
    """SNK3 writes nested frame records, SRC1 reads and flattens them."""
    path = scratch_path(spark, "frames")
    sinks.write_frames(tracked(spark, sf), path)
    return readers.frame_analysis(spark, path).drop("timestamp")


@query("snk03_frame_records", oracle=views.ON_DET + "SELECT video_id, frame AS frame_number, count(*) FILTER (WHERE is_person) AS persons, count(*) FILTER (WHERE NOT is_person) AS objects, frame / 30.0 AS timestamp FROM det GROUP BY 1, 2")
def snk03(spark, sf):
    out = sinks.frames_json(tracked(spark, sf))
    return out.select("video_id", "frame_number", F.size("persons").cast("bigint").alias("persons"), F.size("objects").cast("bigint").alias("objects"), "timestamp")


@query("src02_tick_cache", oracle="SELECT user_id AS video_id, event_id AS frame_index, value AS t_rel, CAST(1 AS BIGINT) AS n_objects FROM events WHERE event_id % 10 > 1")
def src02(spark, sf):
    """One line in ten is blank and one is broken; both are set aside."""
    e = views.table(spark, sf, "events")
    item = F.struct(F.col("event_id").alias("track_id"), F.array(F.col("value")).alias("bbox"), F.lit(0.5).alias("confidence"), F.lit("bottle").alias("class_name"), F.lit("yolo").alias("source"))
    record = F.to_json(F.struct(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_index"), F.col("value").alias("t_rel"), F.lit(0.0).alias("timestamp"), F.array(item).alias("objects")))
    path = scratch_path(spark, "ticks")
    e.select(F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 10 == 1, '{"frame_index": 1, "t_rel"').otherwise(record).alias("value")).write.text(path)
    ticks, _ = readers.tick_cache(spark, path)
    return ticks.select("video_id", "frame_index", "t_rel", F.size("objects").cast("bigint").alias("n_objects"))


@query("src03_raw_models", oracle=views.ON_DET + "SELECT 'v' || video_id || '_' || (frame // 64) AS video, frame, CASE WHEN source = 'yolo' THEN 'person_model' ELSE source END AS source, class_name, is_person, x1, y1, confidence FROM det WHERE source <> 'yolo' OR is_person")
def src03(spark, sf):
    det = views.det(spark, sf).withColumn("m", F.when(F.col("source") == "yolo", "person_model").otherwise(F.col("source")))
    box = F.struct(F.col("m").alias("model"), F.col("class_name").alias("class"), "confidence", F.array(*BOXES).alias("bbox"), "is_person")
    per_model = det.groupBy("video_id", "frame", "m").agg(F.collect_list(box).alias("boxes"))
    per_frame = per_model.groupBy("video_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("m", "boxes"))).alias("sources"))
    video = F.concat(F.lit("v"), "video_id", F.lit("_"), F.floor(F.col("frame") / PIECE))
    docs = per_frame.groupBy(video.alias("video")).agg(F.collect_list(F.struct(F.col("frame").alias("src_frame"), "sources")).alias("frames"))
    path = scratch_path(spark, "raw")
    docs.write.json(path)
    # Spark writes one document per line, which the reader of whole-file documents also takes line by line.
    rows = readers.raw_models(spark, path, multi_line=False)
    return rows.select("video", "frame", "source", "class_name", "is_person", "x1", "y1", "confidence")


@query("src04_frozen_manifest", oracle="SELECT 'c' || doc_id AS id, source AS file, CASE WHEN doc_id % 3 = 0 THEN 'NO_EVENT' ELSE 'LITTER' END AS label, CAST(n_chars % 25 AS DOUBLE) AS event_time_sec FROM documents")
def src04(spark, sf):
    d = views.table(spark, sf, "documents")
    clip = F.struct(F.concat(F.lit("c"), "doc_id").alias("id"), F.col("source").alias("file"), F.when(F.col("doc_id") % 3 == 0, "NO_EVENT").otherwise("LITTER").alias("label"),
                    (F.col("n_chars") % 25).cast("double").alias("event_time_sec"))
    path = scratch_path(spark, "manifest")
    d.groupBy(F.floor(F.col("doc_id") / 256).alias("piece")).agg(F.lit(True).alias("frozen"), F.collect_list(clip).alias("clips")).drop("piece").write.json(path)
    return readers.frozen_manifest(spark, path, multi_line=False).select("id", "file", "label", "event_time_sec")


@query("src05_clip_annotations", oracle="SELECT 'c' || d.doc_id AS clip_id, lang AS scenario, quality = 1 AS ground_truth, CASE WHEN quality = 1 THEN 'littering' ELSE 'normal' END AS folder FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def src05(spark, sf):
    """Annotations of all labelled clips in two folders, joined to the clips that exist."""
    d, lab = views.table(spark, sf, "documents"), views.table(spark, sf, "labels")
    rows = lab.join(d.select("doc_id", "lang"), "doc_id").select(F.concat(F.lit("c"), "doc_id").alias("clip_id"), F.col("lang").alias("scenario"), (F.col("quality") == 1).alias("ground_truth"))
    path = scratch_path(spark, "annotations")
    for folder, flag in (("littering", True), ("normal", False)):
        rows.where(F.col("ground_truth") == flag).write.json(f"{path}/{folder}")
    clips = d.select(F.concat(F.lit("c"), "doc_id").alias("clip_id"))
    return readers.clip_annotations(spark, path, clips).select("clip_id", "scenario", "ground_truth", "folder")


@query("src06_evaluation_reports", oracle="SELECT o_orderkey AS report_id, (o_custkey % 100) / CAST(100 AS DOUBLE) AS f1, CASE WHEN o_orderkey % 4 = 3 THEN CAST(0 AS DOUBLE) ELSE (o_custkey % 7) / CAST(10 AS DOUBLE) END AS fpr FROM orders")
def src06(spark, sf):
    """Four report shapes: nested twice, nested once, flat, and flat with other names and no rate."""
    o = views.table(spark, sf, "orders")
    f1, fpr = (F.col("o_custkey") % 100 / 100.0).cast("string"), (F.col("o_custkey") % 7 / 10.0).cast("string")
    flat = F.concat(F.lit('{"f1": '), f1, F.lit(', "fpr": '), fpr, F.lit("}"))
    shape = F.col("o_orderkey") % 4
    doc = F.when(shape == 0, F.concat(F.lit('{"report": {"aggregate": '), flat, F.lit("}}"))).when(shape == 1, F.concat(F.lit('{"aggregate": '), flat, F.lit("}"))).when(
        shape == 2, flat).otherwise(F.concat(F.lit('{"f1_score": '), f1, F.lit("}")))
    return readers.evaluation_reports(o.select(F.col("o_orderkey").alias("report_id"), doc.alias("doc"))).select("report_id", "f1", "fpr")


@query("src07_verdict_samples", oracle="""SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN 'crop_' || o_orderkey || '.jpg' WHEN o_orderkey % 3 = 1 THEN 'waste.jpg' END AS image
  FROM orders WHERE o_orderkey % 3 < 2 AND o_custkey % 5 <> 0""")
def src07(spark, sf):
    o = views.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    named = F.concat(F.lit("crop_"), k, F.lit(".jpg"))
    verdicts = o.select(k.alias("event_id"), k.cast("string").alias("folder"), named.alias("train_image"))
    files = F.array_compact(F.array(F.when(k % 3 == 0, named), F.when(k % 3 <= 1, F.lit("waste.jpg")), F.when(k % 3 <= 1, F.lit("object.jpg")), F.when(F.col("o_custkey") % 5 != 0, F.lit("labels.txt"))))
    listing = o.select(k.cast("string").alias("folder"), F.explode(files).alias("name"))
    return readers.verdict_samples(verdicts, listing).select("event_id", "image")


@query("src08_label_lines", oracle=views.ON_DET + "SELECT video_id, frame, det_id, CAST(det_id % 5 AS INTEGER) AS class_id, x1 AS cx, y1 AS cy, confidence AS w FROM det WHERE det_id % 4 <> 3")
def src08(spark, sf):
    """Every fourth box has a malformed line: too short, or not numeric."""
    det = views.det(spark, sf)
    fields = [(F.col("det_id") % 5).cast("string"), *(F.col(c).cast("string") for c in ("x1", "y1", "confidence"))]
    value = F.when(F.col("det_id") % 8 == 3, "1 0.5 0.5").when(F.col("det_id") % 8 == 7, "x a b c d").otherwise(F.concat_ws(" ", *fields, F.lit("0.1")))
    return readers.label_lines(det.select(*KEYS, value.alias("value"))).select(*KEYS, "class_id", "cx", "cy", "w")


@query("src09_coco", oracle=views.ON_DET + "SELECT video_id * 1000000000 + frame AS image_id, CAST(640 AS INTEGER) AS width, class_name, x1 AS x, y1 AS y, x2 - x1 AS w FROM det")
def src09(spark, sf):
    det = views.det(spark, sf).withColumn("image", F.col("video_id") * 1_000_000_000 + F.col("frame")).withColumn("piece", F.concat_ws("_", "video_id", F.floor(F.col("frame") / PIECE)))
    names = ["person", *views.CLASSES]
    category = F.array_position(F.array(*(F.lit(n) for n in names)), F.col("class_name")).cast("int")
    ann = F.struct(F.col("det_id").alias("id"), F.col("image").alias("image_id"), category.alias("category_id"), F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"))
    image = F.struct(F.col("image").alias("id"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    cats = F.array(*(F.struct(F.lit(i + 1).alias("id"), F.lit(n).alias("name")) for i, n in enumerate(names)))
    docs = det.groupBy("piece").agg(F.collect_set(image).alias("images"), F.collect_list(ann).alias("annotations")).withColumn("categories", cats)
    path = scratch_path(spark, "coco")
    docs.write.json(path)
    rows = readers.coco(spark, path, multi_line=False)
    return rows.select("image_id", "width", "class_name", F.col("bbox")[0].alias("x"), F.col("bbox")[1].alias("y"), F.col("bbox")[2].alias("w"))


@query("src10_event_relation", oracle=views.ON_EVT + "SELECT id, status, CASE WHEN id % 2 = 0 THEN actor_uid END AS actor_uid FROM evt")
def src10(spark, sf):
    """Two generations of the events table; the older one lacks a column that was added later."""
    e = views.evt(spark, sf)
    path = scratch_path(spark, "events")
    e.where("id % 2 = 0").select("id", "status", "actor_uid").write.parquet(f"{path}/gen=2")
    e.where("id % 2 = 1").select("id", "status").write.parquet(f"{path}/gen=1")
    return readers.relation(spark, path).select("id", "status", "actor_uid")


KNOB_LINES = ["MIN_CARRIED_FRAMES", "analysis_fps", "NOVELTY_MIN_AREA", "min_carryd_frames", "Smoothing_Window"]


@query("src11_threshold_lines", oracle=f"""SELECT p_partkey, lower(k) AS key, CAST(p_size AS VARCHAR) AS value, CASE WHEN p_partkey % 5 IN (0, 1, 4) THEN 'knob' WHEN p_partkey % 5 = 2 THEN 'novelty' ELSE 'unknown' END AS kind
  FROM (SELECT p_partkey, p_size, ({KNOB_LINES!r})[p_partkey % 5 + 1] AS k FROM part) t WHERE p_partkey % 7 > 1""")
def src11(spark, sf):
    p = views.table(spark, sf, "part")
    k = F.get(F.array(*(F.lit(x) for x in KNOB_LINES)), (F.col("p_partkey") % 5).cast("int"))
    line = F.concat(k, F.lit(": "), F.col("p_size").cast("string"), F.lit("  # note: kept"))
    text = F.when(F.col("p_partkey") % 7 == 0, "# only a comment: 1").when(F.col("p_partkey") % 7 == 1, F.concat(F.lit("  - "), line)).otherwise(line)
    lines = p.select("p_partkey", text.alias("value"))
    ok = readers.threshold_lines(lines, keep=["p_partkey"])
    return ok


@query("src12_learning_snapshot", oracle="SELECT s_suppkey AS store, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 2 ELSE 0 END AS videos_analyzed, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 4 AS INTEGER) END AS carried_step FROM supplier")
def src12(spark, sf):
    s = views.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    doc = F.when(k % 3 == 0, F.concat(F.lit('{"videos_analyzed": '), k * 2, F.lit(', "step_index": {"NOT_ENOUGH_CARRIED_FRAMES": '), k % 4, F.lit("}}"))).when(k % 3 == 1, "{broken")
    snap = readers.learning_snapshot(s.select(k.alias("store"), doc.alias("doc")))
    return snap.select("store", "videos_analyzed", F.try_element_at("step_index", F.lit("NOT_ENOUGH_CARRIED_FRAMES")).alias("carried_step"))


@query("snk01_accept_events", oracle=views.ON_EVT + "SELECT camera_id, camera_id <= 6 AS accepted, count(*) AS n, count(*) FILTER (WHERE id % 5 = 0 AND camera_id <= 6) AS defaulted FROM evt GROUP BY 1, 2")
def snk01(spark, sf):
    """Six of the eight cameras are known; one event in five has no time."""
    e = views.evt(spark, sf).select("id", "camera_id", F.when(F.col("id") % 5 != 0, F.col("event_ts")).alias("ts"))
    cameras = e.select("camera_id").distinct().where("camera_id <= 6")
    now = F.lit("2030-01-01").cast("timestamp_ntz")
    good, bad = sinks.accept_events(e, cameras, now)
    path = scratch_path(spark, "accepted")
    sinks.append(good, path, ["camera_id"])
    back = readers.relation(spark, path).select("id", F.col("camera_id").cast("bigint").alias("camera_id"), "ts", F.lit(True).alias("accepted"))
    return back.unionByName(bad.select("id", "camera_id", "ts", F.lit(False).alias("accepted"))).groupBy("camera_id", "accepted").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") == now).alias("defaulted"))


@query("snk02_event_metadata", oracle="SELECT o_custkey AS event_id, max(o_orderkey) AS version, max(o_orderkey) % 2 = 0 AS finalized, arg_max(o_totalprice, o_orderkey) AS duration_seconds FROM orders GROUP BY 1")
def snk02(spark, sf):
    o = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("version"), (F.col("o_orderkey") % 2 == 0).alias("finalized"), F.col("o_totalprice").alias("duration_seconds"))
    return sinks.latest_metadata(o)


@query("snk02_metadata_files", oracle="SELECT o_custkey AS event_id, max(o_orderkey) AS version, max(o_orderkey) % 2 = 0 AS finalized, arg_max(o_totalprice, o_orderkey) AS duration_seconds FROM orders GROUP BY 1")
def snk02_files(spark, sf):
    """Drafts are written first, final versions after them, one of the writes twice; the last version is read back."""
    o = views.table(spark, sf, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("version"), (F.col("o_orderkey") % 2 == 0).alias("finalized"), F.col("o_totalprice").alias("duration_seconds"))
    path = scratch_path(spark, "metadata")
    for epoch, rows in ((0, o.where(~F.col("finalized"))), (1, o.where("finalized")), (1, o.where("finalized"))):
        sinks.write_metadata(rows, path, epoch)
    return sinks.latest_metadata(spark.read.schema(o.schema).json(path).drop("epoch"))


@query("snk04_appended_crops", oracle=views.ON_DET + "SELECT video_id, frame, det_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame % 7, frame, det_id) AS r FROM det WHERE NOT is_person) t WHERE r <= 40")
def snk04_append(spark, sf):
    """Crops come in seven rounds, the first of them twice; a video's folder fills up to forty and then takes no more."""
    det = views.det(spark, sf).where(~F.col("is_person")).select(*KEYS)
    path = scratch_path(spark, "crops")
    for r in (0, 0, 1, 2, 3, 4, 5, 6):
        sinks.append_crops(det.where(F.col("frame") % 7 == r), path, "video_id", ["frame", "det_id"], 40)
    return spark.read.schema(det.schema).parquet(f"{path}/crops")


@query("snk04_training_crops", oracle=views.ON_DET + "SELECT video_id, frame, det_id FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame, det_id) AS r FROM det WHERE NOT is_person) t WHERE r <= 40")
def snk04(spark, sf):
    return sinks.capped_crops(views.det(spark, sf).where(~F.col("is_person")).select(*KEYS), "video_id", ["frame", "det_id"], 40)


@query("snk05_evaluation_report", oracle=views.with_views(views.CLIP_SQL, METRIC_SQL) + "SELECT scope, n, round(f1, 9) AS f1 FROM metric")
def snk05(spark, sf):
    """The report is written as one document and read back by path."""
    doc = sinks.report_document(evaluate.clip_metrics(views.clip(spark, sf)))
    path = scratch_path(spark, "report")
    doc.write.text(path)
    back = spark.read.text(path)
    parsed = F.from_json("value", "aggregate struct<n: bigint, f1: double>, per_scenario map<string, struct<n: bigint, f1: double>>")
    rows = back.select(F.explode(F.map_concat(F.create_map(F.lit("ALL"), parsed["aggregate"]), parsed["per_scenario"])).alias("scope", "m"))
    return rows.select("scope", "m.n", F.round("m.f1", 9).alias("f1"))


@query("snk06_audit_table", oracle=views.ON_DET + "SELECT video_id, source, count(*) AS n FROM det GROUP BY 1, 2")
def snk06(spark, sf):
    path = scratch_path(spark, "audit")
    sinks.write_audit(views.det(spark, sf).groupBy("video_id", "source").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("video_id bigint, source string, n bigint").option("header", "true").csv(f"{path}/csv")


@query("snk06_audit_markdown", oracle=views.ON_DET + "SELECT video_id, source, count(*) AS n, max(class_name || '|' || source) AS last FROM det GROUP BY 1, 2")
def snk06_markdown(spark, sf):
    """One Markdown table per video, written and read back; cells with a bar survive."""
    table = views.det(spark, sf).groupBy("video_id", "source").agg(F.count(F.lit(1)).alias("n"), F.max(F.concat_ws("|", "class_name", "source")).alias("last"))
    path = scratch_path(spark, "markdown")
    sinks.write_markdown(table, "video_id", ["source"], path)
    cells = F.split(F.col("value"), r" \| |^\| | \|$")
    rows = spark.read.schema("value string, video_id bigint").text(path).where("value NOT LIKE '| source |%' AND value NOT LIKE '| --- |%'")
    return rows.select("video_id", cells[1].alias("source"), cells[2].cast("bigint").alias("n"), F.regexp_replace(cells[3], r"\\([\\|])", "$1").alias("last"))


@query("snk08_pin_overwrite", oracle="SELECT s_suppkey AS store, CAST(s_suppkey % 9 AS DOUBLE) + 2 AS value, CAST(3 AS BIGINT) AS promotions, CAST(s_suppkey % 9 AS DOUBLE) AS first_value FROM supplier")
def snk08_pin(spark, sf):
    """Three promotions: the pin is the last one, the log has them all."""
    s = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store"), (F.col("s_suppkey") % 9).cast("double").alias("value"))
    path = scratch_path(spark, "pins")
    for i in range(3):
        sinks.promote(s.withColumn("value", F.col("value") + i), F.timestamp_seconds(F.lit(i)), path)
    log = readers.relation(spark, f"{path}/log").groupBy("store").agg(F.count(F.lit(1)).alias("promotions"), F.min_by("value", "promoted_at").alias("first_value"))
    return readers.relation(spark, f"{path}/pin").join(log, "store").select("store", "value", "promotions", "first_value")


@query("snk07_label_files", oracle=views.ON_DET + """, im AS (SELECT DISTINCT video_id, frame FROM det), l AS (SELECT video_id, frame, (det_id % 8) || ' ' || printf('%.6f', round_even((x1 + x2) / 2.0 / 640, 6)) || ' ' || printf('%.6f', round_even((y1 + y2) / 2.0 / 480, 6)) || ' ' || printf('%.6f', round_even((x2 - x1) / 640, 6)) || ' ' || printf('%.6f', round_even((y2 - y1) / 480, 6)) AS line
  FROM det WHERE NOT is_person) SELECT video_id, frame, coalesce((SELECT string_agg(line, chr(10) ORDER BY line) FROM l WHERE l.video_id = im.video_id AND l.frame = im.frame), '') AS text FROM im""")
def snk07(spark, sf):
    det = views.det(spark, sf)
    from trackspark.functions import geom
    n = geom.yolo_normalised(geom.box(), 640, 480)
    rows = det.where(~F.col("is_person")).select("video_id", "frame", (F.col("det_id") % 8).alias("class_id"), *(c.alias(a) for c, a in zip(n, ("cx", "cy", "w", "h"))))
    return sinks.label_files(det.select("video_id", "frame").distinct(), rows, ["video_id", "frame"])


@query("snk08_promotion_log", oracle="SELECT s_suppkey AS store, CAST(s_suppkey % 9 AS DOUBLE) AS value, CAST(1 AS INTEGER) AS pin_schema FROM supplier")
def snk08(spark, sf):
    s = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("store"), (F.col("s_suppkey") % 9).cast("double").alias("value"))
    path = scratch_path(spark, "promotions")
    sinks.append(sinks.pinned_snapshot(s, F.current_timestamp()), path)
    return readers.relation(spark, path).select("store", "value", "pin_schema")


@query("snk09_job_manifest", oracle=views.with_views(views.EVT_SQL, EVIDENCE_SQL, JOBS_SQL) + """, a AS (SELECT event_id, max(image_path) AS snapshot FROM evidence GROUP BY 1),
  e AS (SELECT analysis_job_id AS job_id, count(*) AS n, count(snapshot) AS with_snapshot FROM evt LEFT JOIN a ON a.event_id = evt.id WHERE status = 'confirmed' AND analysis_job_id % 3 <> 0 GROUP BY 1)
SELECT j.job_id, coalesce(n, 0) AS events_count, coalesce(with_snapshot, 0) AS with_snapshot, CASE WHEN coalesce(n, 0) > 0 THEN 'LITTERING_EVENT_CANDIDATE' ELSE 'NO_EVENT' END AS final_result FROM jobs j LEFT JOIN e USING (job_id)""")
def snk09(spark, sf):
    e = views.evt(spark, sf).where((F.col("status") == "confirmed") & (F.col("analysis_job_id") % 3 != 0)).select(F.col("analysis_job_id").alias("job_id"), F.col("id").alias("event_id"), "confidence")
    art = evidence(spark, sf).groupBy("event_id").agg(F.max("image_path").alias("snapshot"), F.max("video_path").alias("clip"))
    """The events of a job are written as lines below the job's folder, read again, and counted against the head."""
    head, lines = sinks.job_manifest(jobs(spark, sf).select("job_id"), e, art)
    path = scratch_path(spark, "snk09")
    sinks.write_manifest(lines, path)
    back = spark.read.schema("event_id bigint, confidence double, snapshot string, clip string, job_id bigint").json(path)
    shown = back.groupBy("job_id").agg(F.count("snapshot").alias("with_snapshot"))
    return head.join(shown, "job_id", "left").na.fill(0, ["with_snapshot"]).select("job_id", "events_count", "with_snapshot", "final_result")


SPLIT_SQL = "CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('#', {item}, '{seed}')), {item}) <= greatest(1, floor(count(*) OVER () * 0.8)) THEN 'train' ELSE 'val' END"


def mix_sql(pool: str, ratio: float) -> str:
    return f"""WITH s AS (SELECT o_orderkey AS image, {pool} AS pool FROM orders), q AS (SELECT least(400, greatest(1, count(*))) AS target, count(*) FILTER (pool = 'replay') AS old FROM s),
  n AS (SELECT target, CASE WHEN old = 0 THEN target ELSE round_even(target * {ratio}, 0) END AS n_new FROM q),
  r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY md5(concat_ws('#', image, '7')), image) AS rn FROM s),
  p AS (SELECT image, min(pool) AS pool FROM r, n WHERE rn <= CASE WHEN pool = 'new' THEN n_new ELSE target - n_new END GROUP BY image)
SELECT image, pool, {SPLIT_SQL.format(item='image', seed=7)} AS split FROM p"""


@query("u04_replay_mix", oracle=mix_sql("CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'replay' END", 0.50125))
def u04(spark, sf):
    """The quota of new samples is 200.5 of 400, which rounds to even."""
    o = views.table(spark, sf, "orders")
    samples = o.select(F.col("o_orderkey").alias("image"), F.when(F.col("o_orderkey") % 3 == 0, "new").otherwise("replay").alias("pool"))
    return datasets.replay_mix(samples, 0.50125, 7, 400)


@query("u04_mix_without_replay", oracle=mix_sql("'new'", 0.5))
def u04_new(spark, sf):
    """No replay pool yet: the new one fills the target."""
    return datasets.replay_mix(views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"), F.lit("new").alias("pool")), 0.5, 7, 400)


@query("u08_seeded_split", oracle=f"SELECT doc_id, {SPLIT_SQL.format(item='doc_id', seed=42)} AS split FROM documents")
def u08(spark, sf):
    return datasets.seeded_split(views.table(spark, sf, "documents").select("doc_id"), "doc_id", 42)


@query("u05_merged_dataset", oracle=views.ON_DET + """, m AS (SELECT video_id, frame, count(*) AS n FROM det WHERE class_name IN ('trash_bag', 'bottle', 'cup') GROUP BY 1, 2) SELECT i.video_id, i.frame, coalesce(n, 0) AS labels FROM (SELECT DISTINCT video_id, frame FROM det) i LEFT JOIN m USING (video_id, frame)""")
def u05(spark, sf):
    det = views.det(spark, sf)
    mapped = datasets.remap(det, {"trash_bag": 4, "bottle": 1, "cup": 2})
    return datasets.merged_counts(det.select("video_id", "frame").distinct(), mapped, ["video_id", "frame"])


@query("u07_distinct_configs", oracle="SELECT p_brand AS a, p_size % 5 AS b, min(p_partkey) AS ordinal FROM part GROUP BY 1, 2")
def u07(spark, sf):
    p = views.table(spark, sf, "part").select(F.col("p_brand").alias("a"), (F.col("p_size") % 5).alias("b"), F.col("p_partkey").alias("ordinal"))
    return datasets.distinct_configs(p, ["a", "b"])


@query("a24_class_distribution", oracle=views.ON_DET + """, l AS (SELECT source AS dataset, CASE WHEN frame % 5 = 0 THEN 'val' ELSE 'train' END AS split, CAST(det_id % 8 AS INTEGER) AS class_id, video_id * 1000000000 + frame AS image_id FROM det)
SELECT coalesce(dataset, 'ALL') AS dataset, coalesce(split, 'ALL') AS split, coalesce(class_id, -1) AS class_id, count(*) AS instances, count(DISTINCT image_id) AS images, CAST(grouping(dataset, split, class_id) AS INTEGER) AS level FROM l GROUP BY ROLLUP (dataset, split, class_id)""")
def a24(spark, sf):
    det = views.det(spark, sf)
    rows = det.select(F.col("source").alias("dataset"), F.when(F.col("frame") % 5 == 0, "val").otherwise("train").alias("split"), (F.col("det_id") % 8).cast("int").alias("class_id"),
                      (F.col("video_id") * 1_000_000_000 + F.col("frame")).alias("image_id"))
    return datasets.distribution(rows)


@query("f11_label_area", oracle=views.ON_DET + """, b AS (SELECT *, (x2 - x1) * (y2 - y1) / (150.0 * 120.0) AS s FROM det WHERE NOT is_person) SELECT video_id, frame, count(*) AS boxes FROM b WHERE s BETWEEN 0.01 AND 0.70 GROUP BY 1, 2""")
def f11(spark, sf):
    """Usable boxes per image; an image with none is dropped."""
    b = views.det(spark, sf).where(~F.col("is_person")).withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1"), "image_w": F.lit(150.0), "image_h": F.lit(120.0)})
    return datasets.usable_boxes(b).groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("boxes"))


@query("l08_prioritised_images", oracle=views.ON_DET + ", i AS (SELECT video_id, frame, bool_or(class_name = 'trash_bag') AS bag FROM det GROUP BY 1, 2) SELECT video_id, frame, bag FROM i ORDER BY CASE WHEN bag THEN 0 ELSE 1 END, video_id, frame LIMIT 500")
def l08(spark, sf):
    i = views.det(spark, sf).groupBy("video_id", "frame").agg(F.bool_or(F.col("class_name") == "trash_bag").alias("bag"))
    return datasets.prioritised(i, F.col("bag"), ["video_id", "frame"], 500)
