"""Track-shaped views over the given tables, as DataFrames and as matching SQL for the oracle.

Both sides use only arithmetic that Spark and DuckDB evaluate identically.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackspark.operators import longseq
from trackspark.session import prepare

FRAME_W, FRAME_H = 640, 480

# Every table column that decides row order, so that ties cannot change ids.
_DET_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its zone-less times are UTC, so the session must be too."""
    prepare(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def det(spark: SparkSession, sf: str) -> DataFrame:
    """One row per detected box; `det_id` is unique inside a frame of a video."""
    li = table(spark, sf, "lineitem")
    inside = Window.partitionBy("video_id", "frame").orderBy(*_DET_ORDER)
    base = li.select(
        *_DET_ORDER,
        (F.col("l_orderkey") % 16).alias("video_id"),
        F.floor(F.col("l_orderkey") / 16).alias("frame"),
        (F.col("l_partkey") % 3 == 0).alias("is_person"),
        F.when(F.col("l_returnflag") == "N", "yolo").when(F.col("l_returnflag") == "R", "color")
        .otherwise("novelty").alias("source"),
        ((F.col("l_suppkey") * 29 + F.col("l_linenumber") * 7) % 120).cast("double").alias("x1"),
        ((F.col("l_partkey") * 31) % 90).cast("double").alias("y1"),
        F.round(0.05 + F.col("l_discount") * 9, 2).alias("confidence"),
        F.when(F.col("l_partkey") % 3 == 0, "person")
        .otherwise(F.element_at(F.array(*(F.lit(c) for c in CLASSES)), (F.col("l_suppkey") % 6 + 1).cast("int")))
        .alias("class_name"),
        (F.col("l_partkey") % 40 + 1).alias("track_no"),
    )
    return base.select(
        "video_id", "frame", F.row_number().over(inside).cast("bigint").alias("det_id"), "is_person", "source",
        "class_name", "track_no", "x1", "y1", (F.col("x1") + 20 + F.col("l_quantity")).alias("x2"),
        (F.col("y1") + 20 + 2 * F.col("l_quantity")).alias("y2"), "confidence",
    )


CLASSES = ["trash_bag", "bottle", "detected_object", "color_candidate_blue", "cup", "color_candidate_red"]

DET_SQL = """det AS (
  SELECT video_id, frame, row_number() OVER (PARTITION BY video_id, frame ORDER BY l_orderkey, l_linenumber,
           l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS det_id,
         is_person, source, class_name, track_no, x1, y1, x1 + 20 + l_quantity AS x2,
         y1 + 20 + 2 * l_quantity AS y2, confidence
  FROM (SELECT *, l_orderkey % 16 AS video_id, CAST(floor(l_orderkey / 16) AS BIGINT) AS frame,
          (l_partkey % 3 = 0) AS is_person,
          CASE l_returnflag WHEN 'N' THEN 'yolo' WHEN 'R' THEN 'color' ELSE 'novelty' END AS source,
          CAST((l_suppkey * 29 + l_linenumber * 7) % 120 AS DOUBLE) AS x1,
          CAST((l_partkey * 31) % 90 AS DOUBLE) AS y1,
          round(0.05 + l_discount * 9, 2) AS confidence,
          CASE WHEN l_partkey % 3 = 0 THEN 'person' ELSE
            ['trash_bag','bottle','detected_object','color_candidate_blue','cup','color_candidate_red'][l_suppkey % 6 + 1]
          END AS class_name, l_partkey % 40 + 1 AS track_no
        FROM lineitem) t)"""


def pose(spark: SparkSession, sf: str) -> DataFrame:
    """Persons of `det` with landmark columns; a missing landmark is NULL in both coordinates."""
    return with_pose(det(spark, sf))


def with_pose(boxes: DataFrame) -> DataFrame:
    """Landmarks for the persons among `boxes`."""
    return with_pose_columns(boxes.where("is_person"))


def with_pose_columns(p: DataFrame) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")

    def mark(name: str, shown, fx: float, fy: float):
        return [F.when(shown, F.col("x1") + fx * w).alias(f"{name}_x"), F.when(shown, F.col("y1") + fy * h).alias(f"{name}_y")]

    i, f = F.col("det_id"), F.col("frame")
    return p.select(
        "*", *mark("lw", i % 3 != 0, 0.25, 0.625), *mark("rw", f % 4 != 0, 0.75, 0.625),
        *mark("ls", f % 5 != 0, 0.25, 0.25), *mark("rs", (f + i) % 3 != 0, 0.75, 0.25),
        *mark("torso", f % 7 != 0, 0.5, 0.5), *mark("nose", f % 6 != 0, 0.5, 0.125),
        ((f * 7 + i * 3) % 10 / 10.0).alias("nose_conf"),
    )


POSE_SQL = """pose AS (
  SELECT *, CASE WHEN det_id % 3 <> 0 THEN x1 + 0.25 * (x2 - x1) END AS lw_x,
    CASE WHEN det_id % 3 <> 0 THEN y1 + 0.625 * (y2 - y1) END AS lw_y,
    CASE WHEN frame % 4 <> 0 THEN x1 + 0.75 * (x2 - x1) END AS rw_x,
    CASE WHEN frame % 4 <> 0 THEN y1 + 0.625 * (y2 - y1) END AS rw_y,
    CASE WHEN frame % 5 <> 0 THEN x1 + 0.25 * (x2 - x1) END AS ls_x,
    CASE WHEN frame % 5 <> 0 THEN y1 + 0.25 * (y2 - y1) END AS ls_y,
    CASE WHEN (frame + det_id) % 3 <> 0 THEN x1 + 0.75 * (x2 - x1) END AS rs_x,
    CASE WHEN (frame + det_id) % 3 <> 0 THEN y1 + 0.25 * (y2 - y1) END AS rs_y,
    CASE WHEN frame % 7 <> 0 THEN x1 + 0.5 * (x2 - x1) END AS torso_x,
    CASE WHEN frame % 7 <> 0 THEN y1 + 0.5 * (y2 - y1) END AS torso_y,
    CASE WHEN frame % 6 <> 0 THEN x1 + 0.5 * (x2 - x1) END AS nose_x,
    CASE WHEN frame % 6 <> 0 THEN y1 + 0.125 * (y2 - y1) END AS nose_y,
    ((frame * 7 + det_id * 3) % 10) / 10.0 AS nose_conf
  FROM det WHERE is_person)"""

_POSE_COLS = ["lw_x", "lw_y", "rw_x", "rw_y", "ls_x", "ls_y", "rs_x", "rs_y", "torso_x", "torso_y"]


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every person with every object of the same frame (equi-join on video and frame)."""
    return pairs_of(pose(spark, sf), det(spark, sf).where("not is_person"))


def pairs_of(persons: DataFrame, objects: DataFrame) -> DataFrame:
    p = persons.select(
        "video_id", "frame", F.col("det_id").alias("person_id"), *(F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")),
        F.col("confidence").alias("p_conf"), *_POSE_COLS)
    o = objects.select(
        "video_id", "frame", F.col("det_id").alias("object_id"), *(F.col(c).alias(f"o_{c}") for c in ("x1", "y1", "x2", "y2")),
        F.col("confidence").alias("o_conf"), F.col("source").alias("o_source"), F.col("class_name").alias("o_class"))
    return p.join(o, ["video_id", "frame"])


PAIRS_SQL = """pairs AS (
  SELECT p.video_id, p.frame, p.det_id AS person_id, p.x1 AS p_x1, p.y1 AS p_y1, p.x2 AS p_x2, p.y2 AS p_y2,
    p.confidence AS p_conf, lw_x, lw_y, rw_x, rw_y, ls_x, ls_y, rs_x, rs_y, torso_x, torso_y,
    o.det_id AS object_id, o.x1 AS o_x1, o.y1 AS o_y1, o.x2 AS o_x2, o.y2 AS o_y2, o.confidence AS o_conf,
    o.source AS o_source, o.class_name AS o_class
  FROM pose p JOIN det o ON p.video_id = o.video_id AND p.frame = o.frame AND NOT o.is_person)"""

def micros(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def tick(spark: SparkSession, sf: str) -> DataFrame:
    """One object track per user: `frame` is the tick ordinal."""
    ev = table(spark, sf, "events")
    base = ev.select(
        F.col("user_id").alias("video_id"), "ts", "event_id",
        (F.floor(F.col("value") / 25).cast("double") * 10).alias("cx"), (F.col("event_id") % 5).cast("double").alias("cy"),
        "value", (F.col("event_type") == "error").alias("flag"))
    return longseq.with_ordinal(base, ["video_id"], ["ts", "event_id"], F.floor(micros() / 3_600_000_000), "frame")


TICK_SQL = """tick AS (
  SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame,
    ts, event_id, CAST(floor(value / 25) AS DOUBLE) * 10 AS cx, CAST(event_id % 5 AS DOUBLE) AS cy,
    value, (event_type = 'error') AS flag FROM events)"""


def gt_pred(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error"))
    return ev.select(
        F.col("user_id").alias("clip_id"), F.when(F.col("event_type") == "purchase", "gt").otherwise("pred").alias("kind"),
        "event_id", "ts", (micros() / 1e6).alias("sec"))


GT_PRED_SQL = """gt_pred AS (
  SELECT user_id AS clip_id, CASE event_type WHEN 'purchase' THEN 'gt' ELSE 'pred' END AS kind, event_id, ts,
    epoch_us(ts) / 1e6 AS sec
  FROM events WHERE event_type IN ('purchase', 'error'))"""


def clip(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), table(spark, sf, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("clip_id"), F.col("lang").alias("scenario"), (F.col("quality") == 1).alias("ground_truth"),
        (F.col("toxic") == 1).alias("predicted"), (F.col("n_chars") % 50).cast("double").alias("latency_seconds"),
        (F.col("doc_id") % 7).cast("double").alias("fps"))


CLIP_SQL = """clip AS (
  SELECT d.doc_id AS clip_id, d.lang AS scenario, (l.quality = 1) AS ground_truth, (l.toxic = 1) AS predicted,
    CAST(d.n_chars % 50 AS DOUBLE) AS latency_seconds, CAST(d.doc_id % 7 AS DOUBLE) AS fps
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def trk(spark: SparkSession, sf: str) -> DataFrame:
    """Finished track intervals."""
    o = table(spark, sf, "orders")
    start = F.col("o_orderkey") % 500
    return o.select(
        (F.col("o_custkey") % 20).alias("video_id"), F.col("o_orderkey").alias("track_id"),
        (F.col("o_orderkey") % 3 == 0).alias("is_person"), start.alias("first_frame"),
        (start + (F.col("o_custkey") * 7) % 120).alias("last_frame"),
        ((F.col("o_orderkey") * 13) % 640).cast("double").alias("cx"),
        ((F.col("o_custkey") * 17) % 360).cast("double").alias("cy"))


TRK_SQL = """trk AS (
  SELECT o_custkey % 20 AS video_id, o_orderkey AS track_id, (o_orderkey % 3 = 0) AS is_person,
    o_orderkey % 500 AS first_frame, o_orderkey % 500 + (o_custkey * 7) % 120 AS last_frame,
    CAST((o_orderkey * 13) % 640 AS DOUBLE) AS cx, CAST((o_custkey * 17) % 360 AS DOUBLE) AS cy FROM orders)"""


def evt(spark: SparkSession, sf: str) -> DataFrame:
    """Persisted events."""
    ev = table(spark, sf, "events")
    i = F.col("event_id")
    return ev.select(
        i.alias("id"), (F.col("user_id") % 8 + 1).alias("camera_id"), F.col("event_type").alias("object_type"),
        F.col("ts").alias("event_ts"), F.least(F.lit(1.0), F.col("value") / 200).alias("confidence"),
        F.when(i % 4 == 0, "confirmed").when(i % 4 == 1, "rejected").when(i % 4 == 2, "reviewing").otherwise("new").alias("status"),
        (i % 50).alias("analysis_job_id"), F.col("user_id").alias("actor_uid"), (F.col("user_id") * 10 + i % 3).alias("object_uid"),
        "props")


EVT_SQL = """evt AS (
  SELECT event_id AS id, user_id % 8 + 1 AS camera_id, event_type AS object_type, ts AS event_ts,
    least(1.0, value / 200) AS confidence,
    CASE event_id % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' WHEN 2 THEN 'reviewing' ELSE 'new' END AS status,
    event_id % 50 AS analysis_job_id, user_id AS actor_uid, user_id * 10 + event_id % 3 AS object_uid, props
  FROM events)"""


def with_views(*parts: str, recursive: bool = False) -> str:
    """A WITH clause from view texts."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


ON_DET = with_views(DET_SQL)
ON_POSE = with_views(DET_SQL, POSE_SQL)
ON_PAIRS = with_views(DET_SQL, POSE_SQL, PAIRS_SQL)
ON_TICK = with_views(TICK_SQL)
ON_EVT = with_views(EVT_SQL)
ON_TRK = with_views(TRK_SQL)
