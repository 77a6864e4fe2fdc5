"""Person-object observations per tick, as columns: what the pair state machine consumes.

Everything that does not depend on the machine's own state is computed here, natively: admission,
identities, motion windows, the frame join, geometry and flags. Configs are joined as rows, so a
sweep repeats the cheap flags but not the scans, windows or the frame join.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.config import Thresholds
from trackspark.functions import geom, labels, pose
from trackspark.functions.geom import Point
from trackspark.operators import calibrate, gathering

CLIP = ["video_id", "session"]
MARKS = ["lw_x", "lw_y", "rw_x", "rw_y", "torso_x", "torso_y"]
# Only the pose blend needs shoulders; boxes without these columns have none.
SHOULDERS = ["ls_x", "ls_y", "rs_x", "rs_y"]

# Knobs that shape the columns below; all others are read by the state machine.
FEATURE_KNOBS = ["near_distance_ratio", "departure_distance_ratio", "association_radius_ratio", "stationary_distance_ratio",
                 "carry_motion_norm_px", "carry_motion_sync_ratio", "bag_move_norm", "ground_plane_margin_ratio",
                 "aidm_wrist_attach_ratio", "carrying_zone_vertical_start", "carrying_zone_horizontal_margin", "detection_high_conf", "analysis_fps",
                 "pose_score_blend", "pose_weight_wrist", "pose_weight_zone", "pose_weight_motion", "pose_wrist_norm_ratio", "pose_zone_horizontal_margin",
                 "pose_zone_vertical_above", "pose_zone_vertical_below", "pose_motion_norm_px"]


def with_knobs(frames: DataFrame, configs: Mapping[str, Thresholds], some: bool) -> DataFrame:
    """Each row under each config (`some`: it names its `config_id` already), with the feature knobs as columns.

    The configs are a handful, written into the query: rows stay where they are, and in order. A knob that is the same in all
    of them is a plain number, so what does not depend on the config is not computed at all.
    """
    def cap(c: Thresholds) -> float:
        return float(c.stationary_max_pixel_step if c.stationary_max_pixel_step is not None else 1e18)

    def knob(value: Callable[[Thresholds], object]) -> Column:
        values = {name: value(c) for name, c in configs.items()}
        first, *others = dict.fromkeys(values.values())
        return reduce(lambda rest, v: F.when(F.col("config_id").isin([n for n, has in values.items() if has == v]), F.lit(v)).otherwise(rest), others, F.lit(first))

    listed = frames if some else frames.select("*", F.inline(F.array(*(F.struct(F.lit(n).alias("config_id")) for n in configs))))
    return listed.select("*", *(knob(lambda c, k=k: float(getattr(c, k))).alias(k) for k in FEATURE_KNOBS), knob(cap).alias("still_cap"), knob(lambda c: bool(c.auto_calibrate)).alias("auto_calibrate"),
                         knob(lambda c: int(c.calibration_frames)).alias("calibration_frames"), knob(lambda c: bool(c.pose_association_enabled)).alias("pose_association_enabled"))


def admitted(boxes: DataFrame, low_conf: float) -> DataFrame:
    """confident persons, and confident objects that may start an event."""
    ok = F.col("is_person") | labels.is_semantic(F.col("source"), F.col("class_name"))
    return boxes.where((F.col("confidence") >= low_conf) & ok)


SIDES = ["x1", "y1", "x2", "y2"]
PERSON_PART = {"p_track": "track_id", "p_uid": "uid", "p_step": "step", "p_pose_step": "pose_step", **{m: m for m in (*MARKS, *SHOULDERS)}, **{f"p_{s}": s for s in SIDES}}
OBJECT_PART = {"o_track": "track_id", "o_uid": "uid", "o_step": "step", "o_pose_step": "pose_step", "o_moved": "moved", "o_conf": "confidence", "o_class": "class_name", "o_source": "source",
               "in_zone": "in_zone", **{f"o_{s}": s for s in SIDES}}


def with_geometry(parts: DataFrame) -> DataFrame:
    """Threshold-free geometry of the pairs; pairs whose object is too big to carry are dropped."""
    pb, ob, lw, rw = geom.box("p_"), geom.box("o_"), geom.point("lw"), geom.point("rw")
    w, h = geom.width(ob), geom.height(ob)
    sized = ~((w * h > 0.40 * F.greatest(F.lit(1.0), geom.floored_area(pb))) | (w > 1.15 * geom.width(pb)) | (h > 0.80 * geom.height(pb)) | (w * h > 65000))
    d = geom.distance(geom.centroid(pb), geom.centroid(ob))
    return parts.where((F.col("kind") != 3) | sized).select(
        "*", geom.height(pb).alias("ph"), d.alias("distance"), (d / geom.height(pb)).alias("norm"), geom.overlap_of_object(pb, ob).alias("contained"),
        (pose.wrist_distance(ob, lw, rw) / geom.height(pb)).alias("wrist_h"), pose.wrist_ratio(pb, ob, lw, rw).alias("wrist_d"))


def still(moved: Column, b: geom.Box) -> Column:
    size = F.greatest(F.lit(1.0), geom.height(b), geom.width(b))
    return F.coalesce((moved / size < F.col("stationary_distance_ratio")) & (moved <= F.col("still_cap")), F.lit(False))


def flagged(pairs: DataFrame) -> DataFrame:
    """Flags and score of each pair under the config knobs present as columns."""
    k = F.col
    pb, ob = geom.box("p_"), geom.box("o_")
    pc, oc, h, w = geom.centroid(pb), geom.centroid(ob), geom.height(pb), geom.width(pb)
    zone = oc.y.between(pb.y1 + h * k("carrying_zone_vertical_start"), pb.y2 - h * 0.05) & oc.x.between(
        pb.x1 - w * k("carrying_zone_horizontal_margin"), pb.x2 + w * k("carrying_zone_horizontal_margin"))
    out = pairs.withColumn("zone", zone).withColumn("near", (k("norm") <= k("near_distance_ratio")) | (k("contained") >= 0.25) | k("zone"))
    reach = k("near") | (k("norm") >= k("departure_distance_ratio")) | (k("contained") > 0) | (k("norm") <= k("association_radius_ratio"))
    out = out.where((k("kind") != 3) | reach).withColumn("wrist_seen", k("wrist_h").isNotNull()).withColumn("wrist_near", F.coalesce(
        (k("wrist_h") <= k("near_distance_ratio")) | (k("wrist_d") <= k("aidm_wrist_attach_ratio")), F.lit(False)))
    out = out.withColumn("still", still(k("o_moved"), ob)).withColumn("walking", F.coalesce(k("p_step") > k("carry_motion_norm_px"), F.lit(False)))
    follows = ~k("still") & F.coalesce(k("o_step") >= k("carry_motion_sync_ratio") * k("p_step"), F.lit(False))
    out = out.withColumn("together", F.when(k("walking"), follows).otherwise(~(k("still") & ~k("wrist_near"))))
    out = out.withColumn("below_feet", oc.y >= pb.y2 - k("bag_move_norm") * h).withColumn("on_ground", oc.y >= pb.y2 - k("ground_plane_margin_ratio") * h)
    held_in_zone = k("zone") & ~k("below_feet") & ~k("on_ground") & ~(k("wrist_seen") & ~k("wrist_near")) & ~(k("still") & ~k("wrist_near"))
    carried = (k("wrist_near") | held_in_zone) & (k("norm") <= k("near_distance_ratio") * 1.5) & k("together")
    proximity = F.greatest(F.lit(0.0), 1.0 - k("norm") / F.greatest(k("near_distance_ratio") * 2.0, F.lit(1e-6)))
    score = 0.55 * proximity + 0.25 * k("contained") + 0.20 * F.least(F.lit(1.0), k("o_conf") / F.greatest(k("detection_high_conf"), F.lit(1e-6)))
    knobs = SimpleNamespace(**{name: k(name) for name in FEATURE_KNOBS})
    top = pose.shoulder_line(geom.point("ls"), geom.point("rs"), geom.point("torso"))
    body = pose.pose_score(pb, ob, geom.point("lw"), geom.point("rw"), top, k("p_pose_step"), k("o_pose_step"), knobs)
    blend = F.greatest(F.lit(0.0), F.least(F.lit(1.0), k("pose_score_blend")))
    score = F.when(k("pose_association_enabled") & (k("pose_score_blend") > 0) & body.isNotNull(), (1.0 - blend) * score + blend * body).otherwise(score)
    return out.withColumn("carried", carried).withColumn("score", score).withColumn("pcx", pc.x).withColumn("pcy", pc.y).withColumn("ocx", oc.x).withColumn("ocy", oc.y)


# Who is present, on tick rows: person uids, object track ids, and whether each object rests.
PRESENCE = ["people", "things", "resting"]

# Columns of one observation, in the order the state machine unpacks them.
FLAGS = ["near", "carried", "still", "walking", "together", "wrist_near", "wrist_seen", "below_feet", "on_ground", "in_zone", "fallback"]
FIELDS = ["p_track", "p_uid", "o_track", "o_uid", "o_class", "distance", "norm", "contained", "score", "ph", "pcx", "pcy", "ocx", "ocy", "o_conf", "wrist_d", *FLAGS]


def tick_rows(boxes: DataFrame, ticks: DataFrame, configs: Mapping[str, Thresholds], assignment: DataFrame | None = None,
              min_conf: float = 0.10) -> DataFrame:
    """Rows for the pair fold, by `kind`: 0 a tick and who is present in it, 3 a pair observed.

    `boxes`: video_id, session, frame (tick ordinal), det_id, track_id, is_person, source, class_name,
    x1..y2, confidence, landmarks, in_zone. `ticks`: video_id, session, frame, ts. `assignment`
    (video_id, config_id) limits which configs run on which video; by default every config runs on
    every video (J18). A sweep repeats pairing and flags, but not identities, windows or gathering.

    Boxes meet their ticks and their session's configs in one shuffle by session (`gathering.observations`), whose order is kept: a
    task's rows come session by session and tick by tick.
    """
    windows = sorted({(c.stationary_window_frames, c.pose_motion_window) for c in configs.values()})
    if len(windows) > 1:
        parts = [tick_rows(boxes, ticks, {n: c for n, c in configs.items() if (c.stationary_window_frames, c.pose_motion_window) == w}, assignment, min_conf) for w in windows]
        return reduce(DataFrame.unionByName, parts)
    for mark in set(SHOULDERS) - set(boxes.columns):
        boxes = boxes.withColumn(mark, F.lit(None).cast("double"))
    depths = sorted({c.calibration_frames for c in configs.values() if c.auto_calibrate})
    sure, assigned = admitted(boxes, min_conf), None
    if assignment is not None:
        # One row per session, for those with boxes only as well.
        clips = ticks.select(*CLIP).unionByName(sure.select(*CLIP)).distinct()
        named = F.array_intersect(F.array(*(F.lit(n) for n in configs)), F.collect_list("config_id"))
        assigned = clips.join(assignment.groupBy("video_id").agg(named.alias("configs")), "video_id")
    # What only the pose blend reads is not carried along where no config blends.
    spare = {} if any(c.pose_association_enabled for c in configs.values()) else dict.fromkeys(["p_pose_step", "o_pose_step", "torso_x", "torso_y", *SHOULDERS], F.lit(None).cast("double"))
    person_part, object_part = ({name: c for name, c in part.items() if name not in spare} for part in (PERSON_PART, OBJECT_PART))
    rows = gathering.observations(sure, ticks, CLIP, person_part, object_part, ["moved", *SIDES], *windows[0], depths, assigned).withColumns(spare)
    tuned = with_knobs(rows, configs, assignment is not None)
    scene_departure = F.lit(-1.0)
    if depths:
        late = F.col("auto_calibrate") & (F.col("at") >= F.col("calibration_frames") - 1)
        h, s = (reduce(lambda rest, d: F.when(F.col("calibration_frames") == d, F.col(f"{name}_{d}")).otherwise(rest), depths, F.lit(None).cast("double")) for name in ("med_h", "med_step"))
        tuned = tuned.withColumn("_scene_h", F.when(late, h)).withColumn("_scene_step", F.when(late, s))
        h, s = F.col("_scene_h"), F.col("_scene_step")
        tuned = tuned.withColumn("carry_motion_norm_px", F.when(late, calibrate.carry_threshold(h, s, F.col("carry_motion_norm_px"))).otherwise(F.col("carry_motion_norm_px")))
        scene_departure = F.coalesce(F.when(late, calibrate.departure_threshold(h, s, F.col("analysis_fps"))), scene_departure)
    tuned = tuned.withColumn("scene_departure", scene_departure).drop(
        "auto_calibrate", "calibration_frames", "at", "_scene_h", "_scene_step", *(f"{name}_{d}" for name in ("med_h", "med_step") for d in depths))
    tuned = tuned.withColumn("resting", F.when(F.col("kind") == 0, F.transform("rests", lambda o: still(o["moved"], geom.box_of(o))))).drop("rests")
    seen = flagged(with_geometry(tuned)).withColumn("fallback", F.col("o_source") != "yolo")
    # A tick row carries the scene's departure ratio in `norm` once it is known, -1 before.
    empty = {**{f: F.lit(0).cast("bigint") for f in ("p_track", "p_uid", "o_track", "o_uid")}, "o_class": F.lit(""),
             **{f: F.lit(0.0) for f in FIELDS[5:16]}, **{f: F.lit(False) for f in FLAGS}}
    filled = {f: F.coalesce(F.col(f), empty[f]) for f in FIELDS}
    filled["norm"] = F.when(F.col("kind") == 0, F.col("scene_departure")).otherwise(filled["norm"])
    filled["wrist_d"] = F.coalesce(F.col("wrist_d"), F.lit(-1.0))
    return seen.select(*CLIP, "config_id", "frame", "kind", "ts", *PRESENCE, *(filled[f].alias(f) for f in FIELDS))
