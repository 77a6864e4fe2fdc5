"""Observations gathered in one pass equal the column forms of motion and calibration."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F
from test_growth import explained

from trackspark.functions import geom
from trackspark.functions.geom import Point
from trackspark.operators import calibrate, features, gathering, identity, pairfeatures
from trackspark.plans import scenes

CLIP, BATCH = ["video_id", "session"], "spark.sql.execution.arrow.maxRecordsPerBatch"


def wandering(spark):
    """Boxes of sessions of unequal length: identities blink, ids are missing, a corner is missing or no number; some ticks have no boxes, the last no tick."""
    rng, rows, ticks = random.Random(5), [], []
    for video, session, n in ((1, 0, 40), (1, 1, 3), (2, 0, 25), (3, 7, 60), (4, 0, 1)):
        for frame in range(n):
            if frame < n - 1 or n == 1:
                ticks.append((video, session, frame, frame / 10.0))
            for det, (track, person) in enumerate([(1, True), (2, True), (None, True), (10001, False), (10002, False)]):
                if rng.random() < 0.7:
                    x, y = 100.0 * det + rng.choice([0.0, 3.0, 7.5]) * frame, 50.0 + rng.choice([0.0, 1.0, 40.0])
                    x = rng.choice([None, float("nan")]) if rng.random() < 0.03 else x
                    rows.append((video, session, frame, det + 1, track, person, "yolo", "person" if person else "bag", x, y, 100.0 * det + 400.0, y + rng.choice([6.0, 150.0]), 0.9, False,
                                 *([100.0, 90.0] * 3 if rng.random() < 0.5 else [None] * 6)))
    boxes = spark.createDataFrame(rows, "video_id long, session long, frame long, det_id long, track_id long, is_person boolean, source string, class_name string, x1 double, y1 double, "
                                        "x2 double, y2 double, confidence double, in_zone boolean, " + ", ".join(f"{m} double" for m in pairfeatures.MARKS))
    return boxes, spark.createDataFrame(ticks, "video_id long, session long, frame long, ts double")


def gathered(boxes, ticks, depths=(), configs=None, window=4, pose_window=5):
    pose = [*pairfeatures.SHOULDERS]
    parts = ({n: c for n, c in part.items() if n not in pose} for part in (pairfeatures.PERSON_PART, pairfeatures.OBJECT_PART))
    return gathering.observations(boxes, ticks, CLIP, *parts, ["moved", *pairfeatures.SIDES], window, pose_window, depths, configs)


def test_motion_equals_windows_across_batches(spark):
    boxes, ticks = wandering(spark)
    known = identity.stable_uids(boxes, CLIP)
    w = Window.partitionBy(*CLIP, "is_person", "uid").orderBy("frame", "det_id")
    c = geom.centroid(geom.box())
    at = known.withColumn("cx", c.x).withColumn("cy", c.y)
    here, early = Point(F.col("cx"), F.col("cy")), lambda v: F.coalesce(*(F.lag(v, k).over(w) for k in (3, 2, 1)))
    moved = at.withColumn("_s", features.step(here, w)).withColumn("moved", geom.distance(here, Point(early("cx"), early("cy"))))
    moved = moved.withColumn("step", features.mean_step("_s", w, 3)).withColumn("pose", features.mean_step("_s", w, 5))
    want = {(r.video_id, r.session, r.frame, r.is_person, r.uid, str(r.step), str(r.pose), None if r.is_person else str(r.moved)) for r in moved.collect()}
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, 7)
    try:
        rows = gathered(boxes, ticks).collect()
    finally:
        spark.conf.set(BATCH, before)
    pairs = [r for r in rows if r.kind == 3]
    got = {(r.video_id, r.session, r.frame, True, r.p_uid, str(r.p_step), str(r.p_pose_step), None) for r in pairs} | {
        (r.video_id, r.session, r.frame, False, r.o_uid, str(r.o_step), str(r.o_pose_step), str(r.o_moved)) for r in pairs}
    alone = {k for k in want if k[:3] not in {(r.video_id, r.session, r.frame) for r in pairs}}
    assert len(got) > 300 and got == want - alone
    heads = {(r.video_id, r.session, r.frame): r for r in rows if r.kind == 0}
    assert len(heads) == len([r for r in rows if r.kind == 0]) and set(heads) == {tuple(r) for r in boxes.select(*CLIP, "frame").union(ticks.select(*CLIP, "frame")).collect()}
    for (video, session, frame), r in heads.items():
        assert sorted(r.people) == sorted(k[4] for k in want if k[:4] == (video, session, frame, True)) and len(r.things) == len(r.rests)
        assert len(r.people) * len(r.things) == sum((q.video_id, q.session, q.frame) == (video, session, frame) for q in pairs)


def test_calibration_equals_the_column_form(spark):
    boxes, ticks = wandering(spark)
    boxes = boxes.where("x1 is not null and not isnan(x1)")
    rows = gathered(boxes, ticks, [10, 24]).where("kind = 0").collect()
    known = identity.stable_uids(boxes, CLIP)
    for depth in (10, 24):
        want = {(r.video_id, r.session): (r.med_h, r.med_step) for r in calibrate.scene_statistics(known, CLIP, "uid", F.col("frame"), depth).collect()}
        told = [((r.video_id, r.session), r.at, (r[f"med_h_{depth}"], r[f"med_step_{depth}"])) for r in rows]
        assert {k for k, at, _ in told if at >= depth - 1} and all(found == (want[k] if at >= depth - 1 else (None, None)) for k, at, found in told)


def test_configs_repeat_ticks_and_leave_out_other_sessions(spark):
    boxes, ticks = wandering(spark)
    configs = spark.createDataFrame([(1, 0, ["a", "b"]), (3, 7, ["b"]), (4, 0, [])], "video_id long, session long, configs array<string>")
    plain = [r for r in gathered(boxes, ticks).collect() if r.video_id in (1, 3) and r.session in (0, 7)]
    got = gathered(boxes, ticks, configs=configs).collect()
    one = lambda r: (r.video_id, r.session, r.frame, r.kind, r.p_uid, r.o_uid)
    assert sorted(((*one(r), r.config_id) for r in got), key=str) == sorted(((*one(r), c) for r in plain for c in (["a", "b"] if r.video_id == 1 else ["b"])), key=str)


def test_boxes_are_shuffled_once(spark):
    cast = spark.range(5).select(F.col("id").alias("video_id"), F.col("id").cast("int").alias("scene"))
    boxes, ticks, named = scenes.staged(spark, cast, scenes.CROWD)
    text = explained(scenes.machine_rows(boxes, ticks, named))
    assert "Window" not in text and text.count("MapInArrow") == 1
    # Above the union of boxes, ticks and configs, there is the shuffle by session and nothing else.
    assert text[: text.index("Union")].count("Exchange") == 1 and "SortMergeJoin" not in text[: text.index("Union")]
