"""Hand-made frames: duplicates, id spaces, zones, temporal matching, promotion."""

import random

import pytest
from pyspark.sql import functions as F

from trackspark.functions import geom, labels
from trackspark.operators import assoc, detect, evaluate

BOX = "video_id bigint, frame bigint, det_id bigint, is_person boolean, source string, class_name string, x1 double, y1 double, x2 double, y2 double, confidence double"


@pytest.mark.parametrize("flip", [False, True])
def test_overlapping_twin_survives_once(spark, flip):
    a, b = (300.7, 1097.5, 478.4, 1286.1, 0.2723), (318.9, 1091.9, 617.7, 1552.5, 0.2582)
    rows = [(1, 0, i, False, "yolo", "bag", *box) for i, box in enumerate((b, a) if flip else (a, b))]
    kept = detect.pooled_dedup(spark.createDataFrame(rows, BOX)).collect()
    assert [r.confidence for r in kept] == [0.2723]


def test_dedup_matches_brute_force_with_copies(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        x, y = rng.randrange(4) * 30.0, rng.randrange(4) * 30.0
        rows.append((1, i // 40, i, rng.random() < 0.5, rng.choice(["yolo", "color", "novelty"]), "bag", x, y, x + 40 + rng.randrange(2) * 15, y + 50, rng.randrange(10) / 10))
    rows += [(1, 0, 1000 + i, False, "novelty", "bag", 5.0, 5.0, 45.0, 55.0, 0.5) for i in range(500)]

    def dup(a, b):
        inter = max(0, min(a[8], b[8]) - max(a[6], b[6])) * max(0, min(a[9], b[9]) - max(a[7], b[7]))
        aa, ab = ((r[8] - r[6]) * (r[9] - r[7]) for r in (a, b))
        return inter / (aa + ab - inter) >= 0.5 or max(inter / aa, inter / ab) >= 0.7

    rank = {"yolo": 0, "color": 1, "novelty": 2}
    want = set()
    for frame in {r[1] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[1] == frame), key=lambda r: (rank[r[4]], -r[10], (r[8] - r[6]) * (r[9] - r[7]), r[6:10], r[2])):
            if not any(k[3] == r[3] and dup(k, r) for k in kept):
                kept.append(r)
        want |= {r[2] for r in kept}
    assert {r.det_id for r in detect.pooled_dedup(spark.createDataFrame(rows, BOX)).collect()} == want


def test_id_spaces(spark):
    df = spark.createDataFrame([(1, True, "yolo"), (1, False, "yolo"), (5, False, "color"), (9, False, "novelty")], "i bigint, p boolean, s string")
    assert [r[0] for r in df.select(labels.namespaced(F.col("i"), F.col("p"), F.col("s"))).collect()] == [1, 10001, 60005, 110009]


def test_canonical_names_follow_lookup_order(spark):
    df = spark.createDataFrame([("Drink can",), ("garbage bag",), ("nothing at all",), ("tissue paper",), ("Drink can",), (None,)], "n string")
    assert [tuple(r) for r in labels.canonical_ids(df, "n").orderBy("class_id", "n").collect()] == [(None, -1), ("nothing at all", -1), ("Drink can", 2), ("Drink can", 2), ("garbage bag", 4), ("tissue paper", 6)]


def test_zones_of_camera_and_of_all(spark):
    boxes = spark.createDataFrame([(1, 0, 1, False, "yolo", "bag", 10.0, 10.0, 20.0, 20.0, 0.5), (2, 0, 1, False, "yolo", "bag", 10.0, 10.0, 20.0, 20.0, 0.5)], BOX)
    square = geom.polygon_from_box(geom.Box(*(F.lit(v) for v in (0.1, 0.1, 0.2, 0.2))))
    zones = spark.createDataFrame([(1, "own"), (None, "all"), (3, "other")], "camera_id bigint, zone string").withColumn("polygon", square)
    det = boxes.withColumn("camera_id", F.col("video_id"))
    assert sorted((r.video_id, r.zone) for r in assoc.in_zones(det, zones, 100, 100).collect()) == [(1, "all"), (1, "own"), (2, "all")]
    assert [r.in_zone for r in assoc.flag_zones(det, zones.where("zone <> 'all'"), 100, 100).orderBy("video_id").collect()] == [True, False]


@pytest.mark.parametrize("gt, pred, want", [([10.0], [11.5], (1, 0, 0)), ([10.0], [25.0], (0, 1, 1)), ([], [3.0, 9.0], (0, 2, 0)), ([5.0, 6.0], [5.4, 5.6, 5.7], (2, 1, 0))])
def test_time_match(spark, gt, pred, want):
    rows = [(1, "gt", i, t) for i, t in enumerate(gt)] + [(1, "pred", 100 + i, t) for i, t in enumerate(pred)]
    r = evaluate.temporal_counts(spark.createDataFrame(rows, "clip_id bigint, kind string, event_id bigint, sec double")).collect()[0]
    assert (r.tp, r.fp, r.fn) == want


def test_time_match_brute_force(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice(["gt", "pred"]), c * 1000 + i, round(rng.random() * 60, 2)) for c in range(6) for i in range(60)]
    got = {r.clip_id: (r.tp, r.fp, r.fn) for r in evaluate.temporal_counts(spark.createDataFrame(rows, "clip_id bigint, kind string, event_id bigint, sec double"), delta=1.0).collect()}
    for c in range(6):
        free = sorted(t for k, kind, _, t in rows if k == c and kind == "gt")
        n, tp, fp = len(free), 0, 0
        for t in sorted(t for k, kind, _, t in rows if k == c and kind == "pred"):
            best = min(free, key=lambda g: (abs(g - t), g), default=None)
            if best is not None and abs(best - t) <= 1.0:
                free.remove(best)
                tp += 1
            else:
                fp += 1
        assert got[c] == (tp, fp, n - tp)


def test_promotion_cases(spark):
    rows = [(0.60, 0.10, 0.50, 0.10, True), (0.60, 0.20, 0.50, 0.10, False), (0.50, 0.05, 0.50, 0.10, False), (0.60, 0.05, 0.50, 0.0, False)]
    out = evaluate.promotion(spark.createDataFrame(rows, "new_f1 double, new_fpr double, cur_f1 double, cur_fpr double, want boolean")).collect()
    assert all(r.promote == r.want for r in out)
