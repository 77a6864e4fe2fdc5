"""Readers and writers over real files."""

import json

from trackspark.config import Thresholds
from trackspark.sources import readers, sinks


def test_reports_of_any_shape(spark, tmp_path):
    shapes = {"a": {"report": {"aggregate": {"f1": 0.5, "fpr": 0.1}}}, "b": {"aggregate": {"f1_score": 0.25}}, "c": {"f1": 1, "false_positive_rate": 0.75, "report_id": "named"}}
    for name, doc in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    rows = {r["report_id"]: (r["f1"], r["fpr"]) for r in readers.report_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.json": (0.5, 0.1), "b.json": (0.25, 0.0), "named": (1.0, 0.75)}


def test_verdict_tree(spark, tmp_path):
    cases = {"1": ("crop_waste.jpg", ["crop_waste.jpg", "labels.txt"]), "2": (None, ["object.jpg", "waste.jpg", "labels.txt"]), "3": ("gone.jpg", ["labels.txt"]), "4": ("waste.jpg", ["waste.jpg"])}
    for event, (image, files) in cases.items():
        folder = tmp_path / "2024-01-01" / f"event_{event}"
        folder.mkdir(parents=True)
        (folder / "verdict.json").write_text(json.dumps({"event_id": int(event), "verdict": "confirm", "notes": "", "train_image": image}, indent=1))
        for f in files:
            (folder / f).write_bytes(b"x")
    assert {r["event_id"]: r["image"] for r in readers.verdict_tree(spark, str(tmp_path)).collect()} == {1: "crop_waste.jpg", 2: "waste.jpg"}


def test_thresholds_from_a_file(spark, tmp_path):
    path = tmp_path / "events.yaml"
    path.write_text("# settings\nMIN_CARRIED_FRAMES: 7  # longer\nanalysis_fps: 12\nauto_calibrate: false\nstationary_max_pixel_step: null\nNOVELTY_MIN_AREA: 4\nmin_carryd_frames: 3\nbin_zones:\n  - x\n")
    found, unknown = readers.thresholds(spark, str(path))
    assert found == Thresholds(min_carried_frames=7, analysis_fps=12, auto_calibrate=False)
    assert "min_carryd_frames" in unknown and not any(k.startswith("novelty") for k in unknown)
    assert readers.thresholds(spark, str(tmp_path / "nothing.yaml")) == (Thresholds(), [])


def test_learning_files(spark, tmp_path):
    assert [r["videos_analyzed"] for r in readers.learning_files(spark, str(tmp_path / "none")).collect()] == [0]
    (tmp_path / "one.json").write_text('{"videos_analyzed": 4,\n "step_index": {"A": 2}}')
    (tmp_path / "two.json").write_text("{broken")
    rows = {r["store"]: (r["videos_analyzed"], r["step_index"]) for r in readers.learning_files(spark, str(tmp_path)).collect()}
    assert rows == {"one.json": (4, {"A": 2}), "two.json": (0, {})}


def test_label_files_round_trip(spark, tmp_path):
    images = spark.createDataFrame([("train", "a"), ("train", "b"), ("val", "c")], "split string, image string")
    labels = spark.createDataFrame([("train", "a", 1, 0.5, 0.25, 0.125, 0.1), ("train", "a", 0, 0.5, 0.5, 0.5, 0.5), ("val", "c", 2, 1.0, 0.0, 0.3, 0.3)], "split string, image string, class_id int, cx double, cy double, w double, h double")
    sinks.write_label_files(images, labels, "split", "image", str(tmp_path / "labels"))
    assert sorted(f"{p.parent.parent.name}/{p.parent.name}" for p in (tmp_path / "labels").rglob("part-*.txt")) == ["split=train/image=a", "split=train/image=b", "split=val/image=c"]
    back = readers.label_lines(spark.read.text(str(tmp_path / "labels")))
    assert sorted((r["image"], r["class_id"], r["cx"], r["w"]) for r in back.collect()) == [("a", 0, 0.5, 0.5), ("a", 1, 0.5, 0.125), ("c", 2, 1.0, 0.3)]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "img_1.txt").write_text("0 0.5 0.5 0.1 0.1\nbad line\n")
    assert [(r["image"], r["class_id"]) for r in readers.label_folder(spark, str(tmp_path / "plain")).collect()] == [("img_1", 0)]
