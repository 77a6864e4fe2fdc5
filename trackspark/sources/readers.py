"""Readers for recorded files (SRC1-SRC13). Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.config import KNOBS, Thresholds, unknown_knobs

POINT = "array<double>"
PERSON = (f"track_id bigint, class_name string, bbox array<double>, confidence double, keypoints map<string,{POINT}>, head_visible boolean, head_bbox array<double>, "
          "trail array<array<double>>, state string, associated_object_id bigint, person_uid bigint")
OBJECT = "track_id bigint, class_name string, bbox array<double>, confidence double, source string, trail array<array<double>>, state string, object_uid bigint"

def _struct(fields: str) -> str:
    """"a bigint, b string" -> "struct<a: bigint, b: string>"."""
    depth, parts, current = 0, [], ""
    for ch in fields:
        depth += ch in "<(" 
        depth -= ch in ">)"
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    parts.append(current.strip())
    return "struct<" + ", ".join(f"{p.split(' ', 1)[0]}: {p.split(' ', 1)[1]}" for p in parts) + ">"


FRAME_SCHEMA = (f"timestamp double, frame_number bigint, persons array<{_struct(PERSON)}>, objects array<{_struct(OBJECT)}>, states array<string>, hud map<string,string>")
TICK_PERSON = "track_id bigint, bbox array<double>, confidence double"
TICK_OBJECT = "track_id bigint, bbox array<double>, confidence double, class_name string, source string"
TICK_SCHEMA = f"video_id bigint, frame_index bigint, t_rel double, timestamp double, persons array<{_struct(TICK_PERSON)}>, objects array<{_struct(TICK_OBJECT)}>, _corrupt_record string"
RAW_BOX = "model string, class string, confidence double, bbox array<double>, is_person boolean"
RAW_SCHEMA = f"video string, frames array<struct<src_frame: bigint, sources: map<string, array<{_struct(RAW_BOX)}>>>>"
ANNOTATION_SCHEMA = "clip_id string, scenario string, ground_truth boolean, event_timestamp_sec double, object_type string, notes string"
MANIFEST_SCHEMA = "frozen boolean, clips array<struct<id: string, file: string, label: string, scenario: string, event_time_sec: double, skip: boolean>>"
VERDICT_SCHEMA = "event_id bigint, verdict string, notes string, created_at string, train_image string, labels_file string, hard_negative boolean"
COCO_SCHEMA = ("images array<struct<id: bigint, width: int, height: int, file_name: string>>, categories array<struct<id: int, name: string>>, "
               "annotations array<struct<id: bigint, image_id: bigint, category_id: int, bbox: array<double>>>")


def sides(bbox: Column) -> list[Column]:
    return [bbox[i].alias(s) for i, s in enumerate(("x1", "y1", "x2", "y2"))]


def frame_analysis(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: one row per person or object of each frame record; `video_id` is the folder partition."""
    frames = spark.read.schema(f"{FRAME_SCHEMA}, video_id bigint").json(path)
    both = F.concat(F.transform("persons", lambda p: F.struct(F.lit(True).alias("is_person"), p["track_id"].alias("track_id"), p["class_name"].alias("class_name"), p["confidence"].alias("confidence"), p["bbox"].alias("bbox"))),
                    F.transform("objects", lambda o: F.struct(F.lit(False).alias("is_person"), o["track_id"].alias("track_id"), o["class_name"].alias("class_name"), o["confidence"].alias("confidence"), o["bbox"].alias("bbox"))))
    flat = frames.select("video_id", F.col("frame_number").alias("frame"), "timestamp", F.inline(both))
    return flat.select("video_id", "frame", "timestamp", "is_person", "track_id", "class_name", "confidence", *sides(F.col("bbox")))


def tick_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC2: (ticks, corrupt lines). Blank lines vanish; unreadable ones are kept aside, not dropped silently."""
    rows = spark.read.schema(TICK_SCHEMA).option("mode", "PERMISSIVE").json(path)
    good = F.col("_corrupt_record").isNull() & F.col("frame_index").isNotNull()
    return rows.where(good).drop("_corrupt_record"), rows.where(~good).select("_corrupt_record")


def raw_models(spark: SparkSession, path: str, person_model: str = "person_model", multi_line: bool = True) -> DataFrame:
    """SRC3: boxes of all models per frame, without the non-persons of the person model."""
    rows = spark.read.schema(RAW_SCHEMA).option("multiLine", multi_line).json(path)
    frames = rows.select("video", F.explode("frames").alias("f")).select("video", F.col("f.src_frame").alias("frame"), F.explode("f.sources").alias("source", "boxes"))
    boxes = frames.select("video", "frame", "source", F.inline("boxes"))
    return boxes.where((F.col("source") != person_model) | F.col("is_person")).select("video", "frame", "source", F.col("class").alias("class_name"), "confidence", "is_person", *sides(F.col("bbox")))


def frozen_manifest(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC4: labelled clips; a manifest that is not frozen fails the query."""
    doc = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", multi_line).json(path)
    sealed = doc.withColumn("_ok", F.assert_true(F.coalesce("frozen", F.lit(False)), F.lit("manifest is not frozen"))).where(F.col("_ok").isNull())
    return sealed.select(F.inline("clips"))


def clip_annotations(spark: SparkSession, path: str, clips: DataFrame) -> DataFrame:
    """SRC5: annotations below littering/ and normal/, for the clips that exist; `folder` comes from the path."""
    rows = spark.read.schema(ANNOTATION_SCHEMA).option("recursiveFileLookup", "true").json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.withColumn("folder", folder).join(clips.select("clip_id"), "clip_id")


def evaluation_reports(raw: DataFrame, doc: str = "doc") -> DataFrame:
    """SRC6: one metric row per report, whichever of the known shapes it has."""

    def metric(*names: str) -> Column:
        paths = [f"$.{prefix}{n}" for n in names for prefix in ("report.aggregate.", "aggregate.", "")]
        return F.coalesce(*(F.get_json_object(doc, p).cast("double") for p in paths), F.lit(0.0))

    return raw.select("report_id", metric("f1", "f1_score").alias("f1"), metric("fpr", "false_positive_rate").alias("fpr"), metric("precision").alias("precision"), metric("recall").alias("recall"))


def documents(spark: SparkSession, path: str, glob: str | None = None, whole: bool = True) -> DataFrame:
    """(file, doc): one row per file below a folder, or per line of its files. A folder that is not there has none."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        return reader.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, doc string")


def report_files(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """SRC6 from files: the report id is a field of the document, else the file."""
    docs = documents(spark, path, whole=whole)
    named = docs.withColumn("report_id", F.coalesce(F.get_json_object("doc", "$.report_id"), F.element_at(F.split("file", "/"), -1)))
    return evaluation_reports(named)


def verdict_tree(spark: SparkSession, path: str) -> DataFrame:
    """SRC7 from files: every `verdict.json` below a folder with what lies beside it."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    verdicts = spark.read.schema(VERDICT_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "verdict.json").json(path)
    verdicts = verdicts.where("event_id is not null").withColumn("folder", folder(F.col("_metadata.file_path")))
    # Names only: the files' content is pruned from the scan.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return verdict_samples(verdicts, files.select(folder(F.col("path")).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("name")))


def label_folder(spark: SparkSession, path: str) -> DataFrame:
    """SRC8 from files: the lines of all label files below a folder, with the image they are named after."""
    lines = documents(spark, path, "*.txt", whole=False)
    return label_lines(lines.withColumn("image", F.regexp_extract("file", r"([^/]*)\.txt$", 1)), "doc").drop("doc", "file")


def thresholds(spark: SparkSession, path: str) -> tuple[Thresholds, list[str]]:
    """SRC11 from a file: the thresholds of a run and the keys that name none; a missing file gives the defaults.

    The file is one run's settings, a line for each, so its lines are values of the driver like the thresholds.
    """
    found = {r["key"]: r["value"] for r in threshold_lines(documents(spark, path, whole=False), "doc").collect()}

    def typed(key: str, text: str | None):
        plain = (text or "").strip("\"'")
        if plain.lower() in ("", "null", "none", "~"):
            return None
        if plain.lower() in ("true", "false"):
            return plain.lower() == "true"
        number = float(plain)
        return int(number) if isinstance(KNOBS[key], int) and number.is_integer() else number

    known = {k: typed(k, v) for k, v in found.items() if k in KNOBS}
    return Thresholds().with_overrides(**known), unknown_knobs(found)


def learning_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC12 from files: one state per store file; no file gives one empty state."""
    docs = documents(spark, path).select(F.element_at(F.split("file", "/"), -1).alias("store"), "doc")
    if docs.isEmpty():
        docs = spark.createDataFrame([(None, None)], "store string, doc string")
    return learning_snapshot(docs)


def verdict_samples(verdicts: DataFrame, listing: DataFrame) -> DataFrame:
    """SRC7: verdicts with their training image (named, else by preference) and labels; incomplete ones drop out.

    `listing`: folder, name. One row per folder is built first, so the verdicts are not multiplied.
    """
    files = listing.groupBy("folder").agg(F.collect_set("name").alias("names"))
    joined = verdicts.join(files, "folder")
    options = [F.col("train_image"), *(F.lit(n) for n in ("crop_waste.jpg", "waste.jpg", "object.jpg"))]
    image = F.coalesce(*(F.when(F.array_contains("names", o), o) for o in options))
    return joined.withColumn("image", image).where(F.col("image").isNotNull() & F.array_contains("names", F.lit("labels.txt"))).drop("names")


def label_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC8: "class cx cy w h" lines; anything else is ignored."""
    parts = F.split(F.trim(column), r"\s+")
    fields = ["cx", "cy", "w", "h"]
    out = lines.withColumn("_p", parts).where(F.size("_p") == 5).withColumn("class_id", F.expr("try_cast(_p[0] AS INT)"))
    out = out.select("*", *(F.expr(f"try_cast(_p[{i + 1}] AS DOUBLE)").alias(f) for i, f in enumerate(fields)))
    return out.where(" and ".join(f"{c} is not null" for c in ["class_id", *fields])).drop("_p")


def coco(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """SRC9: annotations with image size and category name, by two equi-joins inside each document."""
    doc = spark.read.schema(COCO_SCHEMA + ", piece string").option("multiLine", multi_line).json(path)
    name = F.coalesce("piece", F.col("_metadata.file_path")).alias("file")
    images = doc.select(name, F.inline("images")).select("file", F.col("id").alias("image_id"), "width", "height")
    cats = doc.select(name, F.inline("categories")).select("file", F.col("id").alias("category_id"), F.col("name").alias("class_name"))
    anns = doc.select(name, F.inline("annotations"))
    return anns.join(images, ["file", "image_id"]).join(cats, ["file", "category_id"])


def relation(spark: SparkSession, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """SRC10: cameras, events, evidence or jobs from Parquet (additive columns merged) or over JDBC."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc).load()
    return spark.read.option("mergeSchema", "true").parquet(path)


def threshold_lines(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """SRC11: flat "KEY: value" lines as (key, value, known); comments, lists and indented lines are skipped."""
    text = F.trim(F.split(column, "#")[0])
    ok = F.contains(text, F.lit(":")) & ~F.substring(column, 1, 1).isin("-", " ", "\t")
    key = F.lower(F.trim(F.substring_index(text, ":", 1)))
    value = F.trim(F.expr(f"substring(trim(split({column}, '#')[0]), instr(trim(split({column}, '#')[0]), ':') + 1)"))
    known = F.when(key.isin(*KNOBS), "knob").when(F.startswith(key, F.lit("novelty_")), "novelty").otherwise("unknown")
    return lines.where(ok).select(*keep, key.alias("key"), F.nullif(value, F.lit("")).alias("value"), known.alias("kind"))


def learning_snapshot(raw: DataFrame, doc: str = "doc") -> DataFrame:
    """SRC12: learning state per store; missing or unreadable documents give the empty state."""
    state = F.from_json(doc, "videos_analyzed bigint, step_index map<string,int>, rejection_reasons map<string,bigint>")
    return raw.select("store", F.coalesce(state["videos_analyzed"], F.lit(0)).alias("videos_analyzed"), F.coalesce(state["step_index"], F.create_map().cast("map<string,int>")).alias("step_index"))


def live_ticks(spark: SparkSession, path: str, watermark: str = "10 seconds", glob: str | None = None) -> DataFrame:
    """SRC13: a stream of tick files; a frame already seen for a video is skipped."""
    reader = spark.readStream.schema("video_id bigint, frame bigint, ts timestamp, persons int")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["video_id", "frame"])
