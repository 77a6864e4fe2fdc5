"""Writers (SNK1-SNK9). Outputs are split by key, so no task writes the whole result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.session import written


def accept_events(incoming: DataFrame, cameras: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """SNK1: (accepted with a defaulted time, rejected because the camera is unknown)."""
    known = cameras.select("camera_id").distinct()
    good = incoming.join(known, "camera_id", "left_semi").withColumn("ts", F.coalesce("ts", now))
    return good, incoming.join(known, "camera_id", "left_anti")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def latest_metadata(rows: DataFrame) -> DataFrame:
    """SNK2: of the draft and final metadata of an event, the last version."""
    return rows.groupBy("event_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "event_id")), "version").alias("m")).select("event_id", "m.*")


def write_metadata(rows: DataFrame, path: str, epoch: int) -> None:
    """SNK2: metadata versions as JSON lines; one write is one epoch, and a repeated write replaces its own."""
    rows.write.mode("overwrite").json(f"{path}/epoch={epoch}")


def frames_json(boxes: DataFrame) -> DataFrame:
    """SNK3: one nested record per frame, in the frame-analysis layout."""

    def part(person: bool, extra: list[Column]) -> Column:
        item = F.struct(F.col("track_id"), F.col("class_name"), F.array("x1", "y1", "x2", "y2").alias("bbox"), F.col("confidence"), *extra)
        return F.array_sort(F.collect_list(F.when(F.col("is_person") == person, item)))

    return boxes.groupBy("video_id", F.col("frame").alias("frame_number")).agg(part(True, []).alias("persons"), part(False, [F.col("source")]).alias("objects")).withColumn(
        "timestamp", F.col("frame_number") / 30.0)


def write_frames(boxes: DataFrame, path: str) -> None:
    frames_json(boxes).write.partitionBy("video_id").mode("overwrite").json(path)


def capped_crops(crops: DataFrame, tag: str, order: list[str], cap: int = 40) -> DataFrame:
    """SNK4: the first `cap` crops per tag; the cap is the feature and trims before the shuffle."""
    w = Window.partitionBy(tag).orderBy(*order)
    return crops.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_rn")


def append_crops(crops: DataFrame, path: str, tag: str, order: list[str], cap: int = 40) -> None:
    """SNK4: add crops below the tag's folder until it holds `cap`; what is there stays, and a crop that is there is not added again."""
    spark = crops.sparkSession
    spark.createDataFrame([], crops.schema).write.mode("append").parquet(f"{path}/none")
    held = spark.read.schema(crops.schema).option("recursiveFileLookup", "true").parquet(path)
    new = crops.join(held, crops.columns, "left_anti").dropDuplicates(crops.columns)
    room = held.groupBy(tag).agg(F.count(F.lit(1)).alias("_held"))
    fits = capped_crops(new, tag, order, cap).withColumn("_rn", F.row_number().over(Window.partitionBy(tag).orderBy(*order)))
    fits = fits.join(room, tag, "left").where(F.col("_rn") + F.coalesce("_held", F.lit(0)) <= cap).drop("_rn", "_held")
    # What is read is written to: the rows are settled first.
    written(fits, "crops").write.mode("append").parquet(f"{path}/crops")


def report_document(metrics: DataFrame) -> DataFrame:
    """SNK5: one JSON document per report: the overall row and the per-scenario rows (a few each)."""
    row = F.struct("n", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr")
    return metrics.agg(F.to_json(F.struct(
        F.max(F.when(F.col("scope") == "ALL", row)).alias("aggregate"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("scope") != "ALL", F.struct("scope", row))))).alias("per_scenario"))).alias("doc"))


def write_audit(table: DataFrame, path: str) -> None:
    """SNK6: the same audit table as JSON and CSV."""
    table.write.mode("overwrite").json(f"{path}/json")
    table.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def write_markdown(table: DataFrame, section: str, order: list[str], path: str) -> None:
    """SNK6: the audit table as Markdown, one table with its own head for every section, below the section's folder."""
    shown = [c for c in table.columns if c != section]
    text = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"([\\|])", r"\\$1")
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = table.select(section, F.lit(2).alias("_part"), *order, line([text(c) for c in shown]).alias("value"))
    heads = table.select(section).distinct()
    for part, cells in ((0, shown), (1, ["---"] * len(shown))):
        body = body.unionByName(heads.select(section, F.lit(part).alias("_part"), line([F.lit(c) for c in cells]).alias("value")), allowMissingColumns=True)
    ordered = body.repartition(section).sortWithinPartitions(section, "_part", *order)
    ordered.select(section, "value").write.mode("overwrite").partitionBy(section).text(path)


def label_files(images: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """SNK7: the text of one label file per image; images without labels get an empty file."""
    def fixed(c: str) -> Column:
        """Six decimals, halves to even, as recorded label files are rounded."""
        return F.format_string("%.6f", F.bround(F.col(c), 6))

    line = F.concat_ws(" ", F.col("class_id").cast("string"), fixed("cx"), fixed("cy"), fixed("w"), fixed("h"))
    text = labels.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return images.join(text, keys, "left").withColumn("text", F.coalesce("text", F.lit("")))


def write_label_files(images: DataFrame, labels: DataFrame, split: str, image: str, path: str) -> None:
    """SNK7: one text file per split and image, below `split=.../image=...`; an image without labels has an empty file."""
    files = label_files(images, labels, [split, image])
    files.repartition(split, image).write.mode("overwrite").partitionBy(split, image).option("lineSep", "\n").text(path)


def pinned_snapshot(learned: DataFrame, promoted_at: Column) -> DataFrame:
    """SNK8: the pin is a snapshot of the learned knobs with the time of promotion."""
    return learned.withColumn("pin_schema", F.lit(1)).withColumn("promoted_at", promoted_at)


def promote(learned: DataFrame, promoted_at: Column, path: str) -> None:
    """SNK8: the pin is replaced by this promotion, and the log of promotions has one more."""
    pin = written(pinned_snapshot(learned, promoted_at), "pin")
    append(pin, f"{path}/log")
    pin.write.mode("overwrite").parquet(f"{path}/pin")


#: Folders of a stored table of jobs, events or evidence; a job is in one of them.
JOB_FOLDERS = 64


def store_jobs(events: DataFrame, evidence: DataFrame, jobs: DataFrame, path: str, folders: int = JOB_FOLDERS) -> None:
    """Jobs, events and evidence below `path`, each dealt by job over the same folders.

    `jobs`: job_id; `events`: id, analysis_job_id; `evidence`: event_id. Evidence gets its event's job; that without an
    event, and events without a job, are in the folder of no job. A large job is several files.
    """
    owned = evidence.join(events.select(F.col("id").alias("event_id"), F.col("analysis_job_id").alias("job_id")), "event_id", "left")
    for name, rows in (("jobs", jobs), ("events", events.withColumn("job_id", F.col("analysis_job_id"))), ("evidence", owned)):
        folder = F.coalesce(F.pmod(F.xxhash64("job_id"), F.lit(folders)), F.lit(-1)).cast("int")
        rows.withColumn("folder", folder).hint("rebalance", "folder").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/{name}")


def delete_stored_jobs(doomed: DataFrame, path: str) -> None:
    """Delete the `doomed` jobs (job_id) that are not running, with their events and evidence, below a `store_jobs` path.

    Only folders that hold such rows are written again, with what is left of them; all other files stay. Evidence goes
    first and the jobs' own rows last, so a run that was cut short is completed by the same call, and one that is
    repeated writes nothing. An unknown job deletes nothing. One call at a time may change a path.
    """
    spark = doomed.sparkSession
    stored = spark.read.parquet(f"{path}/jobs")
    gone = written(stored.where("status IS DISTINCT FROM 'processing'").join(doomed.select("job_id").distinct(), "job_id", "left_semi").select("job_id"), "gone-jobs")
    for name in ("evidence", "events", "jobs"):
        table = spark.read.parquet(f"{path}/{name}")
        hit = [r.folder for r in table.join(gone, "job_id", "left_semi").select("folder").distinct().collect()]
        if not hit:
            continue
        # What is read is written to: the rows are settled first.
        left = written(table.where(F.col("folder").isin(hit)).join(gone, "job_id", "left_anti"), f"kept-{name}")
        kept = {r.folder for r in left.select("folder").distinct().collect()}
        left.hint("rebalance", "folder").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(f"{path}/{name}")
        # A folder that loses all its rows is in no row that could overwrite it.
        for folder in sorted(set(hit) - kept):
            left.limit(0).drop("folder").write.mode("overwrite").parquet(f"{path}/{name}/folder={folder}")


def job_manifest(jobs: DataFrame, events: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK9: per job the count and final result, and per event a line with its artifacts, joined by event id."""
    lines = events.join(artifacts, "event_id", "left").select("job_id", "event_id", "confidence", "snapshot", "clip")
    out = jobs.join(events.groupBy("job_id").agg(F.count(F.lit(1)).alias("events_count")), "job_id", "left").na.fill(0, ["events_count"])
    return out.withColumn("final_result", F.when(F.col("events_count") > 0, "LITTERING_EVENT_CANDIDATE").otherwise("NO_EVENT")), lines


def write_manifest(lines: DataFrame, path: str) -> None:
    """SNK9: the events as JSON lines below their job's folder; a job of any size is as many files as it needs."""
    lines.write.mode("overwrite").partitionBy("job_id").json(path)
