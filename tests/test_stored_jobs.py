"""Deleting jobs from stored tables: only the folders of deleted rows are written, and a repeat writes nothing."""

import os

from trackspark.sources import sinks


def stamps(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}


def rows(spark, path, table, *columns):
    return sorted((tuple(r) for r in spark.read.parquet(f"{path}/{table}").select(*columns).collect()), key=str)


def test_only_the_folders_of_deleted_jobs_are_written(spark, tmp_path):
    path = str(tmp_path / "stored")
    jobs = spark.createDataFrame([(i, "processing" if i == 3 else "completed" if i % 2 else None) for i in range(12)], "job_id long, status string")
    events = spark.createDataFrame([(100 + i, i % 12 if i < 60 else None) for i in range(64)], "id long, analysis_job_id long")
    evidence = spark.createDataFrame([(1000 + i, 100 + i % 70) for i in range(140)], "evidence_id long, event_id long")
    sinks.store_jobs(events, evidence, jobs, path, folders=200)
    before = stamps(path)
    doomed = spark.createDataFrame([(3,), (5,), (6,), (77,)], "job_id long")
    sinks.delete_stored_jobs(doomed, path)
    after = stamps(path)
    folders = lambda files: {os.path.dirname(f) for f in files}
    assert len(folders(f for f in before if before[f] != after.get(f))) == 6
    assert all(after[f] == before[f] for f in before if os.path.dirname(f) not in folders(set(before) - set(after)))
    gone_events = {100 + i for i in range(60) if i % 12 in (5, 6)}
    assert rows(spark, path, "jobs", "job_id") == sorted([(i,) for i in range(12) if i not in (5, 6)], key=str)
    assert rows(spark, path, "events", "id") == sorted([(100 + i,) for i in range(64) if 100 + i not in gone_events], key=str)
    assert rows(spark, path, "evidence", "evidence_id") == sorted([(1000 + i,) for i in range(140) if 100 + i % 70 not in gone_events], key=str)
    sinks.delete_stored_jobs(doomed, path)
    assert stamps(path) == after


def test_a_deletion_that_was_cut_short_is_completed(spark, tmp_path):
    path = str(tmp_path / "stored")
    jobs = spark.createDataFrame([(i, "completed") for i in range(4)], "job_id long, status string")
    events = spark.createDataFrame([(i, i % 4) for i in range(20)], "id long, analysis_job_id long")
    sinks.store_jobs(events, events.select("id").toDF("event_id"), jobs, path, folders=2)
    whole = spark.read.parquet(f"{path}/evidence")
    kept = sinks.written(whole.where("job_id <> 1"), "cut-short")
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(f"{path}/evidence")
    sinks.delete_stored_jobs(spark.createDataFrame([(1,)], "job_id long"), path)
    assert rows(spark, path, "events", "id") == sorted([(i,) for i in range(20) if i % 4 != 1], key=str) == rows(spark, path, "evidence", "event_id")
    assert rows(spark, path, "jobs", "job_id") == [(0,), (2,), (3,)]
