"""Events, evidence, jobs and verdicts: joins, as-of lookups, ranges, choices (J8-J15, J22-J24, L*, T13)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.operators import folds, longseq
from trackspark.operators.components import components
from trackspark.session import written


def review_rows(events: DataFrame, evidence: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each event with its evidence ids in order and its job's report.

    Evidence is grouped to one row per event before the join, so the event side is not multiplied.
    """
    bundle = evidence.groupBy("event_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))
    return events.join(bundle, events["id"] == bundle["event_id"], "left").drop("event_id").join(
        jobs.select(F.col("job_id").alias("analysis_job_id"), "report"), "analysis_job_id", "left")


def matching_violation(events: DataFrame, violations: DataFrame, tiers: Sequence[Sequence[str]]) -> DataFrame:
    """Per event the violation chosen by the first tier of id pairs that matches, else a job's only one.

    Each tier is an equi-join against the first violation per (job, ids), so nothing multiplies.
    """
    out = events
    for i, ids in enumerate(tiers):
        first = violations.groupBy("job_id", *ids).agg(F.min("violation_id").alias(f"_t{i}"))
        out = out.join(first.where(" and ".join(f"{c} is not null" for c in ids)), ["job_id", *ids], "left")
    single = violations.groupBy("job_id").agg(F.when(F.count(F.lit(1)) == 1, F.min("violation_id")).alias("_only"))
    out = out.join(single, "job_id", "left")
    return out.withColumn("violation_id", F.coalesce(*(F.col(f"_t{i}") for i in range(len(tiers))), F.col("_only"))).withColumn(
        "tier", F.coalesce(*(F.when(F.col(f"_t{i}").isNotNull(), F.lit(i + 1)) for i in range(len(tiers))), F.when(F.col("_only").isNotNull(), len(tiers) + 1)))


def nearest(targets: DataFrame, records: DataFrame, keys: Sequence[str], at: str, target_id: str, record_id: str,
            bucket: float) -> DataFrame:
    """For each target the record closest in `at`, earlier on ties.

    Both sides are merged into one sequence per key; the record before and the record after are
    the last and next known values along it, so no target is compared with every record. Records of one
    time collapse first, and so do targets: the answer is one per time, joined back to them. At the time of a
    target records precede it.
    """
    r = records.groupBy(*keys, F.col(at).alias("_t")).agg(F.min(record_id).alias("_rid")).withColumn("_asked", F.lit(False))
    t = targets.select(*keys, F.col(at).alias("_t")).distinct().withColumn("_asked", F.lit(True))
    merged = r.unionByName(t, allowMissingColumns=True)
    seen = F.when(F.col("_rid").isNotNull(), F.struct("_t", "_rid"))
    numbered = longseq.with_ordinal(merged, keys, ["_t", "_asked"], F.floor(F.col("_t") / bucket), "_n")
    both = longseq.running(numbered, keys, "_n", {"_before": ("last", seen), "_after": ("next", seen)}).where("_asked")
    gap_before, gap_after = F.col("_t") - F.col("_before._t"), F.col("_after._t") - F.col("_t")
    earlier = F.col("_after").isNull() | (gap_before <= gap_after)
    pick = F.when(F.col("_before").isNotNull() & earlier, F.col("_before._rid")).otherwise(F.col("_after._rid"))
    found = both.select(*keys, "_t", pick.alias(record_id))
    return targets.select(*keys, F.col(at).alias("_t"), target_id).join(found, [*keys, "_t"]).select(*keys, target_id, record_id)


def within(requests: DataFrame, rows: DataFrame, keys: Sequence[str], low: Column, high: Column, at: str, width: float) -> DataFrame:
    """Rows whose `at` lies in [low, high] of a request of the same key.

    The range becomes an equi-join on buckets of `width`; a request is copied to the buckets it spans.
    """
    asked = requests.withColumn("_low", low).withColumn("_high", high).withColumn(
        "_w", F.explode(F.sequence(F.floor(F.col("_low") / width), F.floor(F.col("_high") / width))))
    placed = rows.withColumn("_w", F.floor(F.col(at) / width))
    return asked.join(placed, [*keys, "_w"]).where(F.col(at).between(F.col("_low"), F.col("_high"))).drop("_w", "_low", "_high")


def found_entity(events: DataFrame, boxes: DataFrame, uid: str, track: str) -> DataFrame:
    """The box of an event's entity in a frame: by stable uid, else by track id."""
    joined = events.join(boxes, ["video_id", "frame"]).where((F.col("box_uid") == F.col(uid)) | (F.col("box_track") == F.col(track)))
    rank = F.when(F.col("box_uid") == F.col(uid), 1).otherwise(2)
    return joined.groupBy("event_id").agg(F.min(F.struct(rank.alias("rank"), F.col("det_id").alias("det_id"))).alias("_b")).select(
        "event_id", "_b.rank", "_b.det_id")


def last_points(rows: DataFrame, keys: Sequence[str], at: str, n: int) -> DataFrame:
    """The last n rows per key; Spark trims each map output to n before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def apply_verdicts(events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The latest operator verdict decides the status; a rejection is a hard negative."""
    latest = verdicts.groupBy("event_id").agg(F.max_by("verdict", F.struct("created_at", "verdict_id")).alias("verdict"))
    out = events.join(latest, events["id"] == latest["event_id"], "left").drop("event_id")
    status = F.when(F.col("verdict") == "confirm", "confirmed").when(F.col("verdict") == "reject", "rejected").otherwise(F.col("status"))
    return out.withColumn("final_status", status).withColumn("hard_negative", F.coalesce(F.col("verdict") == "reject", F.lit(False)))


def delete_jobs(events: DataFrame, evidence: DataFrame, jobs: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What remains after deleting jobs with their events and evidence; running jobs are refused."""
    gone = doomed.join(jobs.where(F.col("status") != "processing"), "job_id", "left_semi")
    kept_events = events.join(gone, events["analysis_job_id"] == gone["job_id"], "left_anti")
    removed = events.join(gone, events["analysis_job_id"] == gone["job_id"], "left_semi").select(F.col("id").alias("event_id"))
    return kept_events, evidence.join(removed, "event_id", "left_anti"), jobs.join(gone, "job_id", "left_anti")


def identity_checks(events: DataFrame, detector: DataFrame, metadata: DataFrame, artifacts: Sequence[str]) -> DataFrame:
    """One row per failed check: ids that disagree between sources, artifacts missing or empty."""
    joined = events.join(detector, "event_id", "left").join(metadata, "event_id", "left")

    def differs(a: str, b: str) -> Column:
        return F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))

    checks = [F.when(differs("actor_uid", "det_actor_uid"), F.lit("actor_uid != detector")),
              F.when(differs("object_uid", "det_object_uid"), F.lit("object_uid != detector")),
              F.when(differs("actor_uid", "meta_actor_uid"), F.lit("actor_uid != metadata")),
              *(F.when(F.coalesce(F.col(a), F.lit(0)) == 0, F.lit(f"{a} missing/empty")) for a in artifacts)]
    return joined.select("event_id", F.explode(F.array_compact(F.array(*checks))).alias("failed_check"))


def cluster_groups(events: DataFrame, key: str, object_window: float, actor_window: float) -> DataFrame:
    """`events` with `group`: events of different groups can never share a cluster of T13.

    Clusters join events of one actor and object, of one object within a time, or of one actor within a time. So a pair of ids is
    a node, and so is each run of an object's or an actor's events without a gap as long as its window; an event ties its
    nodes together, and a group is a connected component. A missing id ties nothing.
    """
    runs = events
    for name, who, window in (("_o", "object_uid", object_window), ("_a", "actor_uid", actor_window)):
        w = Window.partitionBy(key, who).orderBy("sec", "event_id")
        begins = F.coalesce(F.col("sec") - F.lag("sec").over(w) >= window, F.lit(True))
        runs = runs.withColumn(f"{name}b", begins).withColumn(name, F.count_if(f"{name}b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(f"{name}b")
    node = lambda kind, *of: F.xxhash64(F.lit(kind), F.col(key), *(F.col(c) for c in of))
    known_o, known_a = F.col("object_uid").isNotNull(), F.col("actor_uid").isNotNull()
    runs = runs.withColumns({"_o": F.when(known_o, node("object", "object_uid", "_o")), "_a": F.when(known_a, node("actor", "actor_uid", "_a")),
                             "_p": F.when(known_o & known_a, node("pair", "actor_uid", "object_uid"))})
    runs = written(runs.withColumn("_any", F.coalesce("_o", "_a", node("event", "event_id"))), "cluster-runs")
    links = runs.select(F.col("_any").alias("a"), F.explode(F.array_compact(F.array("_any", "_a", "_p"))).alias("b")).distinct()
    found = components(links).select(F.col("node").alias("_any"), F.col("label").alias("group"))
    return runs.join(found, "_any").drop("_o", "_a", "_p", "_any")


def clusters(events: DataFrame, key: str, object_window: float = 30.0, actor_window: float = 15.0, split: bool = False) -> DataFrame:
    """One result per incident: the first cluster an event fits, best confidence kept.

    With `split` a key is dealt over its `cluster_groups`, for keys of unbounded size; the results are the same.

    An event fits a cluster with the same actor and object, or the same object within
    `object_window` of the cluster's first time, or the same actor within `actor_window`. In time
    order, old clusters are reachable by (actor, object) alone, so the fold keeps one index entry
    per id pair and short recent lists. A missing actor or object is like no other one.
    """

    def start() -> dict:
        return {"all": [], "pair": {}, "object": {}, "actor": {}}

    def step(state: dict, row: tuple):
        t, event, actor, item, conf = row
        options, known = [], [(index, who, reach) for index, who, reach in (("object", item, object_window), ("actor", actor, actor_window)) if who is not None]
        if len(known) == 2 and (actor, item) in state["pair"]:
            options.append(state["pair"][(actor, item)])
        for index, who, reach in known:
            recent = [c for c in state[index].get(who, []) if t - state["all"][c][0] < reach]
            state[index][who] = recent
            options.extend(recent)
        if options:
            c = state["all"][min(options)]
            if conf > c[2]:
                c[1], c[2] = event, conf
            return ()
        state["all"].append([t, event, conf])
        c = len(state["all"]) - 1
        if len(known) == 2:
            state["pair"][(actor, item)] = c
        for index, who, _ in known:
            state[index].setdefault(who, []).append(c)
        return ()

    def finish(state: dict):
        return [(t, event, conf) for t, event, conf in state["all"]]

    rows = events.select(key, "sec", "event_id", "actor_uid", "object_uid", "confidence")
    kind, keys = dict(events.dtypes), [key]
    out = f"anchor_sec double, event_id {kind['event_id']}, confidence double"
    if split:
        rows, keys = cluster_groups(rows, key, object_window, actor_window), [key, "group"]
    names = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    return folds.fold_sorted(rows, keys, ["sec", "event_id"], start, step, finish, f"{names}, {out}").drop("group")


def page(rows: DataFrame, order: Column, limit: int, offset: int) -> DataFrame:
    """L1: one page, in order, plus the total as a scalar subquery, so that nothing is joined after the sort."""
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return rows.withColumn("total", total).orderBy(order).offset(offset).limit(limit)


def complete_events(events: DataFrame, listing: DataFrame, required: str, optional: Mapping[str, str] | None = None) -> DataFrame:
    """F16: events whose required artifact exists and is not empty, with flags for the optional ones."""
    sized = listing.where(F.col("length") > 0).select("event_id", "kind").distinct()
    out = events.join(sized.where(F.col("kind") == required).select("event_id"), "event_id", "left_semi")
    for flag, kind in (optional or {}).items():
        has = sized.where(F.col("kind") == kind).select("event_id", F.lit(True).alias(flag))
        out = out.join(has, "event_id", "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return out


def best_shots(shots: DataFrame, actor: str, min_size: float) -> DataFrame:
    """The best-scored shot per actor that is large enough, or a status when there is none."""
    big = F.col("size") >= min_size
    best = shots.groupBy(*actor.split(",")).agg(
        F.max(F.when(big, F.struct("score", F.col("frame").alias("frame")))).alias("_b"), F.count(F.lit(1)).alias("seen"))
    return best.select(*actor.split(","), F.col("_b.frame").alias("frame"), F.col("_b.score").alias("score"),
                       F.when(F.col("_b").isNull(), "LOW_QUALITY").otherwise("CAPTURED").alias("status"))
