"""Audits over tracks and detections: tables, quality, comparisons, races, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.operators import folds, longseq, quantiles
from trackspark.operators.components import components
from trackspark.session import written


def track_table(det: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Extent, count and mean centre per track; all partial aggregates."""
    return det.groupBy(*keys).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("n_boxes"),
        F.avg((F.col("x1") + F.col("x2")) / 2.0).alias("mean_cx"), F.avg((F.col("y1") + F.col("y2")) / 2.0).alias("mean_cy"),
        F.min_by("source", F.struct("frame", "det_id")).alias("source"))


#: Half of the cells around a cell: every pair of neighbouring cells is seen from one of its two sides.
SIDES = ((0, 1), (1, -1), (1, 0), (1, 1))


def object_groups(tracks: DataFrame, max_gap: int, max_distance: float) -> DataFrame:
    """`tracks` with `group`: tracks of different groups can never be one physical object of T5.

    An object lies where one of its tracks lies, so a track can only join within `max_distance` of an earlier track that ended
    at most `max_gap` frames before it starts. The plane is cut into cells that wide, and a cell's tracks into runs
    without a longer gap. Such a run is a node. Of the runs of two neighbouring cells, in order of their start, each is tied to the
    one before it that ends last, if no longer gap lies between; runs of one cell never meet, so this ties all that
    do. A group is a connected component. No pairs of tracks are formed, and no cell or video has to fit a task.
    """
    cell = ["video_id", "_cx", "_cy"]
    # A little wider than the distance, so that no rounding puts two tracks within it two cells apart.
    width = max_distance * (1 + 1e-9) or 1.0
    placed = tracks.withColumns({"_cx": F.floor(F.col("cx") / width), "_cy": F.floor(F.col("cy") / width)})

    def reached(rows: DataFrame, keys: list[str], order: list[str], carried: Column) -> DataFrame:
        """The rows with `_prior`: what the row that ends last of those before it in its sequence carries."""
        numbered = longseq.with_ordinal(rows, keys, order, F.floor(F.col("first_frame") / 1024), "_n")
        reach = longseq.running(numbered, keys, "_n", {"_reach": ("max", carried)})
        return longseq.bounded(reach, keys, "_n", lambda w: {"_prior": F.lag("_reach").over(w)}, before=1).drop("_reach")

    prior = reached(placed, cell, ["first_frame", "track_id"], F.col("last_frame"))
    runs = folds.islands(prior, cell, "_n", F.col("_prior").isNull() | (F.col("first_frame") - F.col("_prior") > max_gap), "_run")
    runs = written(runs.withColumn("_node", F.xxhash64(*cell, "_run")).drop("_n", "_prior", "_run"), "object-runs")
    nodes = runs.groupBy(*cell, "_node").agg(F.min("first_frame").alias("first_frame"), F.max("last_frame").alias("last_frame"))
    sides = [F.struct((F.col("_cx") - dx * own).alias("_ex"), (F.col("_cy") - dy * own).alias("_ey"), F.lit(i).alias("_side")) for i, (dx, dy) in enumerate(SIDES) for own in (0, 1)]
    seen = nodes.select("video_id", "_node", "first_frame", "last_frame", F.inline(F.array(*sides)))
    met = reached(seen, ["video_id", "_ex", "_ey", "_side"], ["first_frame", "_node"], F.struct("last_frame", "_node"))
    links = met.where(F.col("first_frame") - F.col("_prior.last_frame") <= max_gap).select(F.col("_node").alias("a"), F.col("_prior._node").alias("b"))
    found = components(links.unionByName(nodes.select(F.col("_node").alias("a"), F.col("_node").alias("b"))))
    return runs.join(found.select(F.col("node").alias("_node"), F.col("label").alias("group")), "_node").drop("_node", "_cx", "_cy")


def physical_objects(tracks: DataFrame, max_gap: int, max_distance: float, split: bool = False) -> DataFrame:
    """T5: join finished tracks of a video into physical objects, named by their first track.

    In start order, a track joins the closest object that ended at most `max_gap` frames before it
    starts (overlap allowed) within `max_distance`; on ties the younger object. Objects that ended
    longer ago can never match again, so the fold forgets them, and a video is cut wherever
    every earlier track ended longer ago. With `split` it is dealt over its `object_groups` instead, for videos that are
    never quiet; the results are the same, and only tracks near a track are live with it.
    """
    order = ["first_frame", "track_id"]
    if split:
        grouped = object_groups(tracks.select("video_id", *order, "last_frame", "cx", "cy"), max_gap, max_distance)
        return _joined(grouped, ["video_id", "group"], max_gap, max_distance).drop("group")
    numbered = longseq.with_ordinal(tracks, ["video_id"], order, F.floor(F.col("first_frame") / 1024), "_n")
    reach = longseq.running(numbered, ["video_id"], "_n", {"_reach": ("max", F.col("last_frame"))})
    prior = longseq.bounded(reach, ["video_id"], "_n", lambda w: {"_prior": F.lag("_reach").over(w)}, before=1)
    cut = folds.islands(prior, ["video_id"], "_n", F.col("_prior").isNull() | (F.col("first_frame") - F.col("_prior") > max_gap))
    return _joined(cut, ["video_id", "island"], max_gap, max_distance).drop("island")


def _joined(tracks: DataFrame, keys: list[str], max_gap: int, max_distance: float) -> DataFrame:
    """The fold of T5 over tracks dealt by `keys`."""
    order = ["first_frame", "track_id"]
    rows = tracks.select(*keys, *order, "last_frame", "cx", "cy")

    def start() -> dict:
        return {"last": np.empty(0), "x": np.empty(0), "y": np.empty(0), "name": []}

    def step(state: dict, row: tuple):
        first, track, last, x, y = row
        live = first - state["last"] <= max_gap
        if not live.all():
            for k in ("last", "x", "y"):
                state[k] = state[k][live]
            state["name"] = [n for n, keep in zip(state["name"], live) if keep]
        d = np.hypot(state["x"] - x, state["y"] - y)
        near = d <= max_distance
        if not near.any():
            for k, v in (("last", last), ("x", x), ("y", y)):
                state[k] = np.append(state[k], v)
            state["name"].append(track)
            return ((track, track),)
        d = np.where(near, d, np.inf)
        i = len(d) - 1 - int(np.argmin(d[::-1]))
        if last > state["last"][i]:
            state["last"][i], state["x"][i], state["y"][i] = last, x, y
        return ((track, state["name"][i]),)

    return folds.fold_sorted(rows, keys, order, start, step, lambda s: (), f"{folds.ddl(rows, keys)}, track_id bigint, object_id bigint")


def track_quality(grouped: DataFrame, keys: Sequence[str], fps: float) -> DataFrame:
    """A8 over physical objects (first/last frame and raw id count): durations, switches, short ones."""
    rows = grouped.withColumn("sec", (F.col("last_frame") - F.col("first_frame") + 1) / fps)
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tracks"), F.avg("sec").alias("avg_s"), F.max("sec").alias("max_s"), F.min("sec").alias("min_s"),
        F.sum(F.col("raw_ids") - 1).alias("id_switches"), F.count_if(F.col("raw_ids") > 1).alias("reassociated"),
        F.count_if(F.col("sec") < 1.0).alias("short_lt_1s"))
    med = quantiles.order_statistics(rows, keys, "sec", {"median_s": quantiles.upper_median}, width=1.0)
    return base.join(med.drop("n"), list(keys))


def tracker_comparison(det: DataFrame, keys: Sequence[str], track: str, fps: float) -> DataFrame:
    """Unique ids, peak concurrency, fragmentation, durations per branch and stream."""
    spans = det.groupBy(*keys, track).agg(((F.max("frame") - F.min("frame") + 1) / fps).alias("sec"))
    base = spans.groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_ids"), F.max("sec").alias("longest_s"),
                                    F.count_if(F.col("sec") < 1.0).alias("short_lt_1s"), F.count_if(F.col("sec") < 0.5).alias("short_lt_05s"))
    med = quantiles.order_statistics(spans, keys, "sec", {"median_s": quantiles.upper_median}, width=1.0)
    peak = peak_concurrent(det, keys, track)
    out = base.join(med.drop("n"), list(keys)).join(peak, list(keys))
    return out.withColumn("fragmentation", F.greatest(F.lit(0), F.col("unique_ids") - F.col("max_concurrent")))


def peak_concurrent(det: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """Most distinct entities in one frame."""
    return det.groupBy(*keys, "frame").agg(F.countDistinct(entity).alias("n")).groupBy(*keys).agg(F.max("n").alias("max_concurrent"))


def identity_audit(det: DataFrame, uid: Column, raw: str) -> tuple[DataFrame, DataFrame]:
    """Per uid the number of raw ids; per frame whether two boxes share a uid."""
    rows = det.withColumn("uid", uid)
    switches = rows.groupBy("video_id", "uid").agg(F.countDistinct(raw).alias("raw_ids"))
    frames = rows.groupBy("video_id", "frame").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("uids"))
    return switches, frames.withColumn("collides", F.col("n") != F.col("uids"))


def vanished_near_person(tracks: DataFrame, within: int = 60, bucket: int = 64) -> DataFrame:
    """Objects that end while an overlapping person stays at most `within` frames longer.

    Persons are first reduced to one row per video and last frame, the earliest starter of that frame, and
    objects to their distinct end frames; end frames are bucketed, so the interval condition is an equi-join with a
    residual. An end frame meets at most `within` rows, however many tracks there are.
    """
    objects, persons = tracks.where(~F.col("is_person")), tracks.where("is_person")
    starter = F.struct(F.col("first_frame").alias("p_first"), F.col("track_id").alias("person_id"))
    p = persons.groupBy("video_id", F.col("last_frame").alias("p_last")).agg(F.min(starter).alias("p")).withColumn("b", F.floor(F.col("p_last") / bucket))
    ends = F.sequence(F.floor(F.col("o_last") / bucket), F.floor((F.col("o_last") + within) / bucket))
    o = objects.select("video_id", F.col("last_frame").alias("o_last")).distinct().withColumn("b", F.explode(ends))
    hit = o.join(p, ["video_id", "b"]).where((F.col("p.p_first") <= F.col("o_last")) & (F.col("p_last") > F.col("o_last")) & (F.col("p_last") - F.col("o_last") <= within))
    first = hit.groupBy("video_id", "o_last").agg(F.min("p").alias("p"))
    ended = objects.select("video_id", F.col("track_id").alias("object_id"), F.col("last_frame").alias("o_last"))
    return ended.join(first, ["video_id", "o_last"]).select("video_id", "object_id", F.col("p.person_id").alias("person_id"))


def appeared_after_person(tracks: DataFrame, within: int = 30, bucket: int = 32) -> DataFrame:
    """Objects that start at most `within` frames after a person ended: how many, and the last one."""
    objects, persons = tracks.where(~F.col("is_person")), tracks.where("is_person")
    before = F.sequence(F.floor((F.col("first_frame") - within) / bucket), F.floor((F.col("first_frame") - 1) / bucket))
    o = objects.select("video_id", F.col("track_id").alias("object_id"), F.col("first_frame").alias("o_first"), F.explode(before).alias("b"))
    ended = persons.groupBy("video_id", F.col("last_frame").alias("p_last")).agg(F.count(F.lit(1)).alias("n"), F.max("track_id").alias("person_id"))
    ended = ended.withColumn("b", F.floor(F.col("p_last") / bucket))
    hit = o.join(ended, ["video_id", "b"]).where((F.col("o_first") > F.col("p_last")) & (F.col("o_first") - F.col("p_last") <= within))
    return hit.groupBy("video_id", "object_id").agg(F.sum("n").alias("n_persons"), F.max_by("person_id", "p_last").alias("last_person_id"))


def possible_false(tracks: DataFrame, fps: float, frame_h: float) -> DataFrame:
    """tracks with at least one warning sign."""
    sec = (F.col("last_frame") - F.col("first_frame") + 1) / fps
    reasons = F.array_compact(F.array(
        F.when(F.col("class_name") == "detected_object", F.lit("NOVELTY_CLASS_UNKNOWN_OBJECT")),
        F.when(sec < 1.0, F.lit("SHORT_TRACK_LT_1S")),
        F.when(F.col("mean_cy") > frame_h * 0.92, F.lit("BOTTOM_STRIP_POSSIBLE_SHADOW_OR_BIN_EDGE")),
        F.when((F.col("source") == "color") & (sec < 1.5), F.lit("HSV_SHORT_FRAGMENT"))))
    return tracks.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def run_difference(expected: DataFrame, actual: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Expected against actual per key: match, differ, or present on one side only."""
    e, a = expected.withColumnRenamed("value", "expected"), actual.withColumnRenamed("value", "actual")
    both = e.join(a, key, "full_outer")
    verdict = F.when(F.col("actual").isNull(), "MISSING").when(F.col("expected").isNull(), "EXTRA").when(
        F.abs(F.col("expected") - F.col("actual")) < tolerance, "MATCH").otherwise("DIFF")
    return both.withColumn("verdict", verdict)


def races(cands: DataFrame) -> DataFrame:
    """Per contested object and frame, the two best persons by plain score with their cues.

    The top two come from one sorted struct array of the frame's few candidates.
    """
    w = Window.partitionBy("video_id", "frame", "object_id").orderBy(F.col("legacy").desc(), "person_id")
    blended = Window.partitionBy("video_id", "frame", "object_id").orderBy(F.col("blended").desc(), "person_id")
    ranked = cands.select("video_id", "frame", "object_id", "person_id", "legacy", "pose", "blended",
                          F.row_number().over(w).alias("r"), F.row_number().over(blended).alias("rb"))
    two = ranked.groupBy("video_id", "frame", "object_id").agg(
        F.max(F.when(F.col("r") == 1, F.col("person_id"))).alias("winner"), F.max(F.when(F.col("rb") == 1, F.col("person_id"))).alias("blended_winner"),
        F.max(F.when(F.col("r") == 1, F.col("pose"))).alias("pose_1"), F.max(F.when(F.col("r") == 2, F.col("pose"))).alias("pose_2"),
        F.max(F.when(F.col("rb") == 1, F.col("blended"))).alias("blended_1"), F.max(F.when(F.col("rb") == 2, F.col("blended"))).alias("blended_2"),
        F.count(F.lit(1)).alias("n"))
    return two.where("n >= 2").withColumn("gap", F.col("pose_1") - F.col("pose_2")).withColumn("margin", F.col("blended_1") - F.col("blended_2"))


def fingerprint(rows: DataFrame, run: str, decision: Column) -> DataFrame:
    """Order-independent SHA-256 per run.

    Each decision is hashed; the eight words of the hashes are added up, which is a map-side combined sum
    whatever the number of rows, and the count and the sums are hashed once more.
    """
    hashed = rows.select(run, F.sha2(decision, 256).alias("h"))
    words = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(8)]
    sums = hashed.groupBy(run).agg(F.count(F.lit(1)).alias("n_decisions"), *(F.sum(w).alias(f"w{i}") for i, w in enumerate(words)))
    return sums.select(run, F.sha2(F.concat_ws(":", *(F.col(c).cast("string") for c in ("n_decisions", *(f"w{i}" for i in range(8))))), 256).alias("sha"), "n_decisions")
