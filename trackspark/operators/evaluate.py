"""Evaluation against labels: clip metrics, temporal matching, promotion."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from trackspark.operators import folds, longseq

# Matching tolerance and the furthest a prediction may be credited, in seconds.
DELTA_T, T_MAX = 3.0, 10.0


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """A4: precision, recall, F1 and false-positive rate, 0 where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "fpr": ratio(fp, fp + tn)}


def confusion(gt: Column, pred: Column) -> dict[str, Column]:
    """A3."""
    return {"tp": F.count_if(pred & gt), "fp": F.count_if(pred & ~gt), "fn": F.count_if(~pred & gt), "tn": F.count_if(~pred & ~gt)}


def clip_metrics(clips: DataFrame) -> DataFrame:
    """A5: per scenario and overall in one pass; latency over predicted clips, fps over known ones."""
    gt, pred = F.col("ground_truth"), F.col("predicted")
    sets = clips.groupingSets([[F.col("scenario")], []], F.col("scenario")).agg(
        F.coalesce(F.col("scenario"), F.lit("ALL")).alias("scope"), F.count(F.lit(1)).alias("n"),
        *(c.alias(k) for k, c in confusion(gt, pred).items()),
        F.coalesce(F.avg(F.when(pred & (F.col("latency_seconds") > 0), F.col("latency_seconds"))), F.lit(0.0)).alias("mean_latency"),
        F.coalesce(F.avg(F.when(F.col("fps") > 0, F.col("fps"))), F.lit(0.0)).alias("mean_fps"))
    scored = rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return sets.select("scope", "n", "tp", "fp", "fn", "tn", *(c.alias(k) for k, c in scored.items()), "mean_latency", "mean_fps")


def _stretches(events: DataFrame, clip: str, sec: str, delta: float, bucket: float) -> DataFrame:
    """The events with `island`: a clip's timeline cut at gaps longer than `delta`."""
    keyed = longseq.with_ordinal(events, [clip], [sec, "kind", "event_id"], F.floor(F.col(sec) / bucket), "_n")
    gapped = longseq.bounded(keyed, [clip], "_n", lambda w: {"_gap": F.col(sec) - F.lag(sec).over(w)}, before=1)
    return folds.islands(gapped, [clip], "_n", F.col("_gap").isNull() | (F.col("_gap") > delta))


def match_arrays(events: DataFrame, clip: str = "clip_id", sec: str = "sec", delta: float = DELTA_T, bucket: float = 3600.0) -> DataFrame:
    """The arrays that `temporal_match` takes: clip, island, gt and pred, each a list of (sec, event_id) in order of time.

    A row is a stretch of a clip without a gap longer than `delta`, since nothing is matched across one.
    """
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col(sec).cast("double").alias("sec"), F.col("event_id").cast("bigint").alias("event_id")))))
    return _stretches(events, clip, sec, delta, bucket).groupBy(clip, "island").agg(of("gt").alias("gt"), of("pred").alias("pred"))


@udtf(returnType="pred_id bigint, gt_id bigint, distance double, verdict string")
class TemporalMatch:
    """X2 for users of SQL: one row per prediction of two lists of (sec, event_id), with its truth, their distance and the verdict.

    Predictions come in order of time, ties by id; each takes the nearest free truth, ties the earlier one, then the smaller id,
    and is a false positive where that is beyond `delta` (its `gt_id` is NULL then, the distance is told). A list that is NULL
    is empty; elements that are NULL or have no time take no part.
    """

    def eval(self, gt, pred, delta: float):
        times = sorted((g["sec"], g["event_id"]) for g in gt or () if g is not None and g["sec"] is not None)
        # Where to look next for a free truth, per place and direction; one past either end is nowhere.
        up, down = list(range(len(times) + 1)), list(range(-1, len(times)))

        def later(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        def earlier(i: int) -> int:
            while down[i + 1] != i:
                down[i + 1] = down[down[i + 1] + 1]
                i = down[i + 1]
            return i

        for t, event in sorted((p["sec"], p["event_id"]) for p in pred or () if p is not None and p["sec"] is not None):
            at = bisect_left(times, (t,))
            low, high = earlier(at - 1), later(at)
            # Of truths at the same time before the prediction, the one with the smallest id.
            low = later(bisect_left(times, (times[low][0],))) if low >= 0 else low
            near = [(abs(t - times[i][0]), *times[i], i) for i in (low, high) if 0 <= i < len(times)]
            if not near:
                yield event, None, None, "FP"
                continue
            d, _, truth, i = min(near)
            if d > delta:
                yield event, None, d, "FP"
                continue
            up[i], down[i + 1] = i + 1, i - 1
            yield event, truth, d, "TP"


def register(spark: SparkSession) -> None:
    """Make `temporal_match(gt, pred, delta)` known to SQL, for use in a lateral join."""
    spark.udtf.register("temporal_match", TemporalMatch)


def match_predictions(events: DataFrame, clip: str = "clip_id", sec: str = "sec", delta: float = DELTA_T,
                      bucket: float = 3600.0) -> DataFrame:
    """One row per prediction: matched truth id or NULL (a false positive).

    A prediction takes the nearest unused truth and counts as false when that is beyond `delta`,
    without using it up. So only truths within `delta` matter: the timeline splits at longer gaps
    (found with chunked windows), and each island is folded in time order. A truth enters the fold
    `delta` before its time and leaves `delta` after, so the fold holds only truths near "now".
    """
    cut = _stretches(events, clip, sec, delta, bucket)
    arrival = F.when(F.col("kind") == "gt", F.col(sec) - delta).otherwise(F.col(sec))
    rows = cut.select(clip, "island", arrival.alias("arrival"), "kind", F.col(sec).alias("sec"), "event_id")

    def step(near: list, row: tuple):
        _, kind, t, event = row
        if kind == "gt":
            near.append([t, event, False])
            return ()
        near[:] = [g for g in near if g[0] >= t - delta]
        free = [(abs(t - g[0]), g[0], g[1], g) for g in near if not g[2]]
        best = min(free, key=lambda x: x[:3]) if free else None
        if best is None or best[0] > delta:
            return ((event, None),)
        best[3][2] = True
        return ((event, best[2]),)

    kind_of = dict(events.dtypes)
    schema = f"{clip} {kind_of[clip]}, island bigint, pred_id {kind_of['event_id']}, gt_id {kind_of['event_id']}"
    return folds.fold_sorted(rows, [clip, "island"], ["arrival", "kind", "event_id"], list, step, lambda s: (), schema).drop("island")


def temporal_counts(events: DataFrame, clip: str = "clip_id", delta: float = DELTA_T) -> DataFrame:
    """Per clip: true positives, false positives, missed truths."""
    matched = match_predictions(events, clip, delta=delta).groupBy(clip).agg(
        F.count("gt_id").alias("tp"), F.count_if(F.col("gt_id").isNull()).alias("fp"))
    truths = events.groupBy(clip).agg(F.count_if(F.col("kind") == "gt").alias("n_gt"))
    out = truths.join(matched, clip, "left").na.fill(0, ["tp", "fp"])
    return out.select(clip, "tp", "fp", (F.col("n_gt") - F.col("tp")).alias("fn"))


def score_clips(clips: DataFrame, preds: DataFrame, delta: float = DELTA_T) -> DataFrame:
    """Temporal counts of clips with at most one labelled time.

    Hard negatives turn every prediction into a false positive; a positive without a time and
    without predictions is judged on the clip flag; without a time but with predictions, all are
    false positives and nothing is missed.
    """
    near = preds.join(clips.select("clip_id", "gt_time"), "clip_id").groupBy("clip_id").agg(
        F.count(F.lit(1)).alias("n_pred"), F.coalesce(F.bool_or(F.abs(F.col("sec") - F.col("gt_time")) <= delta), F.lit(False)).alias("hit"))
    joined = clips.join(near, "clip_id", "left").na.fill(0, ["n_pred"]).withColumn("hit", F.coalesce("hit", F.lit(False)))
    gt, timed, n = F.col("ground_truth"), F.col("gt_time").isNotNull(), F.col("n_pred")
    by_flag = gt & ~timed & (n == 0)
    hit = gt & timed & F.col("hit")
    tp = F.when(by_flag, F.col("predicted").cast("int")).otherwise(hit.cast("int"))
    fn = F.when(by_flag, 1 - F.col("predicted").cast("int")).when(gt & timed, 1 - hit.cast("int")).otherwise(0)
    fp = F.when(by_flag, 0).otherwise(n - hit.cast("int"))
    return joined.select("clip_id", tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"), fn.cast("bigint").alias("fn"))


def promotion(pairs: DataFrame, slack: float = 1.1) -> DataFrame:
    """Promote when F1 rises and the false-positive rate stays within slack (0 stays 0)."""
    new_f1, cur_f1, new_fpr, cur_fpr = (F.col(c) for c in ("new_f1", "cur_f1", "new_fpr", "cur_fpr"))
    cap = F.when(cur_fpr <= 0, 0.0).otherwise(cur_fpr * slack)
    fpr_ok = F.when(cur_fpr <= 0, new_fpr <= 0).otherwise(new_fpr <= cap + 1e-12)
    better = new_f1 > cur_f1
    reason = F.concat_ws("; ", F.when(~better, F.lit("F1 not improved")), F.when(~fpr_ok, F.lit("FPR regresses beyond slack")))
    return pairs.withColumn("promote", better & fpr_ok).withColumn(
        "reason", F.when(better & fpr_ok, F.lit("F1 improved and FPR within slack")).otherwise(reason))


def select_clips(clips: DataFrame, ids: Sequence[str] | None = None, quick_before: float | None = None, limit: int | None = None) -> DataFrame:
    """not skipped, listed, first per file, short positives only in quick mode, first `limit`."""
    kept = clips.where(~F.col("skip"))
    if ids is not None:
        kept = kept.where(F.col("clip_id").isin(list(ids)))
    first = kept.groupBy("file").agg(F.min_by(F.struct(*kept.columns), "ordinal").alias("c")).select("c.*")
    if quick_before is not None:
        slow = (F.col("label") == "LITTER") & (F.col("event_time_sec") > quick_before)
        first = first.where(~F.coalesce(slow, F.lit(False)))
    return first.orderBy("ordinal").limit(limit) if limit else first
