"""Registered evaluation queries: clip metrics, temporal matching, gate, clip choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.operators import evaluate
from trackspark.plans import views
from trackspark.plans.registry import query
from trackspark.plans.scalars import r9

HOURS3 = 10800.0


@query("a03_clip_confusion", oracle=views.with_views(views.CLIP_SQL) + """SELECT count(*) FILTER (WHERE predicted AND ground_truth) AS tp, count(*) FILTER (WHERE predicted AND NOT ground_truth) AS fp,
  count(*) FILTER (WHERE NOT predicted AND ground_truth) AS fn, count(*) FILTER (WHERE NOT predicted AND NOT ground_truth) AS tn FROM clip""")
def a03(spark, sf):
    return views.clip(spark, sf).agg(*(c.alias(k) for k, c in evaluate.confusion(F.col("ground_truth"), F.col("predicted")).items()))


METRIC_SQL = """base AS (SELECT coalesce(scenario, 'ALL') AS scope, count(*) AS n, count(*) FILTER (WHERE predicted AND ground_truth) AS tp,
    count(*) FILTER (WHERE predicted AND NOT ground_truth) AS fp, count(*) FILTER (WHERE NOT predicted AND ground_truth) AS fn,
    count(*) FILTER (WHERE NOT predicted AND NOT ground_truth) AS tn,
    coalesce(avg(latency_seconds) FILTER (WHERE predicted AND latency_seconds > 0), 0.0) AS mean_latency, coalesce(avg(fps) FILTER (WHERE fps > 0), 0.0) AS mean_fps
  FROM clip GROUP BY GROUPING SETS ((scenario), ())),
  pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
    CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END AS fpr FROM base),
  metric AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)"""
RATES = ("precision", "recall", "f1", "fpr", "mean_latency", "mean_fps")


@query("a04_rates", oracle=views.with_views(views.CLIP_SQL, METRIC_SQL) + "SELECT scope, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(fpr, 9) AS fpr FROM metric WHERE scope = 'ALL'")
def a04(spark, sf):
    m = evaluate.clip_metrics(views.clip(spark, sf)).where("scope = 'ALL'")
    return m.select("scope", *(r9(F.col(c)).alias(c) for c in RATES[:4]))


@query("a05_scenario_metrics", oracle=views.with_views(views.CLIP_SQL, METRIC_SQL) + f"SELECT scope, n, tp, fp, fn, tn, {', '.join(f'round({c}, 9) AS {c}' for c in RATES)} FROM metric")
def a05(spark, sf):
    m = evaluate.clip_metrics(views.clip(spark, sf))
    return m.select("scope", "n", "tp", "fp", "fn", "tn", *(r9(F.col(c)).alias(c) for c in RATES))


def labelled(spark, sf):
    """One clip per user: every third is a hard negative, half of the rest carry a labelled time."""
    ev = views.gt_pred(spark, sf)
    per = ev.groupBy("clip_id").agg(F.min(F.when(F.col("kind") == "gt", F.col("sec"))).alias("first_gt"), F.bool_or(F.col("kind") == "pred").alias("predicted"))
    return per.select("clip_id", (F.col("clip_id") % 3 != 0).alias("ground_truth"), "predicted",
                      F.when((F.col("clip_id") % 3 != 0) & (F.col("clip_id") % 2 == 0), F.col("first_gt")).alias("gt_time"))


@query("a06_temporal_rollup", oracle=views.with_views(views.GT_PRED_SQL, """c AS (SELECT clip_id, clip_id % 3 <> 0 AS g, bool_or(kind = 'pred') AS predicted,
    CASE WHEN clip_id % 3 <> 0 AND clip_id % 2 = 0 THEN min(CASE WHEN kind = 'gt' THEN sec END) END AS gt_time FROM gt_pred GROUP BY clip_id),
  p AS (SELECT clip_id, count(*) AS n, coalesce(bool_or(abs(sec - gt_time) <= 10800), false) AS hit FROM gt_pred JOIN c USING (clip_id) WHERE kind = 'pred' GROUP BY clip_id),
  s AS (SELECT c.*, coalesce(n, 0) AS n, coalesce(hit, false) AS hit FROM c LEFT JOIN p USING (clip_id))""") + """
SELECT clip_id, CAST(CASE WHEN g AND gt_time IS NULL AND n = 0 THEN predicted::INT WHEN g AND gt_time IS NOT NULL AND hit THEN 1 ELSE 0 END AS BIGINT) AS tp,
  CAST(CASE WHEN g AND gt_time IS NULL AND n = 0 THEN 0 WHEN g AND gt_time IS NOT NULL AND hit THEN n - 1 ELSE n END AS BIGINT) AS fp,
  CAST(CASE WHEN g AND gt_time IS NULL AND n = 0 THEN 1 - predicted::INT WHEN g AND gt_time IS NOT NULL AND NOT hit THEN 1 ELSE 0 END AS BIGINT) AS fn FROM s""")
def a06(spark, sf):
    preds = views.gt_pred(spark, sf).where("kind = 'pred'").select("clip_id", "sec")
    return evaluate.score_clips(labelled(spark, sf), preds, HOURS3)


MATCH_SQL = """g AS (SELECT clip_id, list({'i': event_id, 't': sec} ORDER BY sec, event_id) AS gts FROM gt_pred WHERE kind = 'gt' GROUP BY clip_id),
  p AS (SELECT clip_id, event_id, sec, row_number() OVER (PARTITION BY clip_id ORDER BY sec, event_id) AS r FROM gt_pred WHERE kind = 'pred'),
  f AS (SELECT clip_id, CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pred_id, CAST(NULL AS BIGINT) AS gt_id FROM p WHERE p.r = 1
    UNION ALL SELECT clip_id, r, CASE WHEN b.d <= 10800 THEN list_append(used, b.i) ELSE used END, event_id, CASE WHEN b.d <= 10800 THEN b.i END
    FROM (SELECT f.clip_id, p.r, f.used, p.event_id, list_sort(list_transform(list_filter(coalesce(g.gts, []), lambda x: NOT list_contains(f.used, x.i)),
        lambda x: {'d': abs(p.sec - x.t), 't': x.t, 'i': x.i}))[1] AS b
      FROM f JOIN p ON p.clip_id = f.clip_id AND p.r = f.r + 1 LEFT JOIN g ON g.clip_id = f.clip_id) q),
  verdict AS (SELECT clip_id, pred_id, gt_id FROM f WHERE r > 0)"""
ON_MATCH = views.with_views(views.GT_PRED_SQL, MATCH_SQL, recursive=True)


@query("j17_temporal_match", oracle=ON_MATCH + """SELECT t.clip_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, n_gt - coalesce(tp, 0) AS fn
  FROM (SELECT clip_id, count(*) FILTER (WHERE kind = 'gt') AS n_gt FROM gt_pred GROUP BY clip_id) t
  LEFT JOIN (SELECT clip_id, count(gt_id) AS tp, count(*) FILTER (WHERE gt_id IS NULL) AS fp FROM verdict GROUP BY clip_id) v USING (clip_id)""")
def j17(spark, sf):
    return evaluate.temporal_counts(views.gt_pred(spark, sf), delta=HOURS3)


@query("x02_match_verdicts", oracle=ON_MATCH + "SELECT clip_id, pred_id, gt_id, CASE WHEN gt_id IS NULL THEN 'FP' ELSE 'TP' END AS verdict FROM verdict")
def x02(spark, sf):
    m = evaluate.match_predictions(views.gt_pred(spark, sf), delta=HOURS3)
    return m.select("clip_id", "pred_id", "gt_id", F.when(F.col("gt_id").isNull(), "FP").otherwise("TP").alias("verdict"))


@query("x02_lateral_match", oracle=ON_MATCH + "SELECT clip_id, pred_id, gt_id, CASE WHEN gt_id IS NULL THEN 'FP' ELSE 'TP' END AS verdict FROM verdict")
def x02_lateral(spark, sf):
    """The verdicts by the table function, called in SQL through a lateral join."""
    evaluate.register(spark)
    arrays = evaluate.match_arrays(views.gt_pred(spark, sf), delta=HOURS3)
    return spark.sql("SELECT s.clip_id, m.pred_id, m.gt_id, m.verdict FROM {arrays} s, LATERAL temporal_match(s.gt, s.pred, {delta}) m", arrays=arrays, delta=HOURS3)


@query("t20_promotion_gate", oracle=views.with_views(views.CLIP_SQL, METRIC_SQL) + """SELECT n.scope, n.f1 > c.f1 AND CASE WHEN c.fpr <= 0 THEN n.fpr <= 0 ELSE n.fpr <= c.fpr * 1.1 + 1e-12 END AS promote,
  CASE WHEN n.f1 > c.f1 AND CASE WHEN c.fpr <= 0 THEN n.fpr <= 0 ELSE n.fpr <= c.fpr * 1.1 + 1e-12 END THEN 'F1 improved and FPR within slack'
    ELSE concat_ws('; ', CASE WHEN NOT n.f1 > c.f1 THEN 'F1 not improved' END, CASE WHEN NOT CASE WHEN c.fpr <= 0 THEN n.fpr <= 0 ELSE n.fpr <= c.fpr * 1.1 + 1e-12 END THEN 'FPR regresses beyond slack' END) END AS reason
FROM metric n, metric c WHERE c.scope = 'ALL'""")
def t20(spark, sf):
    """Each scenario as the candidate against the overall report; the current report is one row."""
    m = evaluate.clip_metrics(views.clip(spark, sf))
    current = m.where("scope = 'ALL'").select(F.lit(1).alias("k"), F.col("f1").alias("cur_f1"), F.col("fpr").alias("cur_fpr"))
    new = m.select("scope", F.lit(1).alias("k"), F.col("f1").alias("new_f1"), F.col("fpr").alias("new_fpr"))
    return evaluate.promotion(new.join(current, "k")).select("scope", "promote", "reason")


LISTED_SQL = """listed AS (SELECT doc_id AS ordinal, 'c' || doc_id AS clip_id, source || (doc_id % 40) AS file, doc_id % 11 = 0 AS skip,
  CASE WHEN doc_id % 3 = 0 THEN 'NO_EVENT' ELSE 'LITTER' END AS label, CASE WHEN doc_id % 4 <> 0 THEN CAST(n_chars % 25 AS DOUBLE) END AS event_time_sec FROM documents)"""


@query("f14_clip_selection", oracle=views.with_views(LISTED_SQL) + """, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ordinal) AS r FROM listed WHERE NOT skip) t WHERE r = 1)
SELECT clip_id, file, label FROM first WHERE NOT coalesce(label = 'LITTER' AND event_time_sec > 12.0, false) ORDER BY ordinal LIMIT 50""")
def f14(spark, sf):
    d = views.table(spark, sf, "documents")
    i = F.col("doc_id")
    listed = d.select(i.alias("ordinal"), F.concat(F.lit("c"), i).alias("clip_id"), F.concat("source", i % 40).alias("file"), (i % 11 == 0).alias("skip"),
                      F.when(i % 3 == 0, "NO_EVENT").otherwise("LITTER").alias("label"), F.when(i % 4 != 0, (F.col("n_chars") % 25).cast("double")).alias("event_time_sec"))
    return evaluate.select_clips(listed, quick_before=12.0, limit=50).select("clip_id", "file", "label")
