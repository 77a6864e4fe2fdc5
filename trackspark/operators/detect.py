"""Detections inside one frame: pooling, deduplication, admission, proposals and frame joins.

Every join here is an equi-join on (video_id, frame) with geometry as the residual predicate; AQE
splits a frame partition that turns out skewed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions import geom, labels

FRAME = ["video_id", "frame"]
BOX = ["x1", "y1", "x2", "y2"]


def _greedy(df: DataFrame, group: Sequence[str], rank: Sequence[Column], suppressed_by) -> DataFrame:
    """Keep boxes in rank order unless a kept box of the same group suppresses them.

    Identical boxes of a group suppress each other, so they collapse to their best-ranked copy
    first, in a map-side combined aggregate: a frame full of copies never reaches the fold. The
    fold is a native `aggregate` over the distinct boxes of one frame and group.
    """
    payload = [c for c in df.columns if c not in {*group, *BOX}]
    ranked = df.withColumn("_rank", F.struct(*(r.alias(f"r{i}") for i, r in enumerate(rank))))
    best = ranked.groupBy(*group, *BOX).agg(F.min_by(F.struct("_rank", *payload), "_rank").alias("_best"))
    item = F.struct(F.col("_best._rank").alias("_rank"), *BOX, *(F.col(f"_best.{c}").alias(c) for c in payload))
    frames = best.select(*group, item.alias("_item")).groupBy(*group).agg(F.array_sort(F.collect_list("_item")).alias("_boxes"))
    fold = F.aggregate(
        "_boxes", F.slice("_boxes", 1, 0),
        lambda kept, b: F.when(F.exists(kept, lambda k: suppressed_by(geom.box_of(k), geom.box_of(b))), kept)
        .otherwise(F.concat(kept, F.array(b))))
    kept = frames.select(*group, F.explode(fold).alias("_k"))
    return kept.select(*(F.col(c) if c in group else F.col(f"_k.{c}").alias(c) for c in df.columns))


def pooled_dedup(det: DataFrame) -> DataFrame:
    """Across detectors, the better source, then confidence, then the tighter box wins."""
    rank = [labels.source_rank(F.col("source")), -F.col("confidence"), geom.raw_area(geom.box()), *(F.col(c) for c in BOX), F.col("det_id")]
    return _greedy(det, [*FRAME, "is_person"], rank, geom.is_duplicate)


def containment_dedup(det: DataFrame, model: str = "source", limit: float = 0.7) -> DataFrame:
    """Per model, drop a box mostly inside a more confident kept box of the same group."""
    return _greedy(det, [*FRAME, model, "is_person"], [-F.col("confidence"), F.col("det_id")],
                   lambda kept, b: geom.containment(b, kept) >= limit)


def pool_models(raw: DataFrame, person_model: str = "person_model") -> DataFrame:
    """SRC3/U1: union of model outputs; the person model contributes persons only."""
    return raw.where((F.col("model") != person_model) | F.col("is_person"))


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = FRAME) -> DataFrame:
    return df.select(*keep, *(F.col(c).alias(prefix + c) for c in df.columns if c not in keep))


def overlapping_pairs(det: DataFrame, min_iou: float = 0.02, min_containment: float = 0.05) -> DataFrame:
    """Same-group pairs of a frame that touch, with metrics and a verdict.

    Pairs that do not touch are never emitted; `pair_verdict_counts` counts them arithmetically.
    """
    keep = [*FRAME, "is_person"]
    a, b = prefixed(det, "a_", keep), prefixed(det, "b_", keep)
    ab, bb = geom.box("a_"), geom.box("b_")
    touching = (geom.iou(ab, bb) > min_iou) | (F.greatest(geom.containment(ab, bb), geom.containment(bb, ab)) > min_containment)
    pairs = a.join(b, keep).where((F.col("a_det_id") < F.col("b_det_id")) & touching)
    verdict = F.when(~geom.is_duplicate(ab, bb), "LEGITIMATE_OVERLAP").when(
        F.col("a_source") == F.col("b_source"), "SAME_PHYSICAL_OBJECT").otherwise("LIKELY_DUPLICATE")
    return pairs.withColumn("iou", geom.iou(ab, bb)).withColumn("area_ratio", geom.area_ratio(ab, bb)).withColumn("verdict", verdict)


def pair_verdict_counts(det: DataFrame, by: Sequence[str] = ("video_id",)) -> DataFrame:
    """Counts per verdict; person-object pairs and untouched pairs follow from box counts."""
    per_frame = det.groupBy(*FRAME).agg(F.count_if("is_person").alias("p"), F.count_if(~F.col("is_person")).alias("o"))
    totals = per_frame.groupBy(*by).agg(
        F.sum(F.col("p") * F.col("o")).alias("cross"),
        F.sum((F.col("p") * (F.col("p") - 1) + F.col("o") * (F.col("o") - 1)) / 2).cast("bigint").alias("same"))
    seen = overlapping_pairs(det).groupBy(*by).agg(*(
        F.count_if(F.col("verdict") == v).alias(v) for v in ("SAME_PHYSICAL_OBJECT", "LIKELY_DUPLICATE", "LEGITIMATE_OVERLAP")))
    joined = totals.join(seen, list(by), "left").na.fill(0)
    touched = F.col("SAME_PHYSICAL_OBJECT") + F.col("LIKELY_DUPLICATE") + F.col("LEGITIMATE_OVERLAP")
    return joined.select(
        *by, F.col("SAME_PHYSICAL_OBJECT").alias("same_physical"), F.col("LIKELY_DUPLICATE").alias("likely_duplicate"),
        (F.col("LEGITIMATE_OVERLAP") + F.col("cross")).alias("legitimate_overlap"), (F.col("same") - touched).alias("distinct_pairs"))


def drop_known_novelty(det: DataFrame) -> DataFrame:
    """Novelty boxes that no box of another detector duplicates."""
    novelty = det.where((F.col("source") == "novelty") & ~F.col("is_person"))
    known = prefixed(det.where((F.col("source") != "novelty") & ~F.col("is_person")).select(*FRAME, *BOX), "k_")
    n = novelty.alias("n")
    k = known.alias("k")
    same_frame = (F.col("n.video_id") == F.col("k.video_id")) & (F.col("n.frame") == F.col("k.frame"))
    nb = geom.Box(*(F.col(f"n.{c}") for c in BOX))
    return n.join(k, same_frame & geom.is_duplicate(nb, geom.box("k_")), "left_anti")


def nearest_person(objects: DataFrame, persons: DataFrame, max_distance: float) -> DataFrame:
    """Closest person centre within reach; none when the object lies inside any person box.

    The best candidate is an aggregate (min_by), combined map-side, not a sorted group.
    """
    o, p = objects.select(*FRAME, "det_id", *BOX), prefixed(persons.select(*FRAME, "det_id", *BOX), "p_")
    ob, pb = geom.box(), geom.box("p_")
    d = geom.distance(geom.centroid(ob), geom.centroid(pb))
    joined = o.join(p, FRAME, "left").withColumn("_d", d)
    reach = F.struct(F.when(F.col("_d") < max_distance, F.col("_d")).alias("d"), F.col("p_det_id").alias("i"))
    best = joined.groupBy(*FRAME, "det_id").agg(
        F.min(F.when(F.col("_d") < max_distance, reach)).alias("_best"),
        F.coalesce(F.bool_or(geom.center_inside(ob, pb)), F.lit(False)).alias("inside"))
    return best.select(*FRAME, "det_id", "inside", F.when(~F.col("inside"), F.col("_best.i")).alias("person_id"))


def near_any_person(objects: DataFrame, persons: DataFrame, expand: float = 0.75) -> DataFrame:
    """J4 gate: objects whose centre lies in some person box grown by a share of its height."""
    o = objects.alias("o")
    p = prefixed(persons.select(*FRAME, *BOX), "p_").alias("p")
    pb, c = geom.box("p_"), geom.centroid(geom.Box(*(F.col(f"o.{x}") for x in BOX)))
    pad = geom.height(pb) * expand
    inside = c.x.between(pb.x1 - pad, pb.x2 + pad) & c.y.between(pb.y1 - pad, pb.y2 + pad)
    return o.join(p, (F.col("o.video_id") == F.col("p.video_id")) & (F.col("o.frame") == F.col("p.frame")) & inside, "left_semi")


def promote_colour(det: DataFrame) -> DataFrame:
    """A colour candidate in a person's carry band, with a handheld size, becomes a waste class.

    The smallest area ratio decides, so the tie over persons is an aggregate.
    """
    candidates = det.where(~F.col("is_person") & F.startswith("class_name", F.lit("color_candidate_")))
    persons = prefixed(det.where("is_person").select(*FRAME, *BOX), "p_")
    ob, pb = geom.box(), geom.box("p_")
    c, w, h = geom.centroid(ob), geom.width(pb), geom.height(pb)
    band = c.x.between(pb.x1 - 0.25 * w, pb.x2 + 0.25 * w) & c.y.between(pb.y1 + 0.30 * h, pb.y2 + 0.15 * h)
    ratio = geom.floored_area(ob) / geom.floored_area(pb)
    hue = F.substring_index("class_name", "_", -1)
    handheld = ratio.between(0.003, 0.12) & (hue != "white") & ~((hue == "black") & (ratio > 0.08)) & ~(
        (hue == "red") & ((ratio > 0.06) | (geom.height(ob) > 0.25 * h)))
    fits = candidates.join(persons, FRAME).where(band & handheld)
    best = fits.groupBy(*FRAME, "det_id").agg(F.min(ratio).alias("best_ratio"))
    joined = candidates.join(best, [*FRAME, "det_id"], "left")
    promoted = F.when(F.col("best_ratio").isNull(), F.col("class_name")).otherwise(F.concat(hue, F.lit("_waste_bag")))
    return joined.withColumn("promoted_class", promoted)


def latched_on_body(objects: DataFrame, persons: DataFrame) -> DataFrame:
    """Objects centred on a torso and covered by it, i.e. clothing."""
    o, p = objects.alias("o"), prefixed(persons.select(*FRAME, *BOX), "p_").alias("p")
    ob, pb = geom.Box(*(F.col(f"o.{x}") for x in BOX)), geom.box("p_")
    c, w, h = geom.centroid(ob), geom.width(pb), geom.height(pb)
    covered = geom.intersection(ob, pb) / F.greatest(F.lit(1.0), (ob.x2 - ob.x1) * (ob.y2 - ob.y1)) >= 0.45
    on_torso = c.x.between(pb.x1 - 0.1 * w, pb.x2 + 0.1 * w) & c.y.between(pb.y1 + 0.15 * h, pb.y2 - 0.15 * h)
    return o.join(p, (F.col("o.video_id") == F.col("p.video_id")) & (F.col("o.frame") == F.col("p.frame")) & on_torso & covered, "left_semi")


def needs_colour_fallback(det: DataFrame) -> DataFrame:
    """Frames with no object left once body-latched boxes are set aside."""
    objects, persons = det.where(~F.col("is_person")), det.where("is_person")
    latched = latched_on_body(objects, persons).select(*FRAME, "det_id")
    real = objects.join(latched, [*FRAME, "det_id"], "left_anti").select(*FRAME)
    return det.select(*FRAME).distinct().join(real, FRAME, "left_anti")


def best_overlap(objects: DataFrame, persons: DataFrame, wrap: float = 0.4) -> DataFrame:
    """Largest person IoU per object, and whether the box wraps a person."""
    p = prefixed(persons.select(*FRAME, *BOX), "p_")
    ob, pb = geom.box(), geom.box("p_")
    best = objects.join(p, FRAME, "left").groupBy(*FRAME, "det_id").agg(
        F.coalesce(F.max(geom.iou(ob, pb)), F.lit(0.0)).alias("person_iou"))
    return best.withColumn("wraps_person", F.col("person_iou") >= wrap)


def agreeing_proposals(det: DataFrame, proposals: str = "novelty", known: str = "yolo", min_iou: float = 0.1) -> DataFrame:
    """Proposal boxes that some known-class box confirms (centre inside, or overlap)."""
    n = det.where((F.col("source") == proposals) & ~F.col("is_person")).alias("n")
    k = prefixed(det.where((F.col("source") == known) & ~F.col("is_person")).select(*FRAME, *BOX), "k_").alias("k")
    nb, kb = geom.Box(*(F.col(f"n.{x}") for x in BOX)), geom.box("k_")
    hit = geom.center_inside(nb, kb) | (geom.iou(nb, kb) > min_iou)
    return n.join(k, (F.col("n.video_id") == F.col("k.video_id")) & (F.col("n.frame") == F.col("k.frame")) & hit, "left_semi")


def confirmed_observations(tracks: DataFrame, ordinal: str, n: int = 3) -> DataFrame:
    """a track counts from its n-th observation on."""
    return tracks.where(F.col(ordinal) >= n)


def last_seen(tracks: DataFrame, keys: Sequence[str], within: int, prune: int) -> DataFrame:
    """per track, whether it is active or stale against the video's newest frame."""
    seen = tracks.groupBy(*keys).agg(F.max("frame").alias("last_frame"))
    newest = seen.groupBy("video_id").agg(F.max("last_frame").alias("newest"))
    out = seen.join(newest, "video_id")
    return out.select(*keys, "last_frame", (F.col("last_frame") >= F.col("newest") - within).alias("active"),
                      (F.col("last_frame") < F.col("newest") - prune).alias("stale"))
