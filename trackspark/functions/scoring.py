"""Scores, gates and labels over finished pair rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackspark.config import Thresholds


def unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def association_score(norm_distance: Column, contained: Column, confidence: Column, cfg: Thresholds) -> Column:
    proximity = F.greatest(F.lit(0.0), 1.0 - norm_distance / max(cfg.near_distance_ratio * 2.0, 1e-6))
    return 0.55 * proximity + 0.25 * contained + 0.20 * F.least(F.lit(1.0), confidence / max(cfg.detection_high_conf, 1e-6))


def blended(score: Column, pose: Column, blend: float) -> Column:
    w = min(1.0, max(0.0, blend))
    return F.coalesce((1.0 - w) * score + w * pose, score)


def colour_confidence(purity: Column, area: Column, min_area: float = 900) -> Column:
    return F.greatest(F.lit(0.0), F.least(
        F.lit(0.95), 0.35 + 0.45 * purity + 0.20 * F.least(F.lit(1.0), area / max(1.0, min_area * 4))))


def novelty_confidence(hits: Column, max_area: Column, min_area: float = 600, stationary: int = 8, floor: float = 0.40) -> Column:
    persistence = F.least(F.lit(1.0), hits / max(1, stationary * 2))
    return F.greatest(F.lit(floor), F.least(
        F.lit(0.95), 0.35 + 0.30 * persistence + 0.35 * F.least(F.lit(1.0), max_area / max(1.0, min_area * 4.0))))


def evidence(row, cfg: Thresholds) -> dict[str, Column]:
    """The five weighted scores and the final confidence of a pair; `row` maps field -> Column."""
    abandoned = row("abandonment_frames") >= cfg.min_abandonment_frames
    settled = (row("stationary_frames") >= cfg.min_stationary_frames) & row("state").isin("BAG_ON_GROUND", "PERSON_DEPARTED")
    carry = F.least(F.lit(1.0), row("carried_frames") / max(1, cfg.min_carried_frames))
    release = F.when(row("release_frame").isNotNull(), 1.0).otherwise(0.0)
    stationary = F.when(abandoned, 1.0).otherwise(
        F.least(F.lit(1.0), row("stationary_frames") / max(1, cfg.min_stationary_frames)))
    departure = F.when(abandoned | settled, 1.0).otherwise(F.least(F.lit(1.0), row("max_departure_ratio")))
    association = row("mean_association")
    detection = F.least(F.lit(1.0), row("mean_confidence") / max(cfg.detection_high_conf, 1e-6))
    fallback = F.when(row("fallback_frames") <= 0, 1.0).when(row("yolo_reconfirmed"), 0.95).otherwise(0.90)
    limit = cfg.max_other_person_closer_frames
    closer = row("other_person_closer_frames")
    other = F.when(closer > limit, 0.0).when(
        closer > 0, F.greatest(F.lit(0.50), 1.0 - (closer / float(limit + 1)) * 0.5)).otherwise(1.0)
    base = 0.25 * carry + 0.15 * release + 0.25 * stationary + 0.25 * departure + 0.10 * association
    return {"carry_score": carry, "release_score": release, "stationary_score": stationary, "departure_score": departure,
            "association_score": association, "detection_score": detection,
            "confidence": unit(base * detection * fallback * other)}


def separation_floor(cfg: Thresholds, hard_min: float = 0.08) -> float:
    return max(cfg.release_distance_floor, hard_min)


def separation(row, cfg: Thresholds) -> tuple[Column, Column]:
    """(ticks of separation needed, whether the object physically left the person)."""
    floor = separation_floor(cfg)
    clear = (row("ground_evidence_frames") > 0) & (row("max_post_release_norm_distance") >= max(floor, 0.25))
    needed = F.when(clear, F.lit(1)).otherwise(F.lit(max(2, cfg.feet_release_frames)))
    return needed, (row("max_post_release_norm_distance") >= floor) & (row("separated_frames") >= needed)


def rejection(row, confidence: Column, cfg: Thresholds) -> Column:
    """First failing gate, NULL when the pair may be confirmed. The order of gates is the contract."""
    gripped = row("ever_attached") | row("ever_wrist_near")
    released = row("release_frame").isNotNull()
    need = F.when(row("ever_attached"), max(2, cfg.min_carried_frames - 1)).otherwise(max(2, cfg.min_carried_frames - 2))
    quick = (row("carried_frames") >= need) & released & (
        (row("max_post_release_norm_distance") >= separation_floor(cfg))
        | (row("separated_frames") >= max(1, cfg.feet_release_frames - 1)))
    gripped_drop = row("ever_attached") & (row("carried_frames") >= 2) & released
    abandoned = row("abandonment_frames") >= cfg.min_abandonment_frames
    departed = row("departure_frame").isNotNull() & (row("max_departure_ratio") >= 1.0)
    bin_ticks, ground = row("bin_zone_frames"), row("ground_evidence_frames")
    synthetic = row("hand_separated") & gripped & (bin_ticks == 0) & (
        row("carried_frames") <= max(6, cfg.min_carried_frames + 2))
    no_ground = F.lit(cfg.require_ground_confirmation) & (ground <= 0)
    credited = F.when(no_ground & synthetic, F.lit(1)).otherwise(ground)
    _, apart = separation(lambda name: credited if name == "ground_evidence_frames" else row(name), cfg)
    moved = row("max_object_displacement") >= max(0.12, cfg.bag_move_norm * 2.0) * F.greatest(
        row("release_person_height"), F.lit(80.0))
    ladder = [
        (row("bag_seen_frames") == 0, "BAG_NOT_DETECTED"),
        (row("release_invalid") & ~row("live_release_ground_ok"), "NO_RELEASE_TRANSITION"),
        (row("fallback_gap_frames") > cfg.max_fallback_tracker_gap_frames, "BAG_NOT_DETECTED"),
        (row("mean_confidence") < cfg.detection_low_conf, "LOW_BAG_CONFIDENCE"),
        (row("person_seen_frames") < cfg.min_carried_frames, "PERSON_NOT_DETECTED"),
        ((row("carried_frames") < cfg.min_carried_frames) & ~quick & ~gripped_drop, "NOT_ENOUGH_CARRIED_FRAMES"),
        (~released, "NO_RELEASE_TRANSITION"),
        (~(abandoned | departed), "PERSON_DID_NOT_DEPART"),
        ((row("stationary_frames") < cfg.min_stationary_frames) & ~abandoned, "BAG_NOT_STATIONARY"),
        (row("other_person_closer_frames") > cfg.max_other_person_closer_frames, "OTHER_PERSON_CLOSER"),
        (row("ambiguous_frames") > max(2, cfg.smoothing_window), "ASSOCIATION_AMBIGUOUS"),
        ((bin_ticks > 0) & (bin_ticks >= F.greatest(F.lit(1), ground)), "BIN_ZONE_DEPOSIT"),
        (no_ground & ~synthetic & (bin_ticks > 0), "BIN_ZONE_DEPOSIT"),
        (no_ground & ~synthetic, "BIN_DISPOSAL"),
        (row("ever_contained") & (~apart | ~moved) & ~(row("hand_separated") & (bin_ticks == 0) & gripped),
         "NO_PHYSICAL_SEPARATION"),
        (confidence < cfg.min_event_confidence, "EVENT_CONFIDENCE_TOO_LOW"),
    ]
    return F.coalesce(*(F.when(test, F.lit(reason)) for test, reason in ladder))


def location_status(bin_ticks: Column, ground: Column) -> Column:
    return (F.when((bin_ticks > 0) & (bin_ticks >= F.greatest(F.lit(1), ground)), "BIN_ZONE")
            .when(ground > 0, "GROUND_CONFIRMED").when(bin_ticks > 0, "BIN_ZONE").otherwise("LOCATION_AMBIGUOUS"))


def confidence_bucket(c: Column) -> Column:
    return F.when(c < 0.5, "0-50%").when(c < 0.7, "50-70%").when(c < 0.85, "70-85%").otherwise("85-100%")


def percent_text(c: Column) -> Column:
    return F.coalesce(F.concat(F.floor(c * 100 + 0.5).cast("string"), F.lit("%")), F.lit("-"))


def source_label(sources: Column) -> Column:
    yolo, color = F.array_contains(sources, "yolo"), F.array_contains(sources, "color")
    return (F.when(yolo & color, "yolo_and_color").when(color, "color_fallback_only").when(yolo, "yolo_only")
            .otherwise("none"))


def box_tightness(person_iou: Column, area_share: Column, height_share: Column) -> Column:
    """Whether a box is usable as a training label and how tight it is."""
    return (F.when(person_iou >= 0.40, "unusable_contains_person")
            .when((area_share >= 0.40) | (height_share >= 0.80), "unusable_huge_box")
            .when(area_share >= 0.08, "loose").otherwise("tight"))
