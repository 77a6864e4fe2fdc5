"""Thresholds of the pair analysis, their relaxed tiers and their learning steps.

`Thresholds` is what a run uses; `KNOBS` is the same as (name, default) pairs and is what config
tables, sweeps and overrides are joined against.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace


# Names and defaults of the recorded configuration files.
@dataclass(frozen=True)
class Thresholds:
    analysis_fps: float = 8.0
    detection_low_conf: float = 0.10
    detection_high_conf: float = 0.25
    min_carried_frames: int = 6
    min_stationary_frames: int = 8
    min_departed_frames: int = 2
    confirmation_grace_frames: int = 8
    near_distance_ratio: float = 0.25
    departure_distance_ratio: float = 1.25
    departure_motion_ratio: float = 0.65
    release_distance_ratio: float = 0.35
    stationary_distance_ratio: float = 0.15
    stationary_window_frames: int = 3
    stationary_max_pixel_step: float | None = None
    stationary_grace_frames: int = 3
    release_window_frames: int = 4
    feet_release_frames: int = 3
    carry_motion_norm_px: float = 8.0
    carry_motion_sync_ratio: float = 0.4
    bag_move_norm: float = 0.05
    release_distance_floor: float = 0.15
    aidm_release_gate_enabled: bool = True
    aidm_wrist_attach_ratio: float = 0.15
    aidm_wrist_separate_ratio: float = 0.20
    association_radius_ratio: float = 1.0
    min_abandonment_frames: int = 8
    require_ground_confirmation: bool = True
    ground_plane_margin_ratio: float = 0.40
    auto_calibrate: bool = True
    calibration_frames: int = 24
    min_event_confidence: float = 0.50
    max_fallback_tracker_gap_frames: int = 40
    max_track_gap_frames: int = 6
    max_object_jump_ratio: float = 1.5
    min_carry_origin_confidence: float = 0.40
    require_carry_origin_link: bool = True
    max_pair_age_frames: int = 30
    max_other_person_closer_frames: int = 3
    smoothing_window: int = 5
    association_margin: float = 0.15
    carrying_zone_vertical_start: float = 0.45
    carrying_zone_horizontal_margin: float = 0.75
    pose_association_enabled: bool = False
    pose_score_blend: float = 0.0
    pose_weight_wrist: float = 0.4
    pose_weight_zone: float = 0.3
    pose_weight_motion: float = 0.3
    pose_wrist_norm_ratio: float = 0.5
    pose_zone_horizontal_margin: float = 0.30
    pose_zone_vertical_above: float = 0.0
    pose_zone_vertical_below: float = 0.0
    pose_motion_norm_px: float = 20.0
    pose_motion_window: int = 3
    release_distance_adaptive_ratio: float = 1.6

    def with_overrides(self, **changes) -> "Thresholds":
        """New thresholds; unknown names are ignored (see `unknown_knobs` to report them)."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in changes.items() if k in known})


KNOBS = asdict(Thresholds())

# The relaxed tiers, each applied on top of the strict tier.
TIERS = [
    {},
    {"min_carried_frames": 4, "release_distance_ratio": 0.22, "release_distance_floor": 0.10,
     "release_window_frames": 6, "feet_release_frames": 2, "departure_motion_ratio": 0.45,
     "departure_distance_ratio": 0.90, "min_stationary_frames": 6, "stationary_max_pixel_step": 18.0,
     "stationary_grace_frames": 4, "min_abandonment_frames": 5, "max_pair_age_frames": 60,
     "max_fallback_tracker_gap_frames": 30, "min_event_confidence": 0.70},
    {"min_carried_frames": 3, "smoothing_window": 3, "release_distance_ratio": 0.12,
     "release_distance_floor": 0.06, "release_window_frames": 8, "feet_release_frames": 2,
     "departure_motion_ratio": 0.30, "departure_distance_ratio": 0.60, "min_departed_frames": 1,
     "min_stationary_frames": 4, "stationary_max_pixel_step": 30.0, "stationary_grace_frames": 5,
     "min_abandonment_frames": 3, "max_pair_age_frames": 90, "max_fallback_tracker_gap_frames": 45,
     "min_event_confidence": 0.62, "confirmation_grace_frames": 12},
]

# One bounded step per video that shows the reason, in this order.
LEARNING_STEPS = {
    "NOT_ENOUGH_CARRIED_FRAMES": [
        {"min_carried_frames": 4}, {"min_carried_frames": 3}, {"smoothing_window": 3}],
    "NO_RELEASE_TRANSITION": [
        {"release_distance_ratio": 0.22, "release_distance_floor": 0.10},
        {"release_window_frames": 6, "feet_release_frames": 2},
        {"release_distance_ratio": 0.12, "release_window_frames": 8}],
    "PERSON_DID_NOT_DEPART": [
        {"departure_motion_ratio": 0.45}, {"departure_distance_ratio": 0.85}, {"min_abandonment_frames": 5}],
    "BAG_NOT_STATIONARY": [
        {"stationary_max_pixel_step": 18.0}, {"min_stationary_frames": 6},
        {"min_stationary_frames": 4, "stationary_max_pixel_step": 30.0}],
    "PERSON_NOT_DETECTED": [{"max_pair_age_frames": 60}, {"max_pair_age_frames": 90}],
    "BAG_NOT_DETECTED": [{"max_fallback_tracker_gap_frames": 30}, {"max_fallback_tracker_gap_frames": 45}],
}

# Pair states in the order they are reached, and every rejection reason.
STATES = ["NO_BAG", "BAG_NEAR_PERSON", "BAG_CARRIED", "BAG_RELEASED", "BAG_ON_GROUND", "PERSON_DEPARTED",
          "PICKED_BACK_UP", "VIOLATION_CONFIRMED"]
REASONS = ["PERSON_NOT_DETECTED", "BAG_NOT_DETECTED", "LOW_BAG_CONFIDENCE", "CSRT_NOT_RECONFIRMED",
           "ASSOCIATION_AMBIGUOUS", "NOT_ENOUGH_CARRIED_FRAMES", "NO_RELEASE_TRANSITION", "BAG_NOT_STATIONARY",
           "PERSON_DID_NOT_DEPART", "OTHER_PERSON_CLOSER", "EVENT_CONFIDENCE_TOO_LOW", "PICKED_BACK_UP",
           "NO_CONFIDENT_EVENT", "BIN_ZONE_DEPOSIT", "BIN_DISPOSAL", "NO_PHYSICAL_SEPARATION"]


def unknown_knobs(names) -> list[str]:
    """Config keys that match no knob; novelty settings belong elsewhere and are not reported."""
    return sorted(n for n in names if n.lower() not in KNOBS and not n.upper().startswith("NOVELTY_"))


def tier_configs(base: Thresholds, learned: dict | None = None) -> list[Thresholds]:
    """Strict tier first, then each relaxed tier that differs from all before it."""
    strict = base.with_overrides(**(learned or {}))
    ladder = [strict]
    for spec in TIERS[1:]:
        tier = strict.with_overrides(**spec)
        if tier not in ladder:
            ladder.append(tier)
    return ladder
