"""Registered queries against their oracles on the smallest tables.

A sample of every family runs by default; TRACKSPARK_ALL=1 runs all of them.
"""

import os

import pytest

from helpers import compare
from trackspark import plans

LISTED = {name: sql for name, sql in plans.listing().items() if sql is not None}
SAMPLE = ["flagship_object_owners", "p12_pose_score", "p14_point_in_polygon", "p28_rejection_ladder", "u02_pooled_dedup", "j07_zone_membership", "w04_longest_runs", "w14_baseline_change",
          "f07_min_interval_throttle", "t14_sessions", "j17_temporal_match", "a05_scenario_metrics", "a08_track_quality", "a18_stage_latency", "j11_closest_record", "t13_event_clusters",
          "t06_scripted_scenes", "t06_actors_in_a_crowd", "t09_continuity", "t12_tier_ladder", "j21_tier_arbitration", "src09_coco", "snk07_label_files", "u08_seeded_split", "t06_scenes_stream",
          "t14_resets_stream", "t03_colour_tracks", "t15_recent_stream", "t10_idle_stream", "snk02_metadata_files", "snk04_appended_crops", "snk06_audit_markdown", "snk08_pin_overwrite"]


@pytest.mark.parametrize("name", sorted(LISTED) if os.environ.get("TRACKSPARK_ALL") else SAMPLE)
def test_query_matches_oracle(spark, name):
    compare(spark, name)


def test_listing_is_current(spark):
    from trackspark.plans import export

    assert export.current() == plans.listing()
