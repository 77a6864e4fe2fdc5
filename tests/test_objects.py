"""Physical objects dealt over groups against the whole fold."""

import random

import pytest
from pyspark.sql import functions as F

from trackspark.operators import audit

SCHEMA = "video_id long, track_id long, first_frame long, last_frame long, cx double, cy double"


def busy(seed: int, n: int) -> list[tuple]:
    """One video that is never quiet: a long track keeps it alive, places are shared by several tracks."""
    rng = random.Random(seed)
    rows = [(1, 0, 0, 4000, -500.0, -500.0)]
    for i in range(1, n):
        first, place = rng.randrange(4000), rng.randrange(40)
        rows.append((1 if rng.random() < 0.9 else 2, i, first, first + rng.randrange(30), 90.0 * (place % 8) + rng.uniform(-25, 25), -60.0 * (place // 8) + rng.uniform(-25, 25)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_do_not_change_the_objects(spark, seed):
    tracks = spark.createDataFrame(busy(seed, 900), SCHEMA)
    whole = sorted(map(tuple, audit.physical_objects(tracks, 8, 30.0).collect()))
    assert sorted(map(tuple, audit.physical_objects(tracks, 8, 30.0, split=True).collect())) == whole
    assert len(whole) == 900 and len({r[2] for r in whole}) < 880
    sizes = audit.object_groups(tracks, 8, 30.0).groupBy("video_id", "group").count().agg(F.count("*"), F.max("count")).first()
    assert sizes[0] > 50 and sizes[1] < 300


def test_ties_borders_and_no_tracks(spark):
    rows = [(1, 1, 0, 5, 29.0, 0.0), (1, 2, 13, 20, 59.0, 0.0), (1, 3, 29, 30, 59.0, 0.0), (2, 4, 0, 5, 0.0, 0.0), (2, 5, 0, 5, 0.0, 60.0), (2, 6, 6, 9, 0.0, 30.0)]
    tracks = spark.createDataFrame(rows, SCHEMA)
    found = {r.track_id: r.object_id for r in audit.physical_objects(tracks, 8, 30.0, split=True).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5} == {r.track_id: r.object_id for r in audit.physical_objects(tracks, 8, 30.0).collect()}
    assert audit.physical_objects(tracks.limit(0), 8, 30.0, split=True).collect() == []
