"""Event clusters dealt over groups against the whole fold, and components against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from trackspark.operators import components, relations


def test_components_match_a_plain_search(spark):
    rng = random.Random(4)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(7, 5000 + i) for i in range(300)] + [(9999, 9999)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {n: n for link in links for n in link}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert found == {n: root(n) for n in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_one_hot_job_is_many_groups_with_the_same_clusters(spark, seed):
    rng = random.Random(seed)
    rows = [(1 if rng.random() < 0.9 else 2, float(rng.randrange(6000)), i, rng.choice([None, *range(60)]), rng.choice([None, *range(90)]), rng.random()) for i in range(700)]
    rows += [(3, 1.0, 900, None, None, 0.5), (3, 1.0, 901, None, None, 0.5), (3, 2.0, 902, 1, None, 0.5), (3, 3.0, 903, 1, None, 0.7)]
    e = spark.createDataFrame(rows, "job_id long, sec double, event_id long, actor_uid long, object_uid long, confidence double")
    whole = sorted(map(tuple, relations.clusters(e, "job_id").collect()))
    assert sorted(map(tuple, relations.clusters(e, "job_id", split=True).collect())) == whole and len(whole) > 300
    groups = relations.cluster_groups(e, "job_id", 30.0, 15.0)
    assert groups.count() == len(rows)
    sizes = groups.where("job_id = 1").groupBy("group").count().agg(F.count("*"), F.max("count")).first()
    assert sizes[0] > 20 and sizes[1] < 500
