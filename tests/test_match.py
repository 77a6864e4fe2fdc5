"""The table function of temporal matching against a plain greedy matching and the fold."""

import random

from trackspark.operators import evaluate


def plain(truths, preds, delta):
    used, out = set(), []
    for t, event in sorted(preds):
        near = min(((abs(t - s), s, g) for s, g in truths if g not in used), default=None)
        hit = near is not None and near[0] <= delta
        if hit:
            used.add(near[2])
        out.append((event, near[2] if hit else None, near and near[0], "TP" if hit else "FP"))
    return out


def test_table_function_matches_plain_greedy_matching(spark):
    evaluate.register(spark)
    rng, rows, expected = random.Random(3), [], []
    for clip in range(60):
        side = lambda base: [(float(rng.randrange(25)) / 2, base + i) for i in range(rng.randrange(14))]
        gt, pred = side(100), side(500)
        rows.append((clip, gt, pred))
        expected += [(clip, *r) for r in plain(gt, pred, 1.5)]
    df = spark.createDataFrame(rows, "clip long, gt array<struct<sec: double, event_id: long>>, pred array<struct<sec: double, event_id: long>>")
    found = spark.sql("SELECT clip, m.* FROM {df} s, LATERAL temporal_match(s.gt, s.pred, 1.5D) m", df=df).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_table_function_takes_missing_lists_and_elements(spark):
    evaluate.register(spark)
    one = "array(named_struct('sec', 1.0D, 'event_id', 7L), NULL, named_struct('sec', CAST(NULL AS DOUBLE), 'event_id', 8L))"
    kind = "array<struct<sec: double, event_id: bigint>>"
    got = lambda a, b: [tuple(r) for r in spark.sql(f"SELECT m.* FROM (SELECT 1) s, LATERAL temporal_match({a}, {b}, 3.0D) m").collect()]
    assert got(f"CAST(NULL AS {kind})", one) == [(7, None, None, "FP")]
    assert got(one, f"CAST(NULL AS {kind})") == []
    assert got(one, one) == [(7, 7, 0.0, "TP")]
