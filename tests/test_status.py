"""Nested status updates against a plain merge."""

import json
import random

from trackspark.operators import status


def plain_merge(into: dict, update: dict) -> None:
    for k, v in update.items():
        if isinstance(v, dict) and isinstance(into.get(k), dict):
            plain_merge(into[k], v)
        else:
            into[k] = v


def flat(doc: dict, path: tuple = ()):
    for k, v in doc.items():
        if isinstance(v, dict) and v:
            yield from flat(v, (*path, k))
        else:
            yield (*path, k), json.loads(json.dumps(v))


def test_merge_matches_a_plain_one(spark):
    rng = random.Random(5)

    def value(depth):
        if depth < 3 and rng.random() < 0.6:
            return {rng.choice("abc"): value(depth + 1) for _ in range(rng.randrange(3))}
        return rng.choice([1, 2.5, "x{", "{}", True, None, [1, {"a": 2}], "ö"])

    rows, expected = [], {}
    for camera in range(40):
        held = {}
        for at in range(rng.randrange(1, 14)):
            doc = {rng.choice("abc"): value(1) for _ in range(rng.randrange(3))}
            rows.append((camera, at, json.dumps(doc)))
            plain_merge(held, json.loads(json.dumps(doc)))
        expected[camera] = dict(flat(held))
    rows += [(0, 99, "no json"), (0, 98, None), (0, 97, "[1]"), (0, 96, "3")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "camera long, at long, doc string")
    out = status.merged(status.latest(status.entries(df, ["camera"], "at", "doc"), ["camera"], "at"), ["camera"])
    found = {c: {} for c in range(40)}
    for r in out.collect():
        assert tuple(r.path) not in found[r.camera]
        found[r.camera][tuple(r.path)] = json.loads(r.value)
    assert found == expected


def test_deeper_objects_are_values(spark):
    df = spark.createDataFrame([(1, 1, '{"a": {"b": {"c": 1}}}')], "camera long, at long, doc string")
    got = lambda d: [(r.path, r.value) for r in status.entries(df, ["camera"], "at", "doc", depth=d).where("not is_object").collect()]
    assert got(2) == [(["a", "b"], '{"c":1}')] and got(3) == got(4) == [(["a", "b", "c"], "1")]
