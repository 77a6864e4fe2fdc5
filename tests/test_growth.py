"""Steps whose work must not outgrow their input."""

import io
from contextlib import redirect_stdout
from types import SimpleNamespace

from helpers import SF
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from trackspark import plans
from trackspark.functions import geom
from trackspark.operators import assoc, components, longseq, pairfsm, relations, tiers
from trackspark.plans import registry, scenes
from trackspark.session import INITIAL, prepare, scratch_path
from trackspark.streaming import processors


def explained(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("simple")
    return text.getvalue()


def test_next_values_are_read_backwards(spark):
    rows = spark.range(1, 40).select(F.lit(1).alias("k"), F.col("id").alias("n"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    out = longseq.running(rows, ["k"], "n", {"following": ("next", F.col("v")), "before": ("last", F.col("v"))}, size=5)
    assert "unboundedfollowing" not in explained(out)
    got = {r.n: (r.before, r.following) for r in out.collect()}
    assert got == {n: (n // 7 * 7 or None, -(-n // 7) * 7 if n <= 35 else None) for n in range(1, 40)}


def counted(monkeypatch, module, name: str) -> list[list[int]]:
    """Row counts of the tables that a function of a module is given, call by call."""
    calls, plain = [], getattr(module, name)

    def watched(*args, **kw):
        calls.append([a.count() for a in args if isinstance(a, DataFrame)])
        return plain(*args, **kw)

    monkeypatch.setattr(module, name, watched)
    return calls


def test_targets_of_one_time_are_looked_up_once(spark, monkeypatch):
    records = spark.createDataFrame([(1, 10, 100), (1, 20, 200), (2, 5, 300)], "k int, t long, r long")
    targets = spark.range(3000).select((F.col("id") % 2 + 1).cast("int").alias("k"), (F.col("id") % 3 * 7).alias("t"), F.col("id").alias("q"))
    sequences = counted(monkeypatch, longseq, "running")
    found = {r.q: r.r for r in relations.nearest(targets, records, ["k"], "t", "q", "r", 8).collect()}
    want = {1: {0: 100, 7: 100, 14: 100}, 2: {0: 300, 7: 300, 14: 300}}
    assert found == {q: want[q % 2 + 1][q % 3 * 7] for q in range(3000)}
    assert sequences == [[6 + 3]]


def test_zone_counts_test_copies_once(spark, monkeypatch):
    boxes = spark.range(4000).select((F.col("id") % 2).alias("camera_id"), (F.col("id") % 5 * 20.0).alias("x1"), F.lit(10.0).alias("y1"), (F.col("id") % 5 * 20.0 + 10).alias("x2"), F.lit(20.0).alias("y2"))
    zones = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("camera_id"), F.col("id").cast("string").alias("zone"), geom.polygon_from_box(
        geom.Box(F.lit(0.0), F.lit(0.0), F.when(F.col("id") % 4 == 0, 0.2).otherwise(0.5), F.lit(0.5))).alias("polygon"))
    plain = assoc.in_zones(boxes, zones, 100, 100).groupBy("camera_id", "zone").agg(F.count(F.lit(1)).alias("n")).collect()
    tested = counted(monkeypatch, assoc, "in_zones")
    out = assoc.zone_counts(boxes, zones, ["camera_id"], "zone", 100, 100).collect()
    assert out and sorted(map(tuple, out)) == sorted(map(tuple, plain))
    # Places of boxes, and shapes of zones by scope.
    assert tested[0][0] <= 10 and tested[0][1] <= 6


def test_polygons_of_known_corners_are_compiled(spark):
    corners = [(0.1, 0.1), (0.6, 0.2), (0.5, 0.7), (0.2, 0.5)]
    polygon = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in corners))
    rows = spark.range(400).select((F.col("id") % 20 / 20.0).alias("x"), F.when(F.col("id") % 37 > 0, F.floor(F.col("id") / 20) / 20.0).alias("y"))
    known = geom.in_corners([geom.Point(F.lit(x), F.lit(y)) for x, y in corners], F.col("x"), F.col("y"))
    both = rows.select(known.alias("known"), geom.in_polygon(polygon, F.col("x"), F.col("y")).alias("given"))
    assert both.where("known").count() > 50 and both.where("not (known <=> given)").isEmpty()
    assert "aggregate(" not in explained(rows.select(known))
    plans.load()
    assert "aggregate(" not in explained(registry.QUERIES["p14_point_in_polygon"](spark, SF))


def test_micro_batches_grow_in_number_and_not_in_size(spark, monkeypatch):
    from trackspark.plans import streams
    monkeypatch.setattr(streams, "KEY_ROWS", 50)
    rows = spark.range(1000).select(F.lit(1).alias("video_id"), F.col("id").alias("frame"))
    stream = streams.in_batches(rows, "frame", "growing")
    path, sizes = scratch_path(spark, "sizes"), []
    stream.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.agg(F.count("frame"), F.min("frame"), F.max("frame")).first())).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    assert sum(n for n, _, _ in sizes) == 1000 and max(n for n, _, _ in sizes) <= 60
    # Ranges follow each other, none is split.
    assert all(high - low + 1 == n for n, low, high in sizes) and [low for _, low, _ in sizes] == sorted(low for _, low, _ in sizes)


class Waiting:
    """A store and a clock in memory, for one key of the ladder."""

    def __init__(self):
        self.held, self.state, self.timers, self.read = [], None, set(), 0

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return SimpleNamespace(exists=lambda: self.state is not None, get=lambda: self.state, update=lambda v: setattr(self, "state", v))

    def get(self):
        self.read += len(self.held)
        return iter(list(self.held))

    def put(self, rows):
        self.held = list(rows)

    def appendList(self, rows):
        self.held += rows

    def clear(self):
        self.held = []

    def registerTimer(self, at):
        self.timers.add(at)


def test_a_ladder_reads_what_waits_once_and_not_for_every_decision():
    store, ladder = Waiting(), processors.Ladder(["actor", "event", "outcome"], 6.0)
    ladder.init(store)
    make = Row(*processors.Ladder.COLUMNS, "kind")
    assert not list(ladder.handleInputRows((1,), iter([make(100.0 + i, 1, str(i), 97.0 + i, True, "", True, 0) for i in range(200)]), None))
    out = []
    while due := sorted(t for t in store.timers if t <= 250_000):
        store.timers.discard(due[0])
        out += ladder.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 250_000), SimpleNamespace(getExpiryTimeInMs=lambda: due[0]))
    assert [r.event for r in out] == [str(i) for i in range(151)] and [r.event for r in out if r.outcome == "accepted"] == [str(i) for i in range(0, 151, 7)]
    assert store.timers == {251_000} and store.read == 200


def test_shuffles_start_with_many_shares(spark):
    prepare(spark)
    assert int(spark.conf.get(INITIAL)) >= 400
    spark.conf.set(INITIAL, 900)
    prepare(spark)
    assert spark.conf.get(INITIAL) == "900"
    spark.conf.unset(INITIAL)


def test_rows_of_configs_and_pairs_are_not_shuffled(spark):
    boxes, ticks, cast = scenes.play(spark, SF, scenes.LADDER)
    configs = tiers.ladder(scenes.FAST)
    plain, ordered = (pairfsm.pair_events(scenes.machine_rows(boxes, ticks, cast, configs, every=True, ordered=o), configs, ordered=o) for o in (False, True))
    text = explained(ordered)
    assert "Exchange" not in text[: text.index("Generate inline")]
    assert sorted(map(str, ordered.collect())) == sorted(map(str, plain.collect()))


def test_a_decided_pair_is_not_played_on():
    seen = pairfsm.Seen((1, 1, 2, 2, "bag", *[0.0] * 10, 0.0, *[False] * 11))
    for explain in (False, True):
        machine, pair = pairfsm.Machine(scenes.FAST, explain), pairfsm.Pair.begin(seen, 2, 3)
        pair.state, pair.emitted, pair.missing = pairfsm.CONFIRMED, True, 5
        machine.advance(pair, seen)
        assert (pair.person_ticks, pair.missing) == (int(explain), 0)


def test_rounds_of_components_shrink(spark, monkeypatch):
    """A chain whose nodes lie in no order: later rounds have few nodes and links left."""
    n = 600
    chain = spark.range(n - 1).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    tables = counted(monkeypatch, components, "written")
    least = spark.range(n).agg(F.min(F.xxhash64("id"))).first()[0]
    assert {(r.label, r.n) for r in components.components(chain).groupBy("label").agg(F.count("*").alias("n")).collect()} == {(least, n)}
    # Nodes and links, their pointers, two passes to the ends; what follows is a part of that.
    assert sum(c for (c,) in tables) <= 9 * n


def test_boxes_are_numbered_and_linked_once(spark):
    plans.load()
    text = explained(registry.QUERIES["t04_change_tracks"](spark, SF))
    assert "MapInArrow" not in text and "lineitem" not in text
