"""Structured Streaming hosts of the stateful operators.

The rules are those of the batch operators; a host keeps their state per key and feeds it the
ticks of each micro-batch. Late policy, which is this engine's own choice: rows up to the
watermark are ordered by time within a batch; rows older than what a key already processed are
dropped. Sinks are files, and checkpoints live in the cluster's shared folder.
"""

from __future__ import annotations

import itertools
import json
import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from trackspark.config import Thresholds
from trackspark.operators import status
from trackspark.operators.identity import _People, _Things
from trackspark.operators.pairfeatures import MARKS
from trackspark.operators.pairfsm import EVENT_SCHEMA, Machine
from trackspark.session import scratch_path
from trackspark.streaming import processors


#: Keyed state with timers needs this store.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, label: str, mode: str = "append", checkpoint: str | None = None) -> tuple[DataFrame, int]:
    """Run a stream over everything available into Parquet; its rows, and how many came too late for the watermark.

    With the `checkpoint` of an earlier run it goes on from there, and the rows of all runs are returned.
    """
    spark: SparkSession = stream.sparkSession
    out = f"{checkpoint}-rows" if checkpoint else scratch_path(spark, label)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-checkpoint")).trigger(availableNow=True).start(out)
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    late = sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)
    return spark.read.schema(stream.schema).parquet(out), late


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """`drained` without the count; the batch form of a stream."""
    return drained(stream, label, mode)[0]


def ordered(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """All rows of one key in a micro-batch, in order; a micro-batch bounds their number."""
    return pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")


def by_frame(pdf: pd.DataFrame, columns: Sequence[str]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of each frame as tuples without it; `pdf` is ordered by frame. A pandas group for each frame would cost more than the rule."""
    rows = zip(pdf["frame"].tolist(), zip(*(pdf[c].tolist() for c in columns)))
    for frame, part in itertools.groupby(rows, key=lambda r: r[0]):
        yield frame, [values for _, values in part]


def observed_resets(ticks: DataFrame, empty: float = 30.0, longest: float = 3600.0, apart: float = 60.0) -> DataFrame:
    """Session resets of live cameras: scene empty for a while, or session too long, debounced.

    `ticks`: video_id, sec, person_count. One output row per reset.
    """

    def step(key, batches, state):
        started, last_reset, since, seen = state.get if state.exists else (None, -1e18, None, -1e18)
        out = []
        for sec, people in ordered(batches, ["sec"])[["sec", "person_count"]].itertuples(index=False):
            if sec < seen:
                continue
            seen, started = sec, sec if started is None else started
            since = None if people > 0 else (sec if since is None else since)
            if sec - last_reset >= apart and ((since is not None and sec - since >= empty) or sec - started >= longest):
                out.append((key[0], float(sec)))
                last_reset, started, since = sec, sec, None
        state.update((started, last_reset, since, seen))
        yield pd.DataFrame(out, columns=["video_id", "reset_sec"])

    return ticks.groupBy("video_id").applyInPandasWithState(
        step, "video_id bigint, reset_sec double", "started double, last_reset double, since double, seen double", "append", GroupStateTimeout.NoTimeout)


def throttle(ticks: DataFrame, interval: float) -> DataFrame:
    """F7 on a stream: keep a tick at least `interval` after the last kept one of its key."""

    def step(key, batches, state):
        last = state.get[0] if state.exists else -1e18
        pdf = ordered(batches, ["sec", "event_id"])
        keep = []
        for sec in pdf["sec"]:
            keep.append(sec >= last + interval)
            last = sec if keep[-1] else last
        state.update((float(last),))
        yield pdf[keep][["video_id", "sec", "event_id"]]

    return ticks.groupBy("video_id").applyInPandasWithState(step, "video_id bigint, sec double, event_id bigint", "last double", "append", GroupStateTimeout.NoTimeout)


def uid_stream(boxes: DataFrame) -> DataFrame:
    """T1/T2 on a stream: stable uids per video; a frame must not be split over micro-batches.

    `boxes`: video_id, frame, det_id, is_person, track_id, cx, cy, h, area, family, and the landmark columns of the
    batch operator (NULL or NaN where missing), which decide between persons as they do there.
    """

    def step(key, batches, state):
        people, things = _People(), _Things()
        if state.exists:
            saved = json.loads(state.get[0])
            people.known, people.next = {int(k): v for k, v in saved["known"]}, saved["p_next"]
            people.seen = {int(u): (at, tuple(shape)) for u, at, shape in saved["seen"]}
            things.ticks, things.next = saved["ticks"], saved["t_next"]
            things.records = {int(u): (*r[:4], set(r[4])) for u, r in saved["records"]}
        out = []
        pdf = ordered(batches, ["frame", "det_id"]).astype({m: float for m in MARKS})
        for frame, rows in by_frame(pdf, ["det_id", "is_person", "track_id", "cx", "cy", "h", *MARKS, "area", "family"]):
            p, t = [r for r in rows if r[1]], [r for r in rows if not r[1]]
            out += [(key[0], frame, r[0], uid) for r, uid in zip(p, people.tick(frame, [(r[2], r[3:-2]) for r in p]))]
            out += [(key[0], frame, r[0], uid) for r, uid in zip(t, things.tick([(r[3], r[4], *r[-2:]) for r in t]))]
        state.update((json.dumps({
            "known": list(people.known.items()), "p_next": people.next, "seen": [(u, at, shape) for u, (at, shape) in people.seen.items()],
            "ticks": things.ticks, "t_next": things.next, "records": [(u, [*r[:4], sorted(r[4])]) for u, r in things.records.items()]}),))
        yield pd.DataFrame(out, columns=["video_id", "frame", "det_id", "uid"])

    return boxes.groupBy("video_id").applyInPandasWithState(
        step, "video_id bigint, frame bigint, det_id bigint, uid bigint", "saved string", "append", GroupStateTimeout.NoTimeout)


def pair_stream(rows: DataFrame, configs: dict[str, Thresholds], idle_ms: int | None = None) -> DataFrame:
    """X1 on a stream of `pairfeatures.tick_rows`: the batch machine, kept per (video, session, config).

    The machine's plain data is the state; the sessions of a share are kept together, so a call and a state are many sessions'. A
    marker row of kind 9 ends a session (T11); with `idle_ms` one that receives nothing for that long is ended by a timer as well.
    """
    def step(key, batches, state):
        # Session -> when it last received something, its machine.
        held = {} if not state.exists else pickle.loads(bytes(state.get[0]))
        now = state.getCurrentProcessingTimeMs() if idle_ms is not None else 0
        given, out = {}, []
        for pdf in batches if not state.hasTimedOut else ():
            for whose, text in zip(pdf["whose"].tolist(), pdf["tick"].tolist()):
                given.setdefault(whose, []).append(text)
        for whose, texts in given.items():
            # As text, since pandas makes doubles of whole numbers beside missing ones.
            whose = tuple(json.loads(whose).values())
            machine = Machine(configs[whose[2]], False)
            if whose in held:
                machine.restored(held[whose][1])
            ticks = sorted(map(processors._unpacked, texts), key=lambda r: (r[0], r[1], r[processors._PERSON] or 0, r[processors._OBJECT] or 0))
            for frame, part in itertools.groupby((r for r in ticks if r[1] != processors.END), key=lambda r: r[0]):
                if frame > machine.frame or (machine.frame == 0 and not machine.pairs):
                    out += [whose + r for r in machine.tick(frame, list(part))]
            if any(r[1] == processors.END for r in ticks):
                out += [whose + r for r in machine.finish()]
                held.pop(whose, None)
            else:
                held[whose] = (now, machine.saved())
        for whose in [w for w, (at, _) in held.items() if idle_ms is not None and at + idle_ms <= now]:
            out += [whose + r for r in Machine(configs[whose[2]], False).restored(held.pop(whose)[1]).finish()]
        if held:
            state.update((pickle.dumps(held),))
            if idle_ms is not None:
                state.setTimeoutDuration(max(1, min(at for at, _ in held.values()) + idle_ms - now))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=processors.EVENT_COLUMNS, dtype=object)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms is not None else GroupStateTimeout.NoTimeout
    given = rows.select(processors.share(processors.SESSION), processors._packed(processors.SESSION).alias("whose"), processors._packed().alias("tick"))
    return given.groupBy("_share").applyInPandasWithState(step, EVENT_SCHEMA, "saved binary", "append", timeout)


def latest_per_camera(ticks: DataFrame) -> DataFrame:
    """T16/T17 on a stream: newest tick and last known fields per camera, as an updating aggregate."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy("video_id").agg(F.max_by("value", at).alias("value"), F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"), F.max("ts").alias("ts"))


def upsert(path: str, keys: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: every batch's newest row per key is the partition of its epoch; readers take the last version.

    A replayed epoch overwrites its own partition, so it counts once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), version).alias("m")).select("m.*")
        newest.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def merged_status(updates: DataFrame, keys: list[str], at: str, doc: str, label: str) -> DataFrame:
    """T17 on a stream: partial nested updates in any order; the status after everything available, as `status.merged` has it.

    State is a row per key and path. Every micro-batch writes the paths it changed as one epoch, a replayed epoch replaces itself,
    and the last version of a path counts.
    """
    spark = updates.sparkSession
    state = status.latest(status.entries(updates, keys, at, doc), keys, at).withColumn("_version", F.greatest("value_at", "object_at"))
    path = scratch_path(spark, label)
    writer = state.writeStream.outputMode("update").foreachBatch(upsert(path, [*keys, "path"], "_version"))
    writer.option("checkpointLocation", scratch_path(spark, f"{label}-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    columns = [c for c in state.columns if c not in (*keys, "path", "_version")]
    newest = spark.read.parquet(path).groupBy(*keys, "path").agg(F.max_by(F.struct(*columns), "epoch").alias("m")).select(*keys, "path", "m.*")
    return status.merged(newest, keys)
