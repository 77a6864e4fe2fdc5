"""Stable identities across tracker id churn.

Each operator streams one (video, session) in frame order and keeps only recent identities. Rows
keep all their columns on the way through, and the geometry a decision needs is prepared as
columns beforehand.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions import geom, labels
from trackspark.operators import folds, longseq
from trackspark.session import written

# Reach and age of each identity rule.
PERSON_AGE, PERSON_REACH, PERSON_MIN_SCORE = 45, 200.0, 0.35
OBJECT_AGE, OBJECT_REACH, OBJECT_SIZE_RATIO, FIRST_OBJECT_UID = 120, 220.0, 0.30, 100001
COLOUR_AGE, COLOUR_REACH = 60, 160.0
REGION_AGE, REGION_REACH, REGION_HITS = 12, 70.0, 8

_MARKS = ["lw_x", "lw_y", "rw_x", "rw_y", "torso_x", "torso_y"]
_SHAPE = ["_cx", "_cy", "_h", *(f"_{m}" for m in _MARKS)]


def _likeness(a: tuple, b: tuple) -> float:
    """Height ratio, and the share of landmarks seen on both that lie close together."""
    big = max(a[2], b[2])
    pairs = [(a[i], a[i + 1], b[i], b[i + 1]) for i in (3, 5, 7) if a[i] == a[i] and b[i] == b[i]]
    close = sum(math.hypot(ax - bx, ay - by) < 0.3 * big for ax, ay, bx, by in pairs)
    return 0.6 * min(a[2], b[2]) / big + (0.4 * close / len(pairs) if pairs else 0.0)


class _People:
    """A known raw id keeps its uid; a new one may take over a recently lost uid. A missing raw id is new each time."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}
        self.seen: dict[int, tuple[int, tuple]] = {}
        self.next = 1

    def tick(self, frame: int, rows: list[tuple]) -> list[int]:
        for uid in [u for u, (at, _) in self.seen.items() if frame - at > PERSON_AGE]:
            del self.seen[uid]
        claimed: set[int] = set()
        out = []
        for raw, shape in rows:
            given = raw is not None and raw == raw
            uid = self.known.get(raw) if given else None
            if uid is None:
                uid = self.recovered(frame, shape, claimed)
                if uid is None:
                    uid, self.next = self.next, self.next + 1
                else:
                    claimed.add(uid)
                if given:
                    self.known[raw] = uid
            self.seen[uid] = (frame, shape)
            out.append(uid)
        return out

    def recovered(self, frame: int, shape: tuple, claimed: set[int]) -> int | None:
        """Best lost uid by distance, gap and likeness; one seen or claimed in this frame is not lost."""
        best, found = PERSON_MIN_SCORE, None
        for uid in sorted(self.seen):
            at, was = self.seen[uid]
            d = math.hypot(shape[0] - was[0], shape[1] - was[1])
            if at == frame or uid in claimed or d > PERSON_REACH:
                continue
            score = 0.6 * (1.0 - d / PERSON_REACH) + 0.4 * (1.0 - (frame - at) / PERSON_AGE) + 0.2 * _likeness(was, shape)
            if score > best or (score == best and found is None):
                best, found = score, uid
        return found


@functools.lru_cache(1024)
def _words(family: str) -> frozenset[str]:
    return frozenset(family.split())


class _Things:
    """Largest box first takes the nearest live record of its family and size.

    Age counts frames that contain objects. Equal distances go to the younger record.
    """

    def __init__(self) -> None:
        self.ticks, self.records, self.next = 0, {}, FIRST_OBJECT_UID

    def tick(self, rows: list[tuple]) -> list[int]:
        if not rows:
            return []
        self.ticks += 1
        for uid in [u for u, r in self.records.items() if self.ticks - r[0] > OBJECT_AGE]:
            del self.records[uid]
        taken: set[int] = set()
        out = [0] * len(rows)
        for i in sorted(range(len(rows)), key=lambda i: -rows[i][2]) if len(rows) > 1 else (0,):
            x, y, area, words = rows[i]
            mine, uid, reach = _words(words), None, OBJECT_REACH
            for u, (_, rx, ry, rarea, rwords) in self.records.items():
                # The distance comes first: the reach shrinks with every record found, so few others are looked at any further.
                dx = x - rx
                if dx > reach or -dx > reach:
                    continue
                d = math.hypot(dx, y - ry)
                if not d <= reach or u in taken or (mine and rwords and not mine & rwords) or min(area, rarea) / max(area, rarea) < OBJECT_SIZE_RATIO:
                    continue
                uid, reach = u, d
            if uid is None:
                uid, self.next = self.next, self.next + 1
            self.records[uid] = (self.ticks, x, y, area, mine)
            taken.add(uid)
            out[i] = uid
        return out


def shapes(boxes: DataFrame) -> dict[str, Column]:
    """What an identity is decided by, as columns."""
    c, nan = geom.centroid(geom.box()), F.lit(float("nan"))
    return {"_cx": c.x, "_cy": c.y, "_h": F.greatest(F.lit(1e-6), F.col("y2") - F.col("y1")), "_area": geom.floored_area(geom.box()),
            "_family": labels.family_words(F.col("class_name")),
            **{f"_{m}": F.coalesce(F.col(m) if m in boxes.columns else nan, nan) for m in _MARKS}}


def stable_uids(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add `uid` to persons (T1) and objects (T2) in one pass over each (video, session).

    Person and object uids are separate number ranges; a frame's persons and objects do not
    influence each other.
    """
    helpers = shapes(boxes)

    def tick(state: tuple, frame: int, rows: list[tuple]) -> list[int]:
        people = [i for i, r in enumerate(rows) if r[0]]
        things = [i for i, r in enumerate(rows) if not r[0]]
        out = [0] * len(rows)
        for i, uid in zip(people, state[0].tick(frame, [(rows[i][1], rows[i][4:]) for i in people])):
            out[i] = uid
        for i, uid in zip(things, state[1].tick([(rows[i][4], rows[i][5], rows[i][2], rows[i][3]) for i in things])):
            out[i] = uid
        return out

    inputs = ["is_person", "track_id", "_area", "_family", *_SHAPE]
    out = folds.annotate_frames(boxes.withColumns(helpers), keys, "frame", ["det_id"], inputs, lambda: (_People(), _Things()), tick, "uid")
    return out.drop(*helpers)


def linked_regions(tracks: dict[int, tuple], rows: list[tuple], frame: int, reach: float, age: int, following: int) -> tuple[list[int], int]:
    """The track of each region of a frame (0: none), and the next free number.

    `tracks`: number -> (frame last seen, x, y), in order of birth; `rows`: x, y, whether it may start a track.
    """
    free, out = list(range(len(rows))), [0] * len(rows)
    for t, (at, x, y) in tracks.items():
        near = [(math.hypot(rows[i][0] - x, rows[i][1] - y), i) for i in free] if frame - at <= age + 1 else []
        if near and min(near)[0] < reach:
            i = min(near)[1]
            free.remove(i)
            out[i] = t
    for i in free:
        if rows[i][2]:
            out[i], following = following, following + 1
    return out, following


def link_regions(regions: DataFrame, keys: Sequence[str], reach: float, age: int) -> DataFrame:
    """Link regions frame by frame; adds `track` and `hits`.

    Tracks in order of birth take the nearest free region within reach (the first on ties). A
    region left over starts a track only if its `may_start` flag allows it; otherwise it stays
    unlinked and is not returned. A track is dropped after a frame in which it has been unseen for
    more than `age` frames, so it can still be found again in that very frame.
    """
    c = geom.centroid(geom.box())

    def start() -> dict:
        return {"tracks": {}, "next": 1}

    def tick(state: dict, frame: int, rows: list[tuple]) -> list[int]:
        tracks = state["tracks"]
        out, state["next"] = linked_regions(tracks, rows, frame, reach, age, state["next"])
        for i, t in enumerate(out):
            if t:
                tracks[t] = (frame, *rows[i][:2])
        for t in [t for t, (at, _, _) in tracks.items() if frame - at > age + 1]:
            del tracks[t]
        return out

    rows = regions.withColumns({"_cx": c.x, "_cy": c.y})
    linked = folds.annotate_frames(rows, keys, "frame", ["det_id"], ["_cx", "_cy", "may_start"], start, tick, "track").drop("_cx", "_cy")
    # What follows reads the linked regions up to four times; frames are gone through once.
    linked = written(linked.where("track > 0"), "linked")
    return longseq.with_ordinal(linked, [*keys, "track"], ["frame"], F.floor(F.col("frame") / longseq.CHUNK), "hits")


def with_coasting(linked: DataFrame, keys: Sequence[str], age: int, last_frame: DataFrame) -> DataFrame:
    """Add a row for every frame a linked track is kept without being seen; `gap` counts those frames.

    The next sighting is one row ahead in the track's own count, and a gap is at most `age` frames.
    """
    track = [*keys, "track"]
    ahead = longseq.bounded(linked, track, "hits", lambda w: {"_next": F.lead("frame").over(w)}, before=0, after=1)
    limited = ahead.join(last_frame, list(keys))
    until = F.least(F.coalesce(F.col("_next") - 1, F.col("last_frame")), F.col("frame") + age)
    spread = limited.withColumn("_at", F.explode(F.sequence("frame", F.greatest(F.col("frame"), until))))
    return spread.withColumn("gap", F.col("_at") - F.col("frame")).withColumn("frame", F.col("_at")).drop("_at", "_next", "last_frame")


def colour_tracks(regions: DataFrame, keys: Sequence[str], last_frame: DataFrame, min_confidence: float = 0.20) -> DataFrame:
    """Linked colour regions with smoothed boxes, and confidence decaying over gaps."""
    linked = link_regions(regions, keys, COLOUR_REACH, COLOUR_AGE)
    smooth = longseq.bounded(linked, [*keys, "track"], "hits", lambda w: {
        **{f"s{side}": F.avg(side).over(w.rowsBetween(-7, 0)) for side in ("x1", "y1", "x2", "y2")},
        "sconf": F.avg("confidence").over(w.rowsBetween(-4, 0))}, before=7)
    shown = with_coasting(smooth, keys, COLOUR_AGE, last_frame).where(F.col("hits") >= 2)
    decay = F.when(F.col("gap") > 0, F.greatest(F.lit(0.35), 1.0 - 0.08 * F.col("gap"))).otherwise(1.0)
    return shown.withColumn("sconf", F.col("sconf") * decay).where(F.col("sconf") >= min_confidence)


def change_tracks(regions: DataFrame, keys: Sequence[str], last_frame: DataFrame) -> DataFrame:
    """T4: linked change regions that persisted; the first person ever near a track stays with it.

    `person_id` of a region is the nearest person of its frame, if any (J4).
    """
    linked = link_regions(regions, keys, REGION_REACH, REGION_AGE)
    shown = with_coasting(linked, keys, REGION_AGE, last_frame)
    firsts = linked.where("person_id is not null").groupBy(*keys, "track").agg(F.min(F.struct("hits", "person_id")).alias("_p"))
    best = shown.join(firsts, [*keys, "track"], "left")
    return best.where(F.col("hits") >= REGION_HITS).withColumn(
        "person_id", F.when(F.col("_p.hits") <= F.col("hits"), F.col("_p.person_id"))).drop("_p")
