"""One pass over a session's boxes: identities, motion, calibration, and the persons and objects of a tick side by side.

Boxes, ticks and the configs of a session meet in one shuffle by session. What follows needs the boxes in tick order and
nothing else, so they are neither shuffled nor written again. A task holds one session's recent identities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.operators import calibrate, folds, identity

# Samples that a mean step looks at, as in W2.
STEP_WINDOW = 3
_SHAPE = ["_cx", "_cy", "_h", *identity._MARKS]


class _Paths:
    """Step lengths and displacements of identities. Histories count observations, so an identity that blinks keeps its motion."""

    def __init__(self, window: int, pose_window: int) -> None:
        self.reach, self.back = max(2, window) - 1, max(2, pose_window) - 1
        self.kept = max(self.reach, self.back, STEP_WINDOW - 1)
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0) for _ in "xy"), *(np.zeros(0, bool) for _ in "xy"))

    def motion(self, session: np.ndarray, uid: np.ndarray, places: tuple, last: int) -> dict[str, pa.Array]:
        """`stride` to the observation before, its mean `step`, that of the pose window, and `moved` over the window; NULL before there are two.

        Rows in the order they are seen, `session` a number that grows; the session `last` may go on in the next call, so
        the last rows of its identities are held.
        """
        before = len(self.held[0])
        whole = [np.concatenate(both) for both in zip(self.held, (session, uid, *places))]
        order = np.lexsort((whole[1], whole[0]))
        session, uid, x, y, has_x, has_y = (c[order] for c in whole)
        n = len(order)

        def earlier(values: np.ndarray, k: int, absent) -> np.ndarray:
            out = np.full(n, absent, values.dtype)
            out[k:] = values[: max(n - k, 0)]
            return out

        same = [np.ones(n, bool)]
        for k in range(1, self.kept + 1):
            same.append((earlier(session, k, -1) == session) & (earlier(uid, k, 0) == uid))

        def gap(ax: np.ndarray, ay: np.ndarray) -> np.ndarray:
            with np.errstate(invalid="ignore", over="ignore"):
                return np.sqrt((x - ax) * (x - ax) + (y - ay) * (y - ay))

        has, far_x, far_y = has_x & has_y, np.zeros(n), np.zeros(n)
        stride, stepped = gap(earlier(x, 1, 0.0), earlier(y, 1, 0.0)), has & same[1] & earlier(has, 1, False)
        found_x, found_y = np.zeros(n, bool), np.zeros(n, bool)
        for k in range(1, self.reach + 1):
            for value, given, far, found in ((x, has_x, far_x, found_x), (y, has_y, far_y, found_y)):
                there = same[k] & earlier(given, k, False)
                far[there] = earlier(value, k, 0.0)[there]
                found |= there

        def mean(window: int) -> tuple[np.ndarray, np.ndarray]:
            total, count = np.zeros(n), np.zeros(n)
            for k in range(window - 1, -1, -1):
                there = same[k] & earlier(stepped, k, False)
                total[there] += earlier(stride, k, 0.0)[there]
                count += there
            return total / np.maximum(count, 1.0), count > 0

        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        mine = back[before:]
        made = {"stride": (stride, stepped), "step": mean(STEP_WINDOW - 1), "moved": (gap(far_x, far_y), has & found_x & found_y)}
        made["pose_step"] = made["step"] if self.back == STEP_WINDOW - 1 else mean(self.back)
        # The last rows of each identity of the open session.
        later = np.zeros(n, bool)
        later[: max(n - self.kept, 0)] = same[self.kept][self.kept:]
        still = order[(session == last) & ~later]
        still.sort()
        self.held = tuple(c[still] for c in whole)
        return {name: pa.array(values[mine], pa.float64(), mask=~given[mine], from_pandas=False) for name, (values, given) in made.items()}


class _Session:
    def __init__(self, depths: Sequence[int]) -> None:
        self.people, self.things, self.early = identity._People(), identity._Things(), calibrate.Early(depths)
        self.first, self.configs = None, None


def _numbers(column: pa.ChunkedArray, absent) -> np.ndarray:
    return column.combine_chunks().fill_null(absent).to_numpy(zero_copy_only=False)


def _rows(part: pa.Table, columns: Sequence[str]) -> list[tuple]:
    return list(zip(*(folds._values(part.column(c).combine_chunks()) for c in columns)))


#: Rows of one batch that is handed on; a tick's rows stay together.
BATCH = 20_000


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """The values as lists, so many in each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def observations(boxes: DataFrame, ticks: DataFrame, clip: Sequence[str], person_part: dict[str, str], object_part: dict[str, str], rest_part: Sequence[str],
                 window: int, pose_window: int, depths: Sequence[int], configs: DataFrame | None = None) -> DataFrame:
    """A row per tick (kind 0) and a row per person and object in it (kind 3), session by session and in order.

    A tick row lists the uids of its `people`, the tracks of its `things` and, for each of these, the `rest_part` columns in
    `rests`; a pair's row has the parts of both (name -> column of the box, `uid`, `step`, `pose_step` or `moved`). All rows have the
    tick's `ts`, its ordinal `at` from the session's first tick (NULL before it), and for each depth the `med_h_` and `med_step_` of
    `calibrate.scene_statistics` once its ticks are over. Ticks without boxes are kept, and so are boxes without a tick. `configs`
    (clip, configs: array of names) keeps the sessions it lists, whose ticks are repeated for each of their configs, as `config_id`.
    """
    made = {"uid": "bigint", "step": "double", "pose_step": "double", "moved": "double"}
    kinds = dict(boxes.dtypes) | made
    kept = list(dict.fromkeys(["is_person", "track_id", *(c for c in (*identity._MARKS, *person_part.values(), *object_part.values(), *rest_part) if c not in made)]))
    helpers = {name: c for name, c in identity.shapes(boxes).items() if name[1:] not in identity._MARKS}
    order = [*clip, "frame", "_kind", "det_id"]
    rows = boxes.select(*clip, F.col("frame").cast("bigint").alias("frame"), F.lit(2).alias("_kind"), "det_id", *kept, *(c.alias(name) for name, c in helpers.items()))
    rows = rows.unionByName(ticks.select(*clip, F.col("frame").cast("bigint").alias("frame"), F.lit(1).alias("_kind"), F.col("ts").cast("double").alias("ts")), allowMissingColumns=True)
    if configs is not None:
        rows = rows.unionByName(configs.select(*clip, F.lit(None).cast("bigint").alias("frame"), F.lit(0).alias("_kind"), "configs"), allowMissingColumns=True)
    parts = "".join(f", {name} {kinds[c]}" for part in (person_part, object_part) for name, c in part.items())
    schema = (f"{folds.ddl(boxes, clip)}, frame bigint, ts double, at bigint" + "".join(f", med_h_{d} double, med_step_{d} double" for d in depths)
              + (", config_id string" if configs is not None else "")
              + f", kind int, people array<bigint>, things array<{kinds['track_id']}>, rests array<struct<{', '.join(f'{c}: {kinds[c]}' for c in rest_part)}>>" + parts)
    result = folds._arrow(schema)
    named, group = configs is not None, [*clip, "frame"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before, number = None, None, 0
        paths = _Paths(window, pose_window), _Paths(window, pose_window)
        for table in folds.whole_frames(batches, group):
            kind = table.column("_kind").to_numpy()
            edges = folds.edges(table, group)
            starts = np.flatnonzero(edges)
            place = np.cumsum(edges) - 1
            # A session goes on from the table before, unless its keys differ.
            fresh = folds.edges(table, clip)[starts]
            first = table.slice(0, 1).select(list(clip)).to_pylist()[0]
            fresh[0] = first != before
            before = table.slice(table.num_rows - 1, 1).select(list(clip)).to_pylist()[0]
            is_person = _numbers(table.column("is_person"), False)
            sides = []
            for chosen, columns in (((kind == 2) & is_person, ["track_id", *_SHAPE]), ((kind == 2) & ~is_person, ["_cx", "_cy", "_area", "_family"])):
                part = table.filter(pa.array(chosen))
                counts = np.bincount(place[chosen], minlength=len(starts))
                sides.append([part, counts, _rows(part, columns), []])
            (people, n_people, persons, person_uids), (things, n_things, objects, object_uids) = sides
            persons = [(row[0], row[1:]) for row in persons]
            ticked = np.bincount(place[kind == 1], minlength=len(starts)) > 0
            headed = np.bincount(place[kind == 0], minlength=len(starts)) > 0
            frame = _numbers(table.column("frame"), 0)[starts].tolist()
            names = table.column("configs").take(pa.array(starts)).to_pylist() if named else None
            numbers, played, sessions, since = np.empty(len(starts), np.int64), np.zeros(len(starts), bool), [], []
            p = o = 0
            for g, (new, header, tick, at, np_, no_) in enumerate(zip(fresh.tolist(), headed.tolist(), ticked.tolist(), frame, n_people.tolist(), n_things.tolist())):
                if new:
                    state, number = _Session(depths), number + 1
                numbers[g] = number
                sessions.append(state)
                if header:
                    state.configs = names[g]
                    since.append(None)
                    continue
                if tick and state.first is None:
                    state.first = at
                played[g] = not named or bool(state.configs)
                since.append(None if state.first is None else at - state.first)
                person_uids.extend(state.people.tick(at, persons[p : p + np_]))
                object_uids.extend(state.things.tick(objects[o : o + no_]))
                p, o = p + np_, o + no_
            moved = []
            for (part, counts, _, uids), path in zip(sides, paths):
                has = [part.column(c).combine_chunks() for c in ("_cx", "_cy")]
                places = *(_numbers(part.column(c), 0.0) for c in ("_cx", "_cy")), *(c.is_valid().to_numpy(zero_copy_only=False) for c in has)
                uids = np.array(uids, np.int64)
                moved.append((uids, path.motion(np.repeat(numbers, counts), uids, places, number)))
            heights, strides = people.column("_h").to_pylist() if depths else [], moved[0][1]["stride"].to_pylist() if depths else []
            known, p = [], 0
            for state_, at, np_ in zip(sessions, since, n_people.tolist()):
                known.append(state_.early.tick(at, heights[p : p + np_], strides[p : p + np_]))
                p += np_
            full = []
            for (part, _, _, _), (uids, made_) in zip(sides, moved):
                part = part.append_column("uid", pa.array(uids))
                for column in ("step", "pose_step", "moved"):
                    part = part.append_column(column, made_[column])
                full.append(part.combine_chunks())
            heads = table.select(group).take(pa.array(starts))
            times = np.full(len(starts), -np.inf)
            timed = (kind == 1) & table.column("ts").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
            np.maximum.at(times, place[timed], _numbers(table.column("ts"), 0.0)[timed])
            times[~(np.bincount(place[timed], minlength=len(starts)) > 0)] = 0.0
            scene = [pa.array([found.get(d, (None, None))[i] for found in known], pa.float64()) for d in depths for i in (0, 1)]
            ticked_rows = [*(heads.column(c).combine_chunks() for c in group), pa.array(times), pa.array(since, pa.int64()), *scene]
            rests = pa.StructArray.from_arrays([full[1].column(c).combine_chunks() for c in rest_part], names=list(rest_part))
            present = [_lists(full[0].column("uid").combine_chunks(), n_people), _lists(full[1].column("track_id").combine_chunks(), n_things), _lists(rests, n_things)]
            begin_p, begin_o = np.cumsum(n_people) - n_people, np.cumsum(n_things) - n_things
            # A tick under each of its configs.
            turns = np.repeat(np.arange(len(starts)), [len(state_.configs or ()) if named else 1 for state_ in sessions])
            turns, runs = turns[played[turns]], [c for state_, on in zip(sessions, played.tolist()) if named and on for c in state_.configs]
            runs, sizes = pa.array(runs, pa.string()), 1 + (n_people * n_things)[turns]
            share = (np.cumsum(sizes) - 1) // BATCH
            for chosen in np.split(np.arange(len(turns)), np.flatnonzero(np.diff(share)) + 1):
                if not len(chosen):
                    continue
                size = sizes[chosen]
                turn = np.repeat(chosen, size)
                tick = turns[turn]
                # A tick's first row is its own, its pairs follow, person by person.
                pair = np.arange(len(tick)) - np.repeat(np.cumsum(size) - size, size) - 1
                own_row, across = pair < 0, np.maximum(n_things[tick], 1)
                at_p = pa.array(begin_p[tick] + pair // across, mask=own_row)
                at_o = pa.array(begin_o[tick] + pair % across, mask=own_row)
                at_tick, all_ticks = pa.array(tick, mask=~own_row), pa.array(tick)
                columns = [*(c.take(all_ticks) for c in ticked_rows), *([runs.take(pa.array(turn))] if named else []), pa.array(np.where(own_row, 0, 3).astype(np.int32)), *(c.take(at_tick) for c in present)]
                for part, names_, index in ((full[0], person_part, at_p), (full[1], object_part, at_o)):
                    columns += [part.column(c).combine_chunks().take(index) for c in names_.values()]
                yield pa.RecordBatch.from_arrays([c.cast(t) if c.type != t else c for c, t in zip(columns, result.types)], schema=result)

    prepared = rows.repartition(*(F.col(c) for c in clip)).sortWithinPartitions(*order)
    return prepared.mapInArrow(run, schema)
