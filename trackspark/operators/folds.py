"""Order-dependent greedy work: a sorted streaming fold, and greedy spacing cut into chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trackspark.operators import longseq


def _column(values: pa.Array) -> pd.Series:
    """A column as pandas has it, but whole numbers and flags with a NULL among them stay what they are, beside None.

    Plain pandas makes doubles of them, which changes whole numbers above 2^53 and lets a NULL equal nothing.
    """
    if values.null_count and (pa.types.is_integer(values.type) or pa.types.is_boolean(values.type)):
        return pd.Series(values.to_pylist(), dtype=object)
    return values.to_pandas()


def _values(values: pa.Array) -> list:
    """A column's values as Python has them, lists as lists; missing ones as in `_column`."""
    if not pa.types.is_list(values.type):
        return _column(values).tolist()
    # An array object for every row would cost more than what is done with it.
    flat, out, at = _values(values.flatten()), [], 0
    for n in pc.fill_null(pc.list_value_length(values), -1).to_numpy().tolist():
        out.append(None if n < 0 else flat[at : at + n])
        at += max(n, 0)
    return out


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    return pd.DataFrame({name: _column(batch.column(i)) for i, name in enumerate(batch.schema.names)})


def _batch(columns: Iterable, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t, from_pandas=True, safe=False) for c, t in zip(columns, schema.types)], schema=schema)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: Callable[[], object],
                step: Callable[[object, tuple], Iterable[tuple]], finish: Callable[[object], Iterable[tuple]], schema: str) -> DataFrame:
    """Stream each key's rows, in order, through `step`; memory holds the state of one key, not its rows.

    Spark shuffles by key and sorts (spilling as needed); rows arrive as Arrow batches. `step` gets
    the row as a tuple in column order and returns output tuples without the key columns. A missing
    number that is not whole is NaN, any other missing value None; rows with the same missing key are one key.
    """
    columns, n_keys = df.columns, len(keys)
    ordered = [*keys, *(c for c in columns if c not in keys)]
    result = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(_values(batch.column(i)) for i in range(len(ordered)))):
                if row[:n_keys] != key:
                    if key is not None:
                        out.extend(key + r for r in finish(state))
                    key, state = row[:n_keys], start()
                out.extend(key + r for r in step(state, row[n_keys:]))
            if out:
                yield _batch(zip(*out), result)
        if key is not None:
            last = [key + r for r in finish(state)]
            if last:
                yield _batch(zip(*last), result)

    prepared = df.select(*ordered).repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, *order)
    return prepared.mapInArrow(run, schema)


def frames_in_order(df: DataFrame, keys: Sequence[str], frame: str, start: Callable[[], object], tick: Callable[[object, object, list[tuple]], Iterable[tuple]],
                    finish: Callable[[object], Iterable[tuple]], schema: str) -> DataFrame:
    """`fold_frames` over rows that are dealt and sorted by keys and frame already; nothing is shuffled here."""
    ordered = [*keys, frame, *(c for c in df.columns if c not in {*keys, frame})]
    result, n_keys = _arrow(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, state, held = None, None, None, []
        for batch in batches:
            out: list[tuple] = []
            columns = [_values(batch.column(i)) for i in range(len(ordered))]
            ids, rows = list(zip(*columns[: n_keys + 1])), list(zip(*columns[n_keys:]))
            lo, n = 0, len(rows)
            while lo < n:
                here, hi = ids[lo], lo + 1
                while hi < n and ids[hi] == here:
                    hi += 1
                if here == at:
                    held.extend(rows[lo:hi])
                else:
                    if at is not None:
                        out.extend([key + r for r in tick(state, at[-1], held)])
                    if here[:-1] != key:
                        if key is not None:
                            out.extend([key + r for r in finish(state)])
                        key, state = here[:-1], start()
                    at, held = here, rows[lo:hi]
                lo = hi
            if out:
                yield _batch(zip(*out), result)
        if at is not None:
            last = [key + r for r in (*tick(state, at[-1], held), *finish(state))]
            if last:
                yield _batch(zip(*last), result)

    return df.select(*ordered).mapInArrow(run, schema)


def fold_frames(df: DataFrame, keys: Sequence[str], frame: str, order: Sequence[str], start: Callable[[], object],
                tick: Callable[[object, object, list[tuple]], Iterable[tuple]], finish: Callable[[object], Iterable[tuple]],
                schema: str) -> DataFrame:
    """`fold_sorted` handing over all rows of one frame at once; `frame` comes first in a row."""
    prepared = df.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*keys, frame, *order)
    return frames_in_order(prepared, keys, frame, start, tick, finish, schema)


def map_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
             schema: str, shuffle_by: Sequence[str] | None = None) -> DataFrame:
    """Sort by key and order, and hand whole key groups, many per call, to a worker made per task.

    A group is buffered until it is complete, so keys must have bounded groups (a chunk, a frame).
    Handing over many groups at once spares the per-group cost of a grouped pandas call. With
    `shuffle_by` (a prefix of the keys) all groups of a prefix pass the same worker in order, which
    may then keep state between them.
    """

    result = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, held = make(), []

        def done(pdf: pd.DataFrame) -> pa.RecordBatch:
            out = work(pdf.reset_index(drop=True))
            return _batch((out[n] for n in result.names), result)

        for batch in batches:
            if not batch.num_rows:
                continue
            pdf = _frame(batch)
            last = tuple(pdf[k].iloc[-1] for k in keys)
            tail = np.ones(len(pdf), dtype=bool)
            for k, value in zip(keys, last):
                tail &= pdf[k].isna().to_numpy() if value is None else (pdf[k] == value).to_numpy()
            begin = 0 if tail.all() else len(pdf) - int(tail[::-1].argmin())
            if begin or (held and tuple(held[-1][k].iloc[-1] for k in keys) != last):
                whole = pd.concat([*held, pdf.iloc[:begin]]) if held else pdf.iloc[:begin]
                held = []
                if len(whole):
                    yield done(whole)
            held.append(pdf.iloc[begin:])
        if held:
            yield done(pd.concat(held))

    prepared = df.repartition(*(F.col(k) for k in (shuffle_by or keys))).sortWithinPartitions(*keys, *order)
    return prepared.mapInArrow(run, schema)


def ddl(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in (columns or df.columns))


def edges(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Whether a row differs from the one before in any of the columns; a missing value equals another one."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for c in columns:
        values = rows.column(c).combine_chunks()
        given = values.is_valid().to_numpy(zero_copy_only=False)
        plain = values.drop_null().to_numpy(zero_copy_only=False)
        filled = np.zeros(len(given), plain.dtype)
        filled[given] = plain
        out[1:] |= (filled[1:] != filled[:-1]) | (given[1:] != given[:-1])
    return out


def whole_frames(batches: Iterable[pa.RecordBatch], group: Sequence[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups (keys and frame); held are the rows of the group that a batch ends in."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        begin = int(np.flatnonzero(edges(rows, group))[-1])
        if begin:
            yield rows.slice(0, begin)
        held = rows.slice(begin)
    if held is not None:
        yield held


def annotate_frames(df: DataFrame, keys: Sequence[str], frame: str, order: Sequence[str], inputs: Sequence[str], start: Callable[[], object],
                    tick: Callable[[object, int, list[tuple]], list], name: str) -> DataFrame:
    """Add one bigint column decided frame by frame: `tick` sees a frame's `inputs` rows and returns one value per row.

    Rows keep all their columns, so no join is needed to bring the result back. Only keys and `inputs` are read; all other
    columns pass as they came. Held are the rows of the frame that a batch ends in.
    """
    group = [*keys, frame]
    result = _arrow(f"{ddl(df)}, {name} bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done(rows: pa.Table, ids: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal key, state
            cols = [_values(rows.column(c).combine_chunks()) for c in inputs]
            values: list = []
            lo, n = 0, len(ids)
            while lo < n:
                hi = lo + 1
                while hi < n and ids[hi] == ids[lo]:
                    hi += 1
                if ids[lo][:-1] != key:
                    key, state = ids[lo][:-1], start()
                values.extend(tick(state, ids[lo][-1], list(zip(*(c[lo:hi] for c in cols)))))
                lo = hi
            return iter(rows.append_column(result.field(name), pa.array(values, pa.int64())).to_batches())

        for rows in whole_frames(batches, group):
            yield from done(rows, list(zip(*(_values(rows.column(c).combine_chunks()) for c in group))))

    prepared = df.repartition(*(F.col(k) for k in keys)).sortWithinPartitions(*group, *order)
    return prepared.mapInArrow(run, f"{ddl(df)}, {name} bigint")


def _bounds(pdf: pd.DataFrame, keys: Sequence[str]) -> list[tuple[int, int]]:
    """Start and end row of each key group in key-sorted rows."""
    n = len(pdf)
    edge = np.zeros(n, dtype=bool)
    edge[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        edge[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(edge)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n]))


def greedy_spacing(df: DataFrame, keys: Sequence[str], ts: str, tie: str, interval: float, chunk: float,
                   name: str = "kept") -> DataFrame:
    """Mark rows kept by "keep a row at least `interval` after the last kept one" (F7).

    The choice depends on everything before it, yet a chunk only needs the time of the last kept
    row. Pass 1 tabulates, per chunk, where each possible first kept row leads; pass 2 walks those
    small tables per key; pass 3 replays each chunk from its now known entry. No task buffers more
    than one chunk of rows. `chunk` must be at least `interval`.
    """
    if chunk < interval:
        raise ValueError("chunk must be at least interval")
    rows = df.withColumn("_c", F.floor(F.col(ts) / chunk).cast("bigint"))
    group = [*keys, "_c"]
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        times, picks, leaves = pdf[ts].to_numpy(), [], []
        for lo, hi in _bounds(pdf, group):
            t = times[lo:hi]
            nxt, leave = np.searchsorted(t, t + interval, side="left"), t.copy()
            for i in range(len(t) - 1, -1, -1):
                if nxt[i] < len(t):
                    leave[i] = leave[nxt[i]]
            # The last kept row lies before this chunk, so the entry is at the latest the first row a full interval in.
            first = np.arange(min(int(nxt[0]) + 1, len(t)))
            picks.append(lo + first)
            leaves.append(leave[first])
        at = np.concatenate(picks)
        return pdf.iloc[at][group].assign(enter=times[at], leave=np.concatenate(leaves))

    table = map_runs(rows.select(*group, ts).distinct(), group, [ts], lambda: tabulate, f"{key_types}, _c bigint, enter double, leave double")

    def start() -> dict:
        return {"chunk": None, "last": None, "before": None, "done": True}

    def step(state: dict, row: tuple):
        c, enter, leave = row
        out = []
        if c != state["chunk"]:
            state["chunk"], state["before"], state["done"] = c, state["last"], False
            out.append((c, state["before"]))
        if not state["done"] and (state["before"] is None or enter >= state["before"] + interval):
            state["last"], state["done"] = leave, True
        return out

    entries = fold_sorted(table, keys, ["_c", "enter"], start, step, lambda s: (), f"{key_types}, _c bigint, before double")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        times, before, kept = pdf[ts].to_numpy(), pdf["_before"].to_numpy(), np.zeros(len(pdf), dtype=bool)
        for lo, hi in _bounds(pdf, group):
            t = times[lo:hi]
            i = 0 if np.isnan(before[lo]) else int(np.searchsorted(t, before[lo] + interval, side="left"))
            while i < len(t):
                kept[lo + i] = True
                i = int(np.searchsorted(t, t[i] + interval, side="left"))
        return pdf.drop(columns=["_before"]).assign(**{name: kept})

    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {name} boolean"
    known = entries.select(*group, F.coalesce("before", F.lit(float("nan"))).alias("_before"))
    joined = rows.join(known, group).select(*rows.columns, "_before")
    return map_runs(joined, group, [ts, tie], lambda: replay, out_schema).drop("_c")


def islands(df: DataFrame, keys: Sequence[str], ordinal: str, starts: Column, name: str = "island") -> DataFrame:
    """Island id per row: the ordinal at which its island began."""
    return longseq.running(df, keys, ordinal, {name: ("max", F.when(starts, F.col(ordinal)))})
