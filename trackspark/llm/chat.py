"""Canonical chat turns from review records of many layouts, a chat template, and its reader.

The record is a report kept for an event: `event_id`, its place `seq` in the event's thread, and
`report_json`, whose layout differs from tool to tool. A layout is recognised by the fingerprint of its
nested field paths, and a declarative mapping says where roles and texts are.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    `turns`: (role, path) pairs in turn order, for layouts with a field per role. `each`: (path of the list, role
    field, text field), for layouts with a list of messages. `optional`: paths that may be missing.
    """

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    optional: tuple[str, ...] = ()
    other: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        own = [path for _, path in self.turns]
        if self.each:
            where, role, text = self.each
            own += [f"{where}[].{role}", f"{where}[].{text}"]
        return [*own, *self.other]


LAYOUTS = (
    Layout("messages", each=("messages", "role", "content"), optional=("messages[].role",)),
    Layout("conversations", each=("conversations", "from", "value"), optional=("conversations[].from",)),
    Layout("instruction", turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "instruction", "input", "output")),
    Layout("prompt", turns=(("user", "prompt"), ("assistant", "response")), optional=("prompt", "response")),
    Layout("review", turns=(("user", "review.question"), ("assistant", "review.answer")), optional=("review.answer",), other=("review.verdict",)),
)

#: Fixed marks of the template.
START, END, ASSISTANT = "<|im_start|>", "<|im_end|>", "assistant"


def field_paths(value, at: str = "") -> set[str]:
    """The paths of all leaves; list elements share the path `name[]`. A null leaf has no path."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}" if at else str(k)) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{at}[]") for v in value)) if value else set()
    return set() if value is None else {at}


def fingerprint(paths) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(sorted(paths)))


def fingerprints(layouts=LAYOUTS) -> dict[int, Layout]:
    """Every combination of a layout's optional paths is a fingerprint of its own; the first layout with it wins."""
    out: dict[int, Layout] = {}
    for layout in layouts:
        for missing in chain.from_iterable(combinations(layout.optional, n) for n in range(len(layout.optional) + 1)):
            if paths := set(layout.paths()) - set(missing):
                out.setdefault(fingerprint(paths), layout)
    return out


def _at(value, path: str):
    for step in path.split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def _turns(layout: Layout, record: dict) -> list[tuple[str, str]]:
    text = lambda x: "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    if layout.each:
        where, role, content = layout.each
        return [(text(m.get(role)), text(m.get(content))) for m in _at(record, where) or []]
    return [(role, text(value)) for role, path in layout.turns if (value := _at(record, path)) is not None]


def canonical_turns(reports: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """Turns of every report.

    Input: event_id (any type), seq (number or null), report_json (text); other columns are ignored. Result, one row per turn:
    event_id, seq, part (place inside the report, from 0), layout (its name), role, text. A report that is null, not
    JSON or of an unknown fingerprint gives one row with null layout, role and text, so that it is not lost. A null
    role or text inside a known layout is empty. Rows are independent: no shuffle.
    """
    known = fingerprints(layouts)

    def turns(raw) -> list[tuple]:
        try:
            record = json.loads(raw)
        except (TypeError, ValueError):
            return [(0, None, None, None)]
        layout = known.get(fingerprint(field_paths(record)))
        found = _turns(layout, record) if layout else []
        return [(i, layout.name, role, text) for i, (role, text) in enumerate(found)] or [(0, None, None, None)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [turns(raw) for raw in batch["report_json"]]
            rows = batch[["event_id", "seq"]].loc[batch.index.repeat([len(t) for t in found])].reset_index(drop=True)
            rows[["part", "layout", "role", "text"]] = pd.DataFrame([t for ts in found for t in ts], columns=["part", "layout", "role", "text"], dtype=object)
            yield rows.astype({"part": "int32"})

    rows = reports.selectExpr("CAST(event_id AS STRING) AS event_id", "CAST(seq AS STRING) AS seq", "report_json").mapInPandas(run, "event_id string, seq string, part int, layout string, role string, text string")
    back = {c: reports.schema[c].dataType for c in ("event_id", "seq")}
    return rows.select(*[F.col(c).cast(t).alias(c) for c, t in back.items()], "part", "layout", "role", "text")


def escaped(text: Column) -> Column:
    """No control string is left: `<|` becomes `<!|`, and what looks like that gets one more `!`."""
    return F.regexp_replace(text, r"<(!*)\|", r"<!$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<!(!*)\|", r"<\1|", text)


def formatted(turns: DataFrame) -> DataFrame:
    """The template, one row per turn: event_id, seq, part, role, text, segment, loss_start, loss_end.

    A conversation's text is its segments in order (seq, part, role, text). The loss mask covers an assistant's text: code
    points loss_start to loss_end of the segment, null in other turns. A line break or backslash in a role is escaped.
    """
    role = F.regexp_replace(F.regexp_replace(escaped(F.coalesce("role", F.lit(""))), r"\\", r"\\\\"), "\n", r"\\n")
    text = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    rows = turns.withColumn("_head", head).withColumn("_text", text)
    start = F.when(F.coalesce(F.col("role"), F.lit("")) == ASSISTANT, F.length("_head"))
    rows = rows.withColumn("segment", F.concat("_head", "_text", F.lit(END + "\n"))).withColumn("loss_start", start).withColumn("loss_end", start + F.length("_text"))
    return rows.drop("_head", "_text")


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


class _Reading:
    """What is known of a conversation while its segments stream by."""

    def __init__(self):
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def feed(self, segment: str, loss: tuple[int, int] | None) -> None:
        self.chars += len(segment)
        if loss:
            masked = unescaped(segment[loss[0] : loss[1]])
            self.loss_chars += len(masked)
            self.loss_hash.update(masked.encode())
        self.rest += segment
        end = 0
        for found in _TURN.finditer(self.rest):
            if found.start() != end:
                raise ValueError("text outside of a turn")
            end = found.end()
            role = unescaped(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], found[1]))
            self.turns += 1
            self.turns_hash.update(f"{role}\n{unescaped(found[2])}\n".encode())
        self.rest = self.rest[end:]

    def row(self, event_id) -> tuple:
        if self.rest:
            raise ValueError("an unfinished turn")
        return event_id, self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def read_back(segments: DataFrame) -> DataFrame:
    """Conversations read from their formatted text.

    Input: what `formatted` returns. Result, one row per event_id: n_turns, turns_sha256 (role, line break, text, line
    break of every turn), loss_chars, loss_sha256 (the text under the loss mask), formatted_chars. A conversation's
    segments stream through one task in order, and only the turn in progress is held, so a conversation of any number
    of turns takes little memory. No segments give no rows.
    """
    columns = ["event_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, reading = None, None
        for batch in batches:
            done = []
            for event_id, segment, start, end in batch[["event_id", "segment", "loss_start", "loss_end"]].itertuples(index=False, name=None):
                event_id = None if pd.isna(event_id) else event_id
                if reading is None or event_id != key:
                    if reading is not None:
                        done.append(reading.row(key))
                    key, reading = event_id, _Reading()
                reading.feed(segment, None if pd.isna(start) else (int(start), int(end)))
            yield pd.DataFrame(done, columns=columns)
        if reading is not None:
            yield pd.DataFrame([reading.row(key)], columns=columns)

    order = ["event_id", "seq", "part", "role", "text"]
    rows = segments.repartition("event_id").sortWithinPartitions(*order).select(F.col("event_id").cast("string").alias("event_id"), "segment", "loss_start", "loss_end")
    out = rows.mapInPandas(run, "event_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumn("event_id", F.col("event_id").cast(segments.schema["event_id"].dataType))
