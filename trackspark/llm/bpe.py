"""Byte-pair encoding of operator notes, by forced-boundary splitting, and decoding.

The record is a verdict: `event_id` and the operator's `notes`. The vocabulary file is the caller's; it
holds a word-level BPE: lower-cased, white space dropped, an end mark on a word's last symbol.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import short_batches

#: Words and fragments kept per Python worker, twice: a full memory becomes the former one, from which what is still in use comes back.
REMEMBERED, REMEMBERED_FRAGMENTS = 160_000, 40_000
#: Texts are handled in slices of so many characters, so a batch of long texts stays small.
SLICE_CHARS = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary with its merge ranks and the table of byte pairs that occur inside a token."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        # Two ids as one number, and of what they join into the rank and the id as one number: pairs are looked up without text.
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.joins = {self.ids[a] << 32 | self.ids[b]: i << 32 | self.ids[a + b] for i, (a, b) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = np.empty(1 + max([*self.ids.values(), *self.added.values()]), dtype=object)
        for token, i in [*self.ids.items(), *self.added.items()]:
            self.tokens[i] = token
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p)
        self.words = regex.compile(pattern.replace(r"\s", r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")).findall
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.symbol = dict(enumerate(byte_symbols()))
        inside = {(a, b) for t in self.ids for bare in [t.removesuffix(self.end)] for a, b in zip(bare, bare[1:])}
        self.joint = frozenset(a + b for a, b in inside)
        self.by_word: dict[str, bytes] = {}
        self.by_fragment: dict[str, tuple[int, ...]] = {}
        self.former_words: dict[str, bytes] = {}
        self.former_fragments: dict[str, tuple[int, ...]] = {}

    def merged(self, symbols: list[str]) -> tuple[int, ...]:
        """Ids of a fragment: the leftmost pair of lowest rank is joined, until no pair has a rank."""
        join, far = self.joins.get, 1 << 62
        ids = [self.ids[s] for s in symbols]
        pairs = [join(a << 32 | b, far) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) < far:
            i = pairs.index(best)
            ids[i] = new = best & 0xFFFFFFFF
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = join(ids[i - 1] << 32 | new, far)
            if i < len(pairs):
                pairs[i] = join(new << 32 | ids[i + 1], far)
        return tuple(ids)

    def fragments(self, word: str) -> list[str]:
        """A word's symbols, cut at each pair that no token holds; only the last fragment carries the end mark."""
        # Plain letters stand for themselves.
        text = word if word.isascii() and word.isalpha() else word.encode("utf-8").decode("latin-1").translate(self.symbol)
        joint = self.joint
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joint]
        if not cuts:
            return [text + self.end]
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        parts[-1] += self.end
        return parts

    def word_ids(self, word: str) -> bytes:
        """A word's ids as 32-bit integers."""
        found = self.by_word.get(word)
        if found is not None:
            return found
        found = self.former_words.get(word)
        if found is None:
            ids: list[int] = []
            for part in self.fragments(word):
                known = self.by_fragment.get(part)
                ids.extend(self.fragment_ids(part) if known is None else known)
            found = array("i", ids).tobytes()
        if len(word) <= 64:
            if len(self.by_word) >= REMEMBERED:
                self.former_words, self.by_word = self.by_word, {}
            self.by_word[word] = found
        return found

    def fragment_ids(self, part: str) -> tuple[int, ...]:
        """Ids of a fragment that is not in the present memory."""
        known = self.former_fragments.get(part)
        if known is None:
            bare = part.removesuffix(self.end)
            symbols = list(bare)
            if bare is not part:
                symbols[-1] += self.end
            known = self.merged(symbols)
        if len(self.by_fragment) >= REMEMBERED_FRAGMENTS:
            self.former_fragments, self.by_fragment = self.by_fragment, {}
        self.by_fragment[part] = known
        return known

    def encode(self, text: str) -> bytes:
        out = []
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                out.append(array("i", [self.added[part]]).tobytes())
            elif part:
                # Lower-casing is by character: a final capital sigma is no exception.
                plain = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                get, miss = self.by_word.get, self.word_ids
                out += [get(w) or miss(w) for w in self.words(plain)]
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by one space: the vocabulary file names no decoder."""
        return " ".join(self.tokens[ids])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> WordBpe:
    """Read once per Python worker."""
    return WordBpe(path)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "")
        if total >= SLICE_CHARS:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_notes(verdicts: DataFrame, path: str) -> DataFrame:
    """Encode every verdict's notes and decode them again.

    Input: event_id (any type), notes (text; null is empty); other columns are ignored. `path` is the
    vocabulary file, present on every machine. Result, one row per input row: event_id, ids (array of int),
    decoded (text). Empty or all-white notes give no ids and an empty text. Strings of added tokens inside
    notes are those tokens, as the vocabulary file says. No shuffle: rows are independent, and a whole text of
    any length is encoded word by word.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                coded = [bpe.encode(t) if t else b"" for t in texts[a:b]]
                ids = np.frombuffer(b"".join(coded), dtype=np.int32)
                ends = np.cumsum([0, *(len(c) // 4 for c in coded)])
                decoded = [bpe.decode(ids[i:j]) if j > i else "" for i, j in zip(ends, ends[1:])]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, pa.array(decoded, pa.string())], names=["event_id", "ids", "decoded"])

    short_batches(verdicts.sparkSession)
    rows = verdicts.selectExpr("event_id", "CAST(notes AS STRING) AS notes")
    kind = rows.schema["event_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"event_id {kind}, ids array<int>, decoded string")
