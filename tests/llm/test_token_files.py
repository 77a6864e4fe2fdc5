"""Token files: blocks, whole files, and the query against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import ODD_TEXTS, SF, empty_tables, odd_documents
from tokenizers import Tokenizer

from trackspark.llm import queries, tokenfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, tokenfiles.END_ID]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1), st.sampled_from([0, 2**31, 2**32 - 1])), max_size=300), max_size=6), st.data())
def test_a_file_gives_back_every_stretch(verdicts, data):
    ids = [np.array(v, np.uint32) for v in verdicts]
    keys = [None if i % 3 == 2 else i - 2 for i in range(len(ids))]
    file = tokenfiles.TokenFile(tokenfiles.token_file(keys, ids, 7, 3))
    assert (file.part, file.number, file.event_ids.to_pylist()) == (7, 3, keys)
    stream = [x for v in verdicts for x in v]
    assert file.ids(0, file.n_ids).tolist() == stream
    assert [file.ids(int(a), int(b)).tolist() for a, b in zip(file.starts, file.starts[1:])] == verdicts
    a = data.draw(st.integers(0, len(stream)))
    b = data.draw(st.integers(a, len(stream)))
    assert file.ids(a, b).tolist() == stream[a:b]


def test_widths_leave_at_most_a_tenth_to_exceptions():
    rng = np.random.default_rng(5)
    ids = np.where(rng.random(128 * 50) < 0.05, rng.integers(0, 2**32, 128 * 50), 500 + rng.integers(0, 64, 128 * 50)).astype(np.uint32)
    file = tokenfiles.TokenFile(tokenfiles.token_file([1], [ids], 0, 0))
    assert file.ids(0, len(ids)).tolist() == ids.tolist()
    assert np.diff(file.first_exception).max() <= 12 and len(file.packed) * 4 < len(ids) * 1.3
    flat = tokenfiles.TokenFile(tokenfiles.token_file([1], [np.full(1000, 9, np.uint32)], 0, 0))
    assert len(flat.packed) == 0 and flat.ids(0, 1000).tolist() == [9] * 1000


def test_broken_files_are_refused():
    good = tokenfiles.token_file([1, 2], [np.arange(300, dtype=np.uint32), np.arange(5, dtype=np.uint32)], 0, 0)
    changed = bytearray(good)
    changed[200] ^= 1
    for content in (b"", good[:-1], good[:100], bytes(changed)):
        with pytest.raises(ValueError):
            tokenfiles.TokenFile(content)


LONG = ["x" * 60_000, "ab " * 40_000, "   b \t\n  c　　d  ", "a <|endoftext|>  <|endoftext|>b", "'s 'S I'll we'LL 12 3.4½ ١", "\U0001f600‍éé" * 30, "\x00\x1c\x1d\x85 a"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t ab'sl.<|>1̀", max_size=60))
def test_ranks_give_the_library_s_ids(text):
    assert tokenfiles.encoder(PATH)(text).tolist() == ids_of(text)[:-1]


def test_long_and_odd_texts_give_the_library_s_ids():
    for text in [*filter(None, ODD_TEXTS), *LONG]:
        assert tokenfiles.encoder(PATH)(text).tolist() == ids_of(text)[:-1]
    # A vocabulary that is not plain goes through the library.
    words = public_tokenizers.path("word_bpe_49k.json")
    assert tokenfiles.encoder(words)("Some plain words").tolist() == Tokenizer.from_file(words).encode("Some plain words", add_special_tokens=False).ids


def expected(rows):
    """(doc_id, start, n_tokens, crc) of rows in order."""
    out, start = [], 0
    for key, text in rows:
        ids = ids_of(text)
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_IDS", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = queries.QUERIES["op13_token_blocks"](spark, SF).collect()
    assert sorted(map(tuple, found)) == expected(sorted((r["doc_id"], r["text"]) for r in docs))


def test_odd_rows_and_empty_tables(spark, tmp_path):
    empty_tables(spark, tmp_path)
    assert queries.QUERIES["op13_token_blocks"](spark, str(tmp_path)).collect() == []
    odd_documents(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    found = sorted(map(tuple, queries.QUERIES["op13_token_blocks"](spark, str(tmp_path)).collect()), key=lambda r: r[1])
    keys = [r[0] for r in found]
    assert keys == sorted((r["doc_id"] for r in docs), key=lambda k: (k is None, k or 0))
    assert sorted((r[0] is None, r[0] or 0, r[2], r[3]) for r in found) == sorted((r["doc_id"] is None, r["doc_id"] or 0, *expected([(0, r["text"])])[0][2:]) for r in docs)
    assert all(a[1] + a[2] == b[1] for a, b in zip(found, found[1:])) and found[0][1] == 0
    # Reruns agree, with ties and with rows without an id.
    assert found == sorted(map(tuple, queries.QUERIES["op13_token_blocks"](spark, str(tmp_path)).collect()), key=lambda r: r[1])
