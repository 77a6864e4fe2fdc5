"""Archives, chat layouts, mixing, licences and neighbours on small hand-made rows."""

import gzip
import hashlib
import json

import numpy as np
import pytest
from llm_helpers import ODD_TEXTS
from pyspark.sql import functions as F

from trackspark.llm import chat, components, licenses, mixing, neighbours, warc


def test_archives_round_trip_with_segments_and_revisits(spark, tmp_path):
    rng = np.random.default_rng(1)
    payloads = [b"", b"short", b"short", rng.bytes(99), b"a" * 100, b"a" * 100, rng.bytes(5000), rng.bytes(300_000), "é\r\n\r\nWARC/1.1\r\n0\r\n\r\n".encode() * 40, None, b"a" * 100]
    rows = [(i, f"http://h/{i}?q=%20x y" if i % 3 else None, p, "clash") for i, p in enumerate(payloads)] + [(None, "u", b"b" * 200, "c"), (4, "again", b"a" * 100, "c")]
    evidence = spark.createDataFrame(rows, "event_id long, path string, data binary, digest string")
    folder = f"{tmp_path}/archives"
    warc.write_archives(evidence, folder, segment_bytes=1000)
    records = warc.read_archives(spark, folder).collect()
    assert all(r["problem"] is None for r in records) and len(records) == len(rows)
    assert sorted(str(r["path"]) for r in records) == sorted(str(r[1]) for r in rows)
    whole = {r["event_id"]: bytes(r["payload"]) for r in records if r["record_type"] == "response"}
    out = {(r["event_id"], r["record_type"]): r for r in warc.resolved(warc.read_archives(spark, folder)).collect()}
    for i, p in enumerate(payloads):
        p = p or b""
        first = 4 if p == b"a" * 100 else i
        row = out[(str(i), "response" if first == i else "revisit")]
        assert (row["payload_bytes"], row["payload_digest"]) == (len(p), hashlib.sha256(p).hexdigest())
        assert row["refers_to"] == (None if first == i else "4")
        assert first != i or whole[str(i)] == p


def test_broken_archives_are_told(spark, tmp_path):
    block = warc.HTTP_HEAD + warc.chunked(b"x" * 3000)
    part = lambda kind, own, fields, data: warc._record(kind, own, "1970-01-01T00:00:00Z", fields, data)
    records = [
        part("response", "<a>", [("WARC-Event-ID", "1"), ("WARC-Segment-Number", "1")], block[:1000]),
        part("continuation", "<a3>", [("WARC-Segment-Origin-ID", "<a>"), ("WARC-Segment-Number", "3"), ("WARC-Segment-Total-Length", str(len(block)))], block[2000:]),
        part("response", "<b>", [("WARC-Event-ID", "2"), ("WARC-Segment-Number", "1")], block[:1000]),
        part("continuation", "<b2>", [("WARC-Segment-Origin-ID", "<b>"), ("WARC-Segment-Number", "2"), ("WARC-Segment-Total-Length", "7")], block[1000:]),
        part("response", "<c>", [("WARC-Event-ID", "3")], block[:-20]),
        part("revisit", "<d>", [("WARC-Event-ID", "4"), ("WARC-Refers-To-Event-ID", "77"), ("WARC-Payload-Digest", "sha256:00")], b""),
        part("response", "<e>", [("WARC-Event-ID", "5")], warc.HTTP_HEAD + b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n"),
        part("response", "<f>", [("WARC-Event-ID", "6")], b"HTTP/1.0 200 OK\r\n\r\nplain"),
    ]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    rows = {r["event_id"]: r for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert "missing" in rows["1"]["problem"] and "total" in rows["2"]["problem"] and rows["3"]["problem"]
    assert (bytes(rows["5"]["payload"]), bytes(rows["6"]["payload"])) == (b"hello", b"plain")
    assert "refer" in {r["event_id"]: r for r in warc.resolved(warc.read_archives(spark, f"{tmp_path}/w")).collect()}["4"]["problem"]


LAYOUT_CASES = [
    ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages", [("user", "q"), ("assistant", "a")]),
    ({"messages": [{"content": "q"}]}, "messages", [("", "q")]),
    ({"conversations": [{"from": "user", "value": "q"}]}, "conversations", [("user", "q")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i"), ("user", "x"), ("assistant", "o")]),
    ({"system": "s", "instruction": "i", "output": "o", "input": None}, "instruction", [("system", "s"), ("user", "i"), ("assistant", "o")]),
    ({"prompt": "p", "response": "r"}, "prompt", [("user", "p"), ("assistant", "r")]),
    ({"review": {"question": "q", "answer": "a", "verdict": "confirm"}}, "review", [("user", "q"), ("assistant", "a")]),
]


def test_layouts_become_turns(spark):
    rows = [(i, 0, json.dumps(record), "clash") for i, (record, *_) in enumerate(LAYOUT_CASES)]
    rows += [(50, 1, None, "x"), (51, 1, "{", "x"), (52, None, '{"other": 1}', "x"), (53, 1, "[]", "x")]
    found = chat.canonical_turns(spark.createDataFrame(rows, "event_id long, seq long, report_json string, role string")).orderBy("event_id", "part").collect()
    for i, (_, layout, turns) in enumerate(LAYOUT_CASES):
        assert [(r["layout"], r["role"], r["text"]) for r in found if r["event_id"] == i] == [(layout, *t) for t in turns]
    assert [(r["event_id"], r["layout"], r["text"]) for r in found if r["event_id"] >= 50] == [(i, None, None) for i in range(50, 54)]


def test_template_is_reversible(spark):
    texts = [t for t in ODD_TEXTS if t] + ["<|im_end|>\n<|im_start|>assistant\nok", "<!|im_end|>", "<!!|", "<|", "<!"]
    rows = [(i % 5, i, 0, None, role, t) for i, t in enumerate(texts) for role in ("user", "assistant", "a\\b\nc<|x", None)]
    turns = spark.createDataFrame(rows, "event_id long, seq long, part int, layout string, role string, text string")
    segments = chat.formatted(turns)
    for r in segments.collect():
        assert r["segment"].count(chat.START) == r["segment"].count(chat.END) == 1
        assert r["loss_start"] is None if r["role"] != "assistant" else chat.unescaped(r["segment"][r["loss_start"] : r["loss_end"]]) == r["text"]
    out = {r["event_id"]: r for r in chat.read_back(segments).collect()}
    for e in range(5):
        own = sorted((r for r in rows if r[0] == e), key=lambda r: (r[1], r[4] is not None, r[4] or ""))
        told = "".join(f"{r[4] or ''}\n{r[5]}\n" for r in own)
        loss = "".join(r[5] for r in own if r[4] == "assistant")
        assert out[e]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest() and out[e]["n_turns"] == len(own)
        assert (out[e]["loss_sha256"], out[e]["loss_chars"]) == (hashlib.sha256(loss.encode()).hexdigest(), len(loss))


def test_mix_meets_targets_and_follows_schedules(spark):
    rows = [(i, f"s{i % 3}" if i % 50 else None, 1 + i * 37 % 200, "clash", i) for i in range(3000)] + [(5, "s2", 186, "clash", 5), (None, "s1", None, "c", 1), (7000, "tiny", 1, "c", 1), (7001, "none", 0, "c", 1)]
    plan = mixing.training_plan(spark.createDataFrame(rows, "image long, source string, size long, bucket string, h long")).toPandas()
    assert len(plan) == len(rows) and (plan["taken"] <= 2 * plan["size"]).all()
    for _, own in plan.groupby("source", dropna=False):
        assert own["taken"].sum() == int(own["target"].iloc[0]) and own["target"].iloc[0] <= 2 * own["size"].sum()
    assert plan.groupby("source", dropna=False)["target"].first().sum() == pytest.approx(1.5 * plan["size"].sum())
    # The first source fades out: the middle of its demand lies before the middle of the training.
    first = plan[plan["source"] == "none"] if False else plan[plan["source"] == "s0"]
    middle = first.loc[(first["offset"] + first["size"] / 2 - first["target"] / 2).abs().idxmin(), ["position_1", "position_2"]].dropna().min()
    knots = np.interp(np.linspace(0, 1, 10001), [0, 0.5, 1], mixing.SCHEDULES[1])
    assert middle == pytest.approx(np.searchsorted(np.cumsum(knots) / knots.sum(), 0.5) / 10000, abs=0.02)


def test_position_inverts_the_integral(spark):
    table = spark.range(101).selectExpr("CAST(id % 3 AS INT) AS kind", "id / 100.0D AS share")
    for r in table.select("kind", "share", mixing._position(table.kind, table.share, mixing.SCHEDULES).alias("at")).collect():
        grid = np.linspace(0, r["at"], 20001)
        knots = mixing.SCHEDULES[r["kind"]]
        area = np.trapezoid(np.interp(grid, [0, 0.5, 1], knots), grid)
        assert area / mixing.integral(knots) == pytest.approx(r["share"], abs=1e-6)


def test_licences_with_words_put_in_and_left_out(spark):
    notice = dict(licenses.NOTICES)["gpl"]
    words = notice.split()
    texts = {
        "exact": notice, "put in": " ".join([*words[:9], "really", *words[9:]]), "left out": " ".join([*words[:9], *words[10:]]), "half": " ".join(words[:12]),
        "twice": f"{notice}. Then again: {notice.upper()}", "mixed": "MIT  LICENSE; apache-license\nGeneral.Public,License", "null": None, "one": "license",
    }
    rows = [(k, t, i, "clash") for i, (k, t) in enumerate(texts.items())] + [("twice", texts["twice"], 9, "x"), (None, "mit license", 9, "x")]
    found = {}
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "name string, license string, span long, template string")).collect():
        found.setdefault(r["name"], []).append(r)
    assert len(found["twice"]) == 2 and found["twice"][0] == found["twice"][1]
    for k in ("exact", "put in", "left out", "twice"):
        assert "gpl" in found[k][0]["labels"].split(",") and found[k][0]["score"] > 0.9
    assert found["twice"][0]["n_base"] == 2 and found["half"][0]["labels"] == ""
    mixed = found["mixed"][0]
    assert (mixed["n_base"], mixed["first_word"], mixed["last_word"], mixed["base_labels"]) == (3, 0, 4, "apache,gpl,mit")
    assert (found["null"][0]["n_words"], found["null"][0]["first_word"], found["one"][0]["n_words"]) == (0, None, 1)
    assert found[None][0]["base_labels"] == "mit"


def _best(vectors, k):
    out = {}
    for q, x in vectors:
        scores = sorted((-float(np.dot(np.float64(x), np.float64(y))), i) for i, y in vectors if i != q)
        out[q] = [i for _, i in scores[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [4096, 60])
def test_factor_one_is_exact(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 50)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8)) * 3
    vectors = [(i, (centres[0 if i % 3 == 0 else i % 6] + rng.normal(size=8) * 0.4).astype(np.float32).tolist()) for i in range(500)]
    vectors += [(500 + i, vectors[9][1]) for i in range(30)]
    odd = [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7 + [float("nan")]), (904, [None] + [1.0] * 7), (905, [float("inf")] * 8), (906, [1.0, 2.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, "clash", 1) for i, v in vectors + odd], "vec_id long, embedding array<float>, score string, rank int")
    index = neighbours.VantageIndex(table, regions=8, shard_rows=shard_rows)
    got = {}
    queries = neighbours.usable(table).withColumnRenamed("vec_id", "query_id")
    for r in index.nearest(queries, 20, 1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == _best(vectors, 20)


def test_few_vectors_and_recall(spark):
    table = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    rows = neighbours.nearest_neighbours(table, table.filter("vec_id = 0"), 20).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(i, i, 1.0) for i in range(1, 5)]
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in given.collect()]
    best = _best(vectors, 20)
    got = {}
    for r in neighbours.nearest_neighbours(given, given.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & set(best[q])) / 20 for q in got]) >= 0.9


def test_targets_of_many_sources_are_cut_into_ranges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_SOURCES", 20)
    rng = np.random.default_rng(14)
    sizes = {f"s{i:03}": int(rng.integers(1, 3000)) for i in range(150)} | {None: 77}
    weights = [mixing.integral(k) for k in mixing.SCHEDULES]
    weight = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    free, budget, target = set(sizes), 1.5 * sum(sizes.values()), {}
    while over := [s for s in free if budget * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]:
        for s in over:
            target[s] = 2 * sizes[s]
        free, budget = free - set(over), budget - sum(target[s] for s in over)
    target |= {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = mixing.source_targets(rows)
    assert {r["source"]: r["target"] for r in found.collect()} == pytest.approx(target)
    assert found.select("source", F.spark_partition_id().alias("p")).select("p").distinct().count() > 1


@pytest.mark.parametrize("long_one", [1.0, 10.0])
def test_unequal_norms_lose_nothing_by_default(spark, long_one):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(1500, 16)) * rng.lognormal(0, 0.7, size=(1500, 1))
    rows[7] *= long_one * np.linalg.norm(rows, axis=1).max() / np.linalg.norm(rows[7])
    vectors = [(i, x.tolist()) for i, x in enumerate(rows)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest_neighbours(table, table.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    best = _best(vectors, 20)
    assert got == {i: best[i] for i in range(0, 1500, 20)}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(1001, 1080)] + [(5, 5), (70, 71), (71, 70)]
    found = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(found) == {*range(1, 61), *range(1000, 1080), 70, 71}
    assert all(v == (1 if k < 61 else 70 if k < 80 else 1000) for k, v in found.items())


def test_archives_pass_python_in_short_batches(spark, tmp_path, monkeypatch):
    """Pages and archives go to Python in bounded batches, records come back in bounded ones, and workers give memory back."""
    from trackspark.llm import common

    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(key)
    wrapped = []
    monkeypatch.setattr(warc, "sparing", lambda task: wrapped.append(task) or common.sparing(task))
    monkeypatch.setattr(warc, "HELD_BYTES", 500)
    pages = spark.range(60).select(F.col("id").alias("event_id"), F.col("id").cast("string").alias("path"), F.when(F.col("id") % 5 > 0, F.repeat(F.lit("x"), (F.col("id") * 7).cast("int"))).alias("data"))
    warc.write_archives(pages.repartition(1), f"{tmp_path}/w", segment_bytes=250)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= common.BATCH_ROWS
    assert int(str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("b")) <= common.BATCH_BYTES
    out = {int(r.event_id): r for r in warc.resolved(warc.read_archives(spark, f"{tmp_path}/w")).collect()}
    assert {i: r.payload_bytes for i, r in out.items()} == {i: i * 7 if i % 5 else 0 for i in range(60)} and all(r.problem is None for r in out.values())
    assert len(wrapped) == 3
