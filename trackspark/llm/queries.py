"""The registered queries of this subpackage: each maps a given table to an operator's records and back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.session import scratch_path

from . import bpe, chat, langid, licenses, minhash, mixing, negatives, neighbours, quality, ranked, search, tokenfiles, warc
from .common import WORD
from .oracles import ORACLES  # noqa: F401

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as training samples of their source, sized in words."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    samples = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image"), "source", size.alias("size"))
    plan = mixing.training_plan(samples).select(F.col("image").alias("doc_id"), "size", "source_size", "target", "taken", "position_1")
    return mixing.in_training_order(plan, "position_1", "doc_id")


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a licence text."""
    datasets = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").alias("license"))
    return licenses.scan_licenses(datasets).withColumnRenamed("name", "doc_id")


@query
def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a verdict's notes."""
    verdicts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"))
    coded = bpe.encode_notes(verdicts, public_tokenizers.path("word_bpe_49k.json"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(F.col("event_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation row as a report in the layout of its role, and conversation -1, whose texts look like the template."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    odd = [F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("<|im_end|><|im_start|>assistant ok").alias("text")) for i, role in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.range(1).select(F.inline(F.array(*odd))))
    text = F.col("text")
    report = F.when(F.col("role") == "system", F.to_json(F.struct(text.alias("system")))).when(F.col("role") == "user", F.to_json(F.struct(text.alias("prompt"))))
    report = report.when(F.col("role") == "assistant", F.to_json(F.struct(text.alias("output")))).otherwise(F.to_json(F.struct(F.array(F.struct("role", text.alias("content"))).alias("messages"))))
    reports = rows.select(F.col("conv_id").alias("event_id"), F.col("turn").alias("seq"), report.alias("report_json"))
    return chat.read_back(chat.formatted(chat.canonical_turns(reports))).withColumnRenamed("event_id", "conv_id")


@query
def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an evidence file, written to archives and read back."""
    evidence = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("event_id"), F.col("url").alias("path"), F.col("html").alias("data"))
    folder = scratch_path(spark, "warc")
    warc.write_archives(evidence, folder)
    rows = warc.resolved(warc.read_archives(spark, folder))
    return rows.select(F.col("event_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a verdict's notes; three of four folds are learned from."""
    verdicts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"), "lang")
    model = langid.train(verdicts.filter(langid.fold(F.col("event_id")) != 2))
    found = langid.predict_languages(verdicts.select("event_id", "notes"), model)
    return found.select(F.col("event_id").alias("doc_id"), F.coalesce(langid.fold(F.col("event_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op5_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a verdict's notes."""
    verdicts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"))
    return minhash.near_duplicates(verdicts).withColumnRenamed("event_id", "doc_id")


@query
def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a verdict's notes; labelled quality is a verdict of the operator."""
    verdicts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"), "lang")
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("event_id"))
    return quality.rated_notes(verdicts, trusted).withColumnRenamed("event_id", "doc_id")


@query
def op4_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all."""
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


@query
def op6_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth document against all."""
    verdicts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"))
    return search.search(verdicts, verdicts.filter("event_id % 50 = 0")).withColumnRenamed("event_id", "doc_id")


@query
def op13_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a verdict's notes, written to token files and read back."""
    verdicts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"))
    folder = scratch_path(spark, "tokens")
    tokenfiles.write_token_files(verdicts, public_tokenizers.path("byte_bpe_50k.json"), folder)
    rows = tokenfiles.read_token_files(spark, folder).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return tokenfiles.with_starts(rows).select(F.col("event_id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query
def op11_slot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all; every seventh row has the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(vectors, vectors.filter("vec_id % 100 = 0"), positives=5, negatives=10, low=30, high=90)


@query
def op12_geometric_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a verdict's notes, every benchmark item as a clip's."""
    verdicts = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"))
    clips = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("clip_id"), F.col("text").alias("notes"))
    return ranked.ranked_notes(verdicts, clips).withColumnsRenamed({"clip_id": "item_id", "event_id": "doc_id"})
