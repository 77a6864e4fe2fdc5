"""A training-data pipeline over the given documents: five stages, each of one operator, each written and read again.

Documents play the project's operator notes: `doc_id` is the event, `text` its notes, and a label of quality 1 that is
not toxic is a confirmed verdict. A document counts by its id: rows that repeat an id stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.llm import bpe, langid, minhash, mixing, quality
from trackspark.llm.common import WORD, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language predicted with less probability is no language: four languages share 1 evenly at 0.25.
LEAST_SCORE = 0.3


def _notes(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").alias("event_id"), F.col("text").alias("notes"), *more)


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = ids.select(F.col("event_id").alias("_id")).distinct()
    return docs.select(*COLUMNS).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language; a missing language becomes the predicted one. All labelled rows teach."""
    model = langid.train(_notes(docs, "lang"))
    rows = langid.predict_languages(docs.select(*COLUMNS, F.col("text").alias("notes")), model)
    rows = rows.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return rows.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the perplexity bounds of their language."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("event_id"))
    rated = quality.rated_notes(_notes(docs, "lang"), trusted)
    return _with_ids(docs, rated.filter("kept")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; repeated rows once."""
    found = minhash.near_duplicates(_notes(docs))
    rows = _with_ids(docs, found.filter("kept")).withColumn("_text", F.xxhash64("text"))
    return rows.dropDuplicates(["doc_id", "_text"]).select(*COLUMNS)


def curriculum_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy of a document that the mix takes, whole, in training order.

    A pass that takes at least half of a document takes all of it, so each source is within half a document of its target.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    plan = mixing.training_plan(docs.select(F.col("doc_id").alias("image"), "source", size.alias("size")))
    at = lambda i: F.when((F.col("size") > 0) & (F.col(f"taken_{i}") * 2 >= F.col("size")), F.col(f"position_{i}"))
    plan = plan.select(F.col("image").alias("_id"), F.array_compact(F.array(at(1), at(2))).alias("_at")).filter(F.size("_at") > 0)
    plan = plan.groupBy("_id").agg(F.max("_at").alias("_at"))
    copies = docs.select(*COLUMNS).join(plan, F.col("doc_id").eqNullSafe(F.col("_id"))).select(*COLUMNS, F.explode("_at").alias("_position"))
    return mixing.in_training_order(copies, "_position", "doc_id").select(*COLUMNS)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and whether they decode to as many tokens as there are ids."""
    coded = bpe.encode_notes(_notes(docs), public_tokenizers.path("word_bpe_49k.json"))
    tokens = F.when(F.length("decoded") > 0, F.size(F.split("decoded", " ", -1))).otherwise(0)
    return coded.select(F.col("event_id").alias("doc_id"), F.size("ids").alias("n_tokens"), "ids", (tokens == F.size("ids")).alias("decodes"))


STAGES = [("language_id", language_id), ("quality", quality_filter), ("near_dedup", near_dedup), ("curriculum_mix", curriculum_mix), ("bpe", bpe_encode)]
#: Learned models, near-duplicate groups and BPE are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
