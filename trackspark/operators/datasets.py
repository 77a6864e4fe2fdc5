"""Label datasets: remapping, merging, sampling and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackspark.operators import longseq


def shuffled_key(item: Column, seed: int) -> Column:
    """A reproducible random order: the hash of the item with the seed."""
    return F.md5(F.concat_ws("#", item.cast("string"), F.lit(str(seed))))


def remap(boxes: DataFrame, mapping: Mapping[str, int], name: str = "class_name") -> DataFrame:
    """Boxes with a mapped class get `class_id`; others drop out.

    The mapping is a handful of fixed names, so it becomes an expression, not a join.
    """
    low = F.lower(F.trim(F.col(name)))
    class_id = F.lit(None).cast("int")
    for raw, cid in mapping.items():
        class_id = F.when(low == raw, F.lit(cid)).otherwise(class_id)
    return boxes.withColumn("class_id", class_id).where(F.col("class_id").isNotNull())


def merged_counts(images: DataFrame, boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every image with its label count; images without labels stay as negatives."""
    counts = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("labels"))
    return images.join(counts, list(keys), "left").na.fill(0, ["labels"])


def seeded_split(items: DataFrame, item: str, seed: int, share: float = 0.8) -> DataFrame:
    """U8: first `share` of a hash-shuffled order is train, the rest val; exact, without a global sort.

    Ranks come from per-prefix counts of the hash, so no task orders all items.
    """
    keyed = items.withColumn("_all", F.lit(0)).withColumn("_h", shuffled_key(F.col(item), seed))
    prefix = F.conv(F.substring("_h", 1, 3), 16, 10).cast("bigint")
    ranked = longseq.with_ordinal(keyed, ["_all"], ["_h", item], prefix, "_rank")
    total = items.agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    cut = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return ranked.join(total, "_all").withColumn("split", F.when(F.col("_rank") <= cut, "train").otherwise("val")).drop("_all", "_h", "_rank", "_n")


def replay_mix(samples: DataFrame, new_ratio: float, seed: int, max_samples: int) -> DataFrame:
    """U4: a mix of new and replayed samples at a ratio and cap, distinct images, then split 80/20.

    `samples`: image, pool ("new" or "replay"). The cap is the feature; Spark trims each pool to it
    before the shuffle. The new quota rounds halves to even. Without any replay sample the new pool fills the
    whole target. An image of both pools counts as new.
    """
    sizes = samples.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pool") == "replay").alias("old"))
    target = F.least(F.lit(max_samples), F.greatest(F.lit(1), F.col("n")))
    share = F.when(F.col("old") == 0, target).otherwise(F.bround(target * new_ratio).cast("bigint"))
    quota = F.broadcast(sizes.select(F.explode(F.array(F.struct(F.lit("new").alias("pool"), share.alias("quota")), F.struct(F.lit("replay").alias("pool"), (target - share).alias("quota")))).alias("q")).select("q.*"))
    w = Window.partitionBy("pool").orderBy(shuffled_key(F.col("image"), seed), "image")
    ranked = samples.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_samples)
    picked = ranked.join(quota, "pool").where(F.col("_r") <= F.col("quota"))
    return seeded_split(picked.groupBy("image").agg(F.min("pool").alias("pool")), "image", seed)


def usable_boxes(boxes: DataFrame, low: float = 0.01, high: float = 0.70) -> DataFrame:
    """boxes whose share of the image is neither tiny nor a close-up."""
    share = F.col("w") * F.col("h") / (F.col("image_w") * F.col("image_h"))
    return boxes.where(share.between(low, high))


def prioritised(images: DataFrame, first: Column, tie: Sequence[str], limit: int) -> DataFrame:
    """The first `limit` images, those matching `first` ahead of the rest."""
    return images.orderBy(F.when(first, 0).otherwise(1), *tie).limit(limit)


def distribution(labels: DataFrame) -> DataFrame:
    """Images and instances per class, with subtotals per dataset, split and overall."""
    cube = labels.rollup("dataset", "split", "class_id").agg(F.count(F.lit(1)).alias("instances"), F.countDistinct("image_id").alias("images"), F.grouping_id().alias("level"))
    return cube.select(F.coalesce("dataset", F.lit("ALL")).alias("dataset"), F.coalesce("split", F.lit("ALL")).alias("split"), F.coalesce("class_id", F.lit(-1)).alias("class_id"),
                       "instances", "images", F.col("level").cast("int").alias("level"))


def distinct_configs(configs: DataFrame, knobs: Sequence[str]) -> DataFrame:
    """Configs with the same content once, the first of each kept in order."""
    return configs.groupBy(*knobs).agg(F.min("ordinal").alias("ordinal"))
