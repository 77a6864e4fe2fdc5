"""Class names, id spaces and label text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Id offsets per kind and per proposal source.
OBJECT_OFFSET = 10_000
SOURCE_OFFSETS = {"color": 50_000, "novelty": 100_000}

# Words that name one family of things.
FAMILY_WORDS = ["bag", "waste", "trash", "yellow", "bottle", "cup", "can", "paper", "tissue", "wrapper", "plastic",
                "nescafe", "plate", "garbage"]

# Object classes that may be litter, matched as substrings.
CANDIDATE_WORDS = ["plastic bottle", "bottle", "cup", "can", "tissue paper", "paper", "wrapper", "trash", "waste",
                   "bag", "garbage bag", "cardboard", "nescafe", "plate", "tissue"]

# The eight canonical classes and, per dataset, raw name -> class, in lookup order.
CANONICAL = ["person", "bottle", "cup", "can", "bag", "paper", "crumpled_tissue", "other_litter"]
CLASS_MAPS = {
    "best_pt": {"bottle": 1, "juice-cup": 2, "juice cup": 2, "nescafe": 2, "plate": 7, "tissue": 6, "tissue paper": 6},
    "taco": {
        "Plastic bottle": 1, "Glass bottle": 1, "Bottle": 1, "Plastic cap": 7, "Bottle cap": 7, "Cup": 2,
        "Paper cup": 2, "Plastic cup": 2, "Foam cup": 2, "Drink can": 2, "Food can": 2, "Can": 3, "Aluminum can": 3,
        "Steel can": 3, "Plastic bag": 4, "Paper bag": 4, "Garbage bag": 4, "Shopping bag": 4, "Carrier bag": 4,
        "Paper": 5, "Paper sheet": 5, "Paper scrap": 5, "Magazine": 5, "Newspaper": 5, "Cardboard": 5,
        "Tissue paper": 6, "Tissue": 6, "Napkin": 6, "Other": 7, "Other litter": 7, "Unlabeled litter": 7,
        "Cigarette": 7, "Cigarette butt": 7, "Mask": 7, "Glove": 7, "Plastic glove": 7, "Plastic container": 7,
        "Food container": 7, "Plastic film": 7, "Plastic wrapper": 7, "Plastic straw": 7, "Plastic utensils": 7,
        "Shoe": 7, "Clothing": 7, "Cloth": 7, "Tire": 7, "Toy": 7, "Book": 7},
    "garbage": {"trash": 7, "garbage": 7, "litter": 7, "plastic": 1, "bottle": 1, "can": 3, "bag": 4, "paper": 5,
                "cup": 2, "tissue": 6},
    "roboflow": {"bottle": 1, "plastic-bottle": 1, "pet-bottle": 1, "cup": 2, "paper-cup": 2, "can": 3,
                 "aluminum-can": 3, "drink-can": 3, "bag": 4, "plastic-bag": 4, "shopping-bag": 4, "paper": 5,
                 "newspaper": 5, "cardboard": 5, "tissue": 6, "tissue-paper": 6, "napkin": 6, "litter": 7, "trash": 7,
                 "garbage": 7},
    "wade": {"plastic-bottle": 1, "plastic-bag": 4, "plastic-cup": 2, "aluminum-can": 3, "paper-cup": 2,
             "paper-bag": 4, "tissue-paper": 6, "waste": 7, "litter": 7},
}


def namespaced(raw_id: Column, is_person: Column, source: Column | None = None) -> Column:
    """Global track id: persons keep theirs, objects move up, proposals move up once more first."""
    shifted = raw_id
    if source is not None:
        for name, offset in SOURCE_OFFSETS.items():
            shifted = F.when(source == name, raw_id + offset).otherwise(shifted)
    return F.when(is_person, raw_id).otherwise(shifted + OBJECT_OFFSET)


def is_object_id(global_id: Column) -> Column:
    return global_id >= OBJECT_OFFSET


def raw_id_of(global_id: Column) -> Column:
    return F.when(is_object_id(global_id), global_id - OBJECT_OFFSET).otherwise(global_id)


def family(class_name: Column) -> Column:
    """Family words found in a class name."""
    low = F.lower(F.coalesce(class_name, F.lit("")))
    return F.filter(F.array(*(F.lit(w) for w in FAMILY_WORDS)), lambda w: F.contains(low, w))


def family_words(class_name: Column) -> Column:
    """`family` joined by spaces: compiled, where a filter of an array is interpreted for every row."""
    low = F.lower(F.coalesce(class_name, F.lit("")))
    return F.concat_ws(" ", *(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in FAMILY_WORDS))


def same_family(a: Column, b: Column) -> Column:
    """Families overlap; an empty family matches everything."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def is_candidate(class_name: Column) -> Column:
    low = F.lower(class_name)
    return F.exists(F.array(*(F.lit(w) for w in CANDIDATE_WORDS)), lambda w: F.contains(low, w))


def mapping_rows(source: str = "auto") -> list[tuple[int, bool, str, int]]:
    """(ordinal, exact, pattern, class id) in lookup order: each map's exact names, then its substrings.

    Input names are lower-cased but exact keys are not, so a capitalised key can only match as a
    substring and the order of entries decides.
    """
    maps = CLASS_MAPS.values() if source == "auto" else [CLASS_MAPS[source]]
    rows: list[tuple[int, bool, str, int]] = []
    for entries in maps:
        rows += [(0, True, raw, cid) for raw, cid in entries.items()]
        rows += [(0, False, raw.lower(), cid) for raw, cid in entries.items()]
    return [(i, exact, raw, cid) for i, (_, exact, raw, cid) in enumerate(rows)]


def canonical_ids(names: DataFrame, column: str, source: str = "auto") -> DataFrame:
    """`names` with `class_id`: the canonical class of a dataset's class name, -1 when nothing matches.

    The distinct names meet the ordered map (a table of fixed size) once: exact entries by equality, the others by
    containment; the first entry in order decides.
    """
    distinct = names.select(column).distinct().withColumn("_name", F.lower(F.trim(F.col(column))))
    rows = [F.struct(F.lit(i).alias("at"), F.lit(exact).alias("exact"), F.lit(raw).alias("raw"), F.lit(cid).alias("cid")) for i, exact, raw, cid in mapping_rows(source)]
    found = F.filter(F.array(*rows), lambda m: F.when(m["exact"], F.col("_name") == m["raw"]).otherwise(F.contains(F.col("_name"), m["raw"])))
    known = distinct.select(F.col(column).alias("_key"), F.coalesce(F.get(found, F.lit(0))["cid"], F.lit(-1)).alias("class_id"))
    return names.join(known, names[column].eqNullSafe(known["_key"]), "left").drop("_key")


def canonical_name(class_id: Column) -> Column:
    names = F.array(*(F.lit(c) for c in CANONICAL))
    return F.when(class_id.between(0, len(CANONICAL) - 1), F.get(names, class_id)).otherwise("unknown")


def is_semantic(source: Column, class_name: Column) -> Column:
    """True for boxes that may start an event; proposals (novelty, unknown, colour candidates) may not."""
    src, cls = F.lower(F.coalesce(source, F.lit("yolo"))), F.lower(F.coalesce(class_name, F.lit("")))
    return src.isin("yolo", "color") & (cls != "detected_object") & ~F.startswith(cls, F.lit("color_candidate"))


SOURCE_RANK = {"yolo": 0, "color": 1, "novelty": 2}


def source_rank(source: Column) -> Column:
    out = F.lit(0)
    for name, rank in SOURCE_RANK.items():
        out = F.when(F.lower(source) == name, F.lit(rank)).otherwise(out)
    return out
