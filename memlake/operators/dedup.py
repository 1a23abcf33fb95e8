"""Duplicates among chunks: exact groups, survivors, merges, near-duplicates by bits, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import content_hash, numbers
from memlake.operators.components import connected_components
from memlake.operators.vectors import hashed_bits
from memlake.storage import materialize


def exact_groups(df: DataFrame, key: str, content: Column) -> DataFrame:
    """hash, canonical (the smallest key), seen: groups of rows of equal content hash."""
    return df.groupBy(content.alias("hash")).agg(F.min(key).alias("canonical"), F.count("*").alias("seen")).where("seen > 1")


def survivors(df: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """`df` with survivor: whether a row is the first of its group in this order."""
    return df.withColumn("survivor", F.row_number().over(Window.partitionBy(group).orderBy(*order)) == 1)


def merged(df: DataFrame, group: str, key: str) -> DataFrame:
    """One row for each group: canonical, importance (largest), tags (all, sorted), seen_count, last_seen."""
    return df.groupBy(group).agg(
        F.min(key).alias("canonical"), F.max("importance").alias("importance"), F.array_sort(F.collect_set("tag")).alias("tags"), F.count("*").alias("seen_count"), F.max("created_at").alias("last_seen")
    )


#: Fewest tokens of texts that are compared by bits, and most places in which their bits may differ.
LEAST_TOKENS, APART = 8, 3


def near_pairs(df: DataFrame, key: str, bits: str, scope: list[str], most: int = APART) -> DataFrame:
    """a, b: rows of one scope whose 64 bits differ in at most `most` (3 or fewer) places.

    Two such values share one of four bands of 16 bits, so that the join is by
    band. Rows of equal bits give all their pairs: `near_classes` takes one of
    them each.
    """
    bands = F.array(*(F.shiftrightunsigned(bits, 16 * k).bitwiseAND(0xFFFF) for k in range(4)))
    banded = df.select(F.col(key).alias("_a"), F.col(bits).alias("_x"), *scope, F.posexplode(bands).alias("_band", "_value"))
    other = banded.select(F.col("_a").alias("_b"), F.col("_x").alias("_y"), *scope, "_band", "_value")
    apart = F.bit_count(F.col("_x").bitwiseXOR(F.col("_y")))
    pairs = banded.join(other, [*scope, "_band", "_value"]).where((F.col("_a") < F.col("_b")) & (apart <= most))
    return pairs.select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct()


def near_classes(df: DataFrame, key: str, content: str, scope: list[str], week: Column | None = None, created: Column | None = None) -> DataFrame:
    """key, class_id, kept: which rows tell the same, and the first of each class.

    Rows of one scope (null counts as a value) are linked if their content
    hashes are equal, or if they have `LEAST_TOKENS` tokens, the same week (null
    with null) and the same numbers, and their bits differ in `APART` places at
    most. Classes are what links connect; class_id is the smallest key, and the
    row that was created first, then of the smallest key, is kept. Rows of equal
    bits are one vertex before the join by bands, so copies make no pairs. Rows
    of null content are their own class; keys are distinct and not null.
    """
    text = F.col(content)
    at = F.xxhash64(F.to_json(F.struct(*scope)) if scope else F.lit(0))
    own = df.select(key, text.alias("_t"), at.alias("_s"), (F.lit(None).cast("string") if week is None else week.cast("string")).alias("_w"), (F.lit(0) if created is None else created).alias("_o"))
    known = materialize(
        own.where("_t is not null").select(key, "_s", content_hash(F.col("_t")).alias("_h"), F.xxhash64(F.coalesce("_w", F.lit("")), numbers(F.col("_t"))).alias("_n"))
        .join(hashed_bits(own.where("_t is not null"), key, "_t"), key), "bits",
    )
    exact = known.groupBy("_s", "_h").agg(F.min(key).alias("a"))
    links = known.join(exact, ["_s", "_h"]).select("a", F.col(key).alias("b"))
    long = known.where(F.col("n_tokens") >= LEAST_TOKENS)
    alike = materialize(long.groupBy("_s", "_n", "simhash").agg(F.min(key).alias("a")), "alike")
    links = links.union(long.join(alike, ["_s", "_n", "simhash"]).select("a", F.col(key).alias("b")))
    links = links.union(near_pairs(alike, "a", "simhash", ["_s", "_n"]))
    labels = connected_components(own.select(F.col(key).alias("id")), links).withColumnRenamed("id", key).withColumnRenamed("component_id", "class_id")
    first = own.select(key, "_o").join(labels, key)
    best = first.groupBy("class_id").agg(F.min(F.struct("_o", key))[key].alias("_k"))
    return first.join(best, "class_id").select(key, "class_id", (F.col(key) == F.col("_k")).alias("kept"))
