"""Changes as new states of a table: upserts, soft deletes, merges, queues, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.streaming.ingest import latest


def canonical(df: DataFrame, now: Column) -> DataFrame:
    """Rows as they are stored: importance from 1 to 10, hash, preview, class and time where they lack them."""
    bounded = F.least(F.greatest(F.coalesce("importance", F.lit(5.0)), F.lit(1.0)), F.lit(10.0))
    return df.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumns({
        "importance": bounded, "content_hash": F.sha2("content", 256), "preview": F.substring("content", 1, 200),
        "content_class": F.coalesce("content_class", F.lit("knowledge")), "created_at": F.coalesce("created_at", now),
    })


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """`old` with the latest of `new` for each key in place of what was there."""
    fresh = latest(new, key, order)
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def updated(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`df` with the non-null values of `changes` (a row for each key) in place of its own."""
    own = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in own))
    joined = df.join(renamed, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in own else c for c in df.columns))


def archived(df: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """`df` with archived_at set where the key is among `ids` and it was not set."""
    hit = df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return hit.withColumn("archived_at", F.when(F.col("_hit"), F.coalesce("archived_at", now)).otherwise(F.col("archived_at"))).select(*df.columns)


def superseded(df: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """`df` with superseded_by from pairs (old, new) of which both are in `df`."""
    real = pairs.join(df.select(F.col(key).alias("old")), "old", "left_semi").join(df.select(F.col(key).alias("new")), "new", "left_semi")
    joined = df.join(real.groupBy("old").agg(F.max("new").alias("_by")), df[key] == F.col("old"), "left")
    return joined.withColumn("superseded_by", F.coalesce("_by", "superseded_by")).select(*df.columns)


def unseen(new: DataFrame, known: DataFrame, content: str) -> DataFrame:
    """Rows whose content is not among the known ones, once each."""
    hashed = new.withColumn("_h", F.sha2(content, 256)).dropDuplicates(["_h"])
    return hashed.join(known.select(F.sha2(content, 256).alias("_h")), "_h", "left_anti").drop("_h")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row, for export."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def expired(edges: DataFrame, seen: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """`edges` with valid_until set where the latest scan no longer has them."""
    marked = edges.join(seen.select(*keys).distinct().withColumn("_seen", F.lit(True)), keys, "left")
    return marked.withColumn("valid_until", F.when(F.col("_seen").isNull(), F.coalesce("valid_until", now)).otherwise(F.col("valid_until"))).select(*edges.columns)
