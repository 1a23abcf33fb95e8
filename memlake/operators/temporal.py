"""Time: gaps, buckets, periods, timelines, as-of reads, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(df: DataFrame, scope: str, us: str, key: str, gap: int, name: str) -> DataFrame:
    """`df` with `name`: the number (from 0) of the session of each row; one ends where nothing comes for longer than `gap`."""
    w = Window.partitionBy(scope).orderBy(us, key)
    fresh = F.when(F.col(us) - F.lag(us).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn(name, F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_fresh")


def histogram(df: DataFrame, us: str, start: int, width: int, buckets: int) -> DataFrame:
    """bucket, n of all buckets from `start` on, also empty ones; what comes after the last counts in it."""
    bucket = F.least(F.floor((F.col(us) - start) / width), F.lit(buckets - 1)).cast("long")
    counts = df.where(F.col(us) >= start).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("m"))
    every = df.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("m", F.lit(0)).alias("n"))


def period(at: str, kind: str) -> Column:
    y = F.year(at).cast("string")
    return {
        "year": y, "half": F.concat(y, F.when(F.month(at) <= 6, "-H1").otherwise("-H2")), "quarter": F.concat(y, F.lit("-Q"), F.quarter(at).cast("string")),
        "month": F.date_format(at, "yyyy-MM"),
    }[kind]


def period_weight(years: Column) -> Column:
    """Weight of a period by its age in years."""
    return F.when(years < 1, 1.0).when(years < 2, 0.8).when(years < 3, 0.6).otherwise(0.4)


def with_next(df: DataFrame, scope: str, order: list[str], columns: list[str]) -> DataFrame:
    """`df` with next_<column> of the row that follows in the scope."""
    w = Window.partitionBy(scope).orderBy(*order)
    return df.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """The rows that were current then; period_start, period_end (exclusive, null: still current)."""
    return history.where((F.col("period_start") <= at) & (F.col("period_end").isNull() | (at < F.col("period_end"))))


def versions(changes: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """`changes` as history: each row holds from its time until the next of the same key."""
    w = Window.partitionBy(key).orderBy(at, tie)
    return changes.withColumn("period_start", F.col(at)).withColumn("period_end", F.lead(at).over(w))


def closed(history: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """`history` with the open rows of these ids closed at `now`; closed rows stay as they are."""
    marked = history.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumn("period_end", F.when(F.col("_hit") & F.col("period_end").isNull(), now).otherwise(F.col("period_end"))).drop("_hit")
