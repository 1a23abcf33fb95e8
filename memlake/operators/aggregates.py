"""Aggregates over tags, sessions, statuses, facts and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_counts(df: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    """Groups by size, largest first; ties by key."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
    return out.limit(limit) if limit else out


def singletons(tags: DataFrame, tag: str = "tag") -> DataFrame:
    return tags.groupBy(tag).agg(F.count("*").alias("n")).where("n = 1").select(tag)


def without(df: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    return df.join(gone.select(column), column, "left_anti")


def joined_distinct(column: str, separator: str = ",") -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), separator)


def min_max(column: str, low: float, high: float) -> Column:
    """Values scaled over all rows from `low` to `high`; one value alone goes to the middle."""
    every = Window.partitionBy()
    least, most = F.min(column).over(every), F.max(column).over(every)
    return F.when(most > least, low + (F.col(column) - least) / (most - least) * (high - low)).otherwise((low + high) / 2)


def scaled(df: DataFrame, column: str, low: float, high: float, name: str) -> DataFrame:
    """As `min_max`, by one row of totals and not one window over all rows."""
    ends = df.agg(F.struct(F.min(column).alias("a"), F.max(column).alias("z")).alias("e")).scalar()
    out = df.withColumn("_e", ends)
    value = F.when(F.col("_e.z") > F.col("_e.a"), low + (F.col(column) - F.col("_e.a")) / (F.col("_e.z") - F.col("_e.a")) * (high - low))
    return out.withColumn(name, value.otherwise((low + high) / 2)).drop("_e")


def importance_bucket(column: str) -> Column:
    c = F.col(column)
    return F.when(c.isNull(), "NULL").when(c < 3, "1-2").when(c < 5, "3-4").when(c < 7, "5-6").when(c < 9, "7-8").otherwise("9-10")


def mean_rank(column: str, *scope: str) -> Column:
    """Rank with ties at their mean, as rank correlation takes it."""
    w = Window.partitionBy(*scope).orderBy(column)
    same = Window.partitionBy(*scope, column)
    return F.rank().over(w) + (F.count("*").over(same) - 1) / 2


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group in this order."""
    return best_of(df, keys, order, 1)


def best_of(df: DataFrame, keys: list[str], order: list[Column | str], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group in this order, with their rank (from 1) if a name for it is given."""
    out = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n)
    return out.withColumn(rank, F.col("_rn").cast("long")).drop("_rn") if rank else out.drop("_rn")
