"""Communities of a graph, their labels, likeness of sessions, pacing of keys."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.storage import materialize


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, label after so many rounds: each node takes the label of most weight around it and itself, ties to the smaller.

    edges: a, b, weight, undirected. Stands for community detection; each round is one join and two groupings.
    """
    edges = materialize(edges.select("a", "b", "weight"), "edges")
    both = edges.union(edges.select("b", "a", "weight")).toDF("id", "other", "weight")
    labels = both.select("id").distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        around = both.join(labels.select(F.col("id").alias("other"), "label"), "other").select("id", "label", "weight")
        votes = around.union(labels.select("id", "label", F.lit(0.5))).groupBy("id", "label").agg(F.sum("weight").alias("w"))
        labels = votes.groupBy("id").agg(F.max_by("label", F.struct(F.round("w", 9), -F.col("label"))).alias("label"))
        labels = materialize(labels, "labels")
    return labels


def term_labels(df: DataFrame, group: str, terms: Column, top: int = 5) -> DataFrame:
    """group, term, score, rank of the terms that tell a group from the others: frequency in the group by log(1 + mean size / frequency in all)."""
    counts = df.select(group, F.explode(terms).alias("term")).groupBy(group, "term").agg(F.count("*").alias("tf"))
    every = counts.groupBy("term").agg(F.sum("tf").alias("f"))
    sizes = counts.groupBy(group).agg(F.sum("tf").alias("n"))
    mean = sizes.agg(F.avg("n")).scalar()
    scored = counts.join(sizes, group).join(every, "term").withColumn("mean", mean)
    scored = scored.withColumn("score", F.col("tf") / F.col("n") * F.log(1 + F.col("mean") / F.col("f")))
    w = Window.partitionBy(group).orderBy(F.desc(F.round("score", 9)), "term")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).select(group, "term", "score", "rank")


def session_likeness(cosine: Column, shared: Column, hours: Column, branch: Column, plan: Column) -> Column:
    """Weights of vectors, files, nearness in a week and a common branch (1) or plan (0.7)."""
    return 0.40 * cosine + 0.35 * shared + 0.15 * F.greatest(F.lit(0.0), 1 - hours / 168) + 0.10 * F.when(branch, 1.0).when(plan, 0.7).otherwise(0.0)


def paced(events: DataFrame, key: str, us: str, rate: float, burst: int) -> DataFrame:
    """`events` with allowed: a bucket of `burst` tokens a key, filled by `rate` a second; an allowed event takes one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(us, kind="stable", ignore_index=True)
        left, last, out = float(burst), None, []
        for t in pdf[us]:
            left = min(float(burst), left + (0 if last is None else (t - last) / 1e6 * rate))
            last = t
            out.append(left >= 1)
            left -= out[-1]
        return pdf.assign(allowed=out)

    return events.groupBy(key).applyInPandas(run, events.withColumn("allowed", F.lit(True)).schema)


def calibrated(importance: Column, manual: Column, media: Column, conversation: Column, decision: Column) -> Column:
    """Importance in steps that each see the one before: unknown is 5, manual at least 8, media at most 5, talk without decisions 2 less and at most 5."""
    known = F.coalesce(importance, F.lit(5.0))
    known = F.when(manual, F.greatest(known, F.lit(8.0))).otherwise(known)
    known = F.when(media, F.least(known, F.lit(5.0))).otherwise(known)
    known = F.when(conversation & ~decision, F.least(known - 2, F.lit(5.0))).otherwise(known)
    return F.greatest(known, F.lit(1.0))


def rewound(rows: DataFrame, rewinds: DataFrame, source: str, offset: str) -> DataFrame:
    """`rows` without those past the new end of a source that has shrunk; rewinds: the source, end."""
    ends = rewinds.groupBy(source).agg(F.min("end").alias("_end"))
    return rows.join(ends, source, "left").where(F.col("_end").isNull() | (F.col(offset) <= F.col("_end"))).drop("_end")
