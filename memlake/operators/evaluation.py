"""Retrieval quality of a run against graded judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(run: DataFrame, qrels: DataFrame, cutoff: int) -> DataFrame:
    """query, ndcg (linear gain), recall, precision, ap, rr of each judged query; one that the run lacks has 0.

    run: query, doc, score; qrels: query, doc, grade (0 or more).
    """
    ranked = run.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))).where(F.col("rank") <= cutoff)
    hits = ranked.join(qrels.where("grade > 0"), ["query", "doc"])
    hits = hits.withColumn("found", F.count("*").over(Window.partitionBy("query").orderBy("rank")))
    got = hits.groupBy("query").agg(
        F.sum(F.col("grade") / F.log2(F.col("rank") + 1)).alias("dcg"), F.count("*").alias("n"), F.sum(F.col("found") / F.col("rank")).alias("psum"), F.min("rank").alias("first")
    )
    best = qrels.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc")))
    ideal = best.groupBy("query").agg(
        F.sum(F.when(F.col("rank") <= cutoff, F.col("grade") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("idcg"), F.count_if(F.col("grade") > 0).alias("relevant")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(got, "query", "left").select(
        "query", zero(F.try_divide("dcg", "idcg")).alias("ndcg"), zero(F.try_divide("n", "relevant")).alias("recall"), zero(F.col("n") / cutoff).alias("precision"),
        zero(F.try_divide("psum", F.col("relevant").cast("double"))).alias("ap"), zero(1 / F.col("first")).alias("rr"),
    )
