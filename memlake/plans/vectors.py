"""Nearest neighbours, sign bits, graphs of neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.operators import vectors as v
from memlake.registry import query
from memlake.sources.tables import table


def _tables(spark, d):
    """All vectors, and those asked for: of every id divisible by 50."""
    e = table(spark, d, "embeddings")
    return e, e.where("vec_id % 50 = 0")


def _one(spark, d):
    """The vector of id 0, as a one-row subquery."""
    return table(spark, d, "embeddings").where("vec_id = 0").select("embedding").scalar()


def knn_sql(distance: str, k: int, where: str = "TRUE") -> str:
    """CTE n: asked, vec_id, distance, rank of the k nearest of each vector whose id is divisible by 50."""
    return f"""WITH p AS (SELECT q.vec_id AS asked, e.vec_id, e.label, round({distance}, 9) AS distance FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND {where}),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY asked ORDER BY distance, vec_id) AS rank FROM p QUALIFY rank <= {k})"""


L2 = "list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) ** 2))"
COSINE = "-list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
HAMMING = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END))"


@query("knn_l2", f"{knn_sql(L2, 10)} SELECT asked, vec_id, round(distance, 5) AS distance FROM n")
def knn_l2(spark, d):
    return v.search(*_tables(spark, d), "vec_id", "embedding", 10, "l2").select("asked", "vec_id", F.round("distance", 5).alias("distance"))


@query("knn_cosine", f"{knn_sql(COSINE, 10)} SELECT asked, vec_id, round(-distance, 6) AS likeness FROM n")
def knn_cosine(spark, d):
    return v.search(*_tables(spark, d), "vec_id", "embedding", 10).select("asked", "vec_id", F.round(-F.col("distance"), 6).alias("likeness"))


@query("knn_filtered", f"{knn_sql(COSINE, 10, 'e.label IN (1, 3)')} SELECT asked, vec_id, label, round(-distance, 6) AS likeness FROM n")
def knn_filtered(spark, d):
    e, asked = _tables(spark, d)
    few = e.where("label in (1, 3)")
    found = v.search(few, asked, "vec_id", "embedding", 10).join(few.select("vec_id", "label"), "vec_id")
    return found.select("asked", "vec_id", "label", F.round(-F.col("distance"), 6).alias("likeness"))


@query("knn_hamming", f"{knn_sql(HAMMING, 20)} SELECT asked, vec_id, distance::BIGINT AS distance FROM n")
def knn_hamming(spark, d):
    return v.search(*_tables(spark, d), "vec_id", "embedding", 20, "hamming").select("asked", "vec_id", F.col("distance").cast("long").alias("distance"))


@query("knn_rerank", f"""{knn_sql(HAMMING, 50)}, x AS (SELECT asked, n.vec_id, n.distance AS h, round({L2}, 9) AS exact FROM n JOIN embeddings e ON e.vec_id = n.vec_id JOIN embeddings q ON q.vec_id = asked)
SELECT asked, vec_id, round(exact, 5) AS distance FROM x QUALIFY ROW_NUMBER() OVER (PARTITION BY asked ORDER BY exact, h, vec_id) <= 10""")
def knn_rerank(spark, d):
    e, asked = _tables(spark, d)
    few = v.search(e, asked, "vec_id", "embedding", 50, "hamming").withColumnRenamed("distance", "h")
    few = few.join(e.select("vec_id", "embedding"), "vec_id").join(asked.select(F.col("vec_id").alias("asked"), F.col("embedding").alias("q")), "asked")
    best = F.row_number().over(Window.partitionBy("asked").orderBy("exact", "h", "vec_id"))
    exact = few.withColumn("exact", F.round(v.squared_l2("embedding", "q"), 9)).withColumn("rn", best).where("rn <= 10")
    return exact.select("asked", "vec_id", F.round("exact", 5).alias("distance"))


@query("knn_graph_edges", """WITH p AS (SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS c FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY i ORDER BY c DESC, j) AS rn FROM p) SELECT least(i, j) AS a, greatest(i, j) AS b, round(MAX(c), 6) AS weight FROM n WHERE rn <= 5 GROUP BY 1, 2""")
def knn_graph_edges(spark, d):
    return v.neighbour_edges(table(spark, d, "embeddings"), "vec_id", "embedding", 5).withColumn("weight", F.round("weight", 6))


@query("length_tiered_dups", """SELECT q.vec_id AS asked, e.vec_id FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id JOIN documents ON e.vec_id = doc_id
WHERE round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) >= CASE WHEN n_chars / 4 < 50 THEN 0.95 WHEN n_chars / 4 <= 200 THEN 0.90 ELSE 0.88 END""")
def length_tiered_dups(spark, d):
    e, asked = _tables(spark, d)
    sized = e.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), v.least_likeness(F.col("n_chars") / 4).alias("least")), "vec_id")
    return v.within(sized, asked, "vec_id", "embedding", "least").select("asked", "vec_id")


@query("label_centroids", "SELECT label, p::BIGINT AS p, round(AVG(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings) GROUP BY 1, 2")
def label_centroids(spark, d):
    c = v.mean_vectors(table(spark, d, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("p", "x")).select("label", F.col("p").cast("long").alias("p"), F.round("x", 6).alias("mean"))


@query("mmr_rerank")
def mmr_rerank(spark, d):
    e = table(spark, d, "embeddings").withColumn("q", _one(spark, d))
    scored = e.select("label", "vec_id", v.cosine("embedding", "q").alias("score"), "embedding")
    return v.diversified(scored, "label", "vec_id", "score", "embedding").select("label", "vec_id", F.round("score", 6).alias("score"), "place")


@query("simhash_bits")
def simhash_bits(spark, d):
    return v.hashed_bits(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "simhash")
