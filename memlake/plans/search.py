"""Ranked retrieval over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import scores
from memlake.operators import search as s
from memlake.operators import vectors as v
from memlake.registry import query
from memlake.sources.tables import TRANSCRIPT, micros, table, transcript

TERMS = ["the", "und", "est"]
TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
BM25 = f"""t AS (SELECT doc_id, {TOK} AS w FROM documents), n AS (SELECT COUNT(*) AS n, AVG(len(w)) AS mean FROM t),
tf AS (SELECT doc_id, len(w) AS size, term, len(list_filter(w, lambda x: x = term)) AS tf FROM t, (SELECT unnest(['the', 'und', 'est']) AS term) WHERE list_contains(w, term)),
df AS (SELECT term, COUNT(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT doc_id, SUM(ln((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score FROM tf JOIN df USING (term), n GROUP BY 1 HAVING score > 0)"""
SEM = "qv AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0), sem AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], qv) AS likeness FROM embeddings, qv)"
#: Of every vector whose id is divisible by 50 the legs of its own neighbours and of the text.
LEGS = f"""{BM25}, q AS (SELECT vec_id AS asked, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
f AS (SELECT asked, doc_id, r_fts FROM q, (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS r_fts FROM bm QUALIFY r_fts < 50)),
m AS (SELECT asked, vec_id AS doc_id, ROW_NUMBER() OVER (PARTITION BY asked ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], qv), 9) DESC, vec_id) - 1 AS r_sem FROM embeddings, q QUALIFY r_sem < 50)"""
KEY = ["asked", "doc_id"]


def _asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0")


def _for_each(spark, d, leg):
    """A leg that is the same for all that ask (50 rows at most)."""
    rows = leg.agg(F.collect_list(F.struct("*"))).scalar()
    return _asked(spark, d).select(F.col("vec_id").alias("asked"), F.explode(rows).alias("_l")).select("asked", "_l.*")


def _text_leg(spark, d):
    scored = s.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS).withColumn("score", F.round("score", 9))
    return _for_each(spark, d, s.ranked(scored, "score", "doc_id", "r_fts", 50))


def _vector_leg(spark, d):
    near = v.search(table(spark, d, "embeddings"), _asked(spark, d), "vec_id", "embedding", 50)
    return near.select("asked", F.col("vec_id").alias("doc_id"), (F.col("rank") - 1).cast("long").alias("r_sem"))


def _recent_leg(spark, d):
    return _for_each(spark, d, s.ranked(table(spark, d, "documents"), "doc_id", "doc_id", "r_new", 25))


@query("fts_bm25_topk", f"WITH {BM25} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def fts_bm25_topk(spark, d):
    scored = s.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS)
    return scored.orderBy(F.desc(F.round("score", 9)), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


@query("fts_and_mode", f"SELECT doc_id, 3::BIGINT AS hits FROM documents WHERE list_has_all({TOK}, ['the', 'and', 'of'])")
def fts_and_mode(spark, d):
    return s.matching(table(spark, d, "documents"), "doc_id", "text", ["the", "and", "of"])


@query("fts_or_mode", f"SELECT doc_id, len(list_intersect({TOK}, ['la', 'und', 'of', 'que']))::BIGINT AS hits FROM documents WHERE list_has_any({TOK}, ['la', 'und', 'of', 'que'])")
def fts_or_mode(spark, d):
    return s.matching(table(spark, d, "documents"), "doc_id", "text", ["la", "und", "of", "que"])


@query("fts_prefix", f"SELECT doc_id FROM documents WHERE len(list_filter({TOK}, lambda x: starts_with(x, 'thi'))) > 0 AND len(list_filter({TOK}, lambda x: starts_with(x, 'wa'))) > 0")
def fts_prefix(spark, d):
    return s.with_prefix(table(spark, d, "documents"), "doc_id", "text", ["thi", "wa"])


@query("fts_expanded_groups", f"SELECT doc_id FROM documents WHERE list_has_any({TOK}, ['the', 'le']) AND list_has_any({TOK}, ['on', 'ist'])")
def fts_expanded_groups(spark, d):
    return s.matching_groups(table(spark, d, "documents"), "doc_id", "text", [["the", "le"], ["on", "ist"]])


@query("trigram_substring", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion th')")
def trigram_substring(spark, d):
    return table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("tion th"))).select("doc_id")


@query("fts_by_length", "SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'ation') ORDER BY n_chars DESC, doc_id LIMIT 25")
def fts_by_length(spark, d):
    return table(spark, d, "documents").where(F.contains(F.lower("text"), F.lit("ation"))).orderBy(F.desc("n_chars"), "doc_id").limit(25).select("doc_id", "n_chars")


@query("rrf_two_leg", f"WITH {LEGS} SELECT asked, doc_id, round(COALESCE(0.25 / (60 + r_sem), 0) + COALESCE(0.75 / (60 + r_fts), 0), 9) AS score FROM f FULL JOIN m USING (asked, doc_id)")
def rrf_two_leg(spark, d):
    return s.hybrid(_vector_leg(spark, d), _text_leg(spark, d), KEY).select(*KEY, F.round("score", 9).alias("score"))


@query("rrf_three_leg", f"""WITH {LEGS}, r AS (SELECT asked, doc_id, r_new FROM q, (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY doc_id DESC) - 1 AS r_new FROM documents QUALIFY r_new < 25))
SELECT asked, doc_id, round(COALESCE(0.25 / (60 + r_sem), 0) + COALESCE(0.75 / (60 + r_fts), 0) + COALESCE(0.75 / (60 + r_new), 0), 9) AS score FROM f FULL JOIN m USING (asked, doc_id) FULL JOIN r USING (asked, doc_id)""")
def rrf_three_leg(spark, d):
    legs = [(_vector_leg(spark, d), "r_sem", 0.25), (_text_leg(spark, d), "r_fts", 0.75), (_recent_leg(spark, d), "r_new", 0.75)]
    return s.fuse(legs, KEY).select(*KEY, F.round("score", 9).alias("score"))


@query("rrf_boosted", f"""WITH {LEGS}, u AS (SELECT asked, doc_id, COALESCE(0.25 / (60 + r_sem), 0) + COALESCE(0.75 / (60 + r_fts), 0) AS score FROM f FULL JOIN m USING (asked, doc_id))
SELECT u.asked, u.doc_id, round(score * (1 + least(greatest(d.n_chars / 1000, 0), 10) / 20) * (0.7 + 0.3 * exp(-0.023 * (d.n_chars / 100))) * CASE WHEN l.toxic = 1 THEN 0.05 ELSE 1 END, 9) AS score
FROM u JOIN documents d ON d.doc_id = u.doc_id LEFT JOIN labels l ON l.doc_id = u.doc_id""")
def rrf_boosted(spark, d):
    fused = s.hybrid(_vector_leg(spark, d), _text_leg(spark, d), KEY).select(*KEY, "score")
    rows = fused.join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    boost = scores.importance_boost(F.col("n_chars") / 1000) * scores.recency_boost(F.col("n_chars") / 100) * F.when(F.col("toxic") == 1, scores.NOISE).otherwise(1.0)
    return rows.select(*KEY, F.round(F.col("score") * boost, 9).alias("score"))


@query("rrf_kg_boost", f"""WITH {LEGS} SELECT asked, doc_id, round((COALESCE(0.25 / (60 + r_sem), 0) + COALESCE(0.75 / (60 + r_fts), 0)) * CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1.3 ELSE 1 END, 9) AS score
FROM f FULL JOIN m USING (asked, doc_id)""")
def rrf_kg_boost(spark, d):
    fused = s.hybrid(_vector_leg(spark, d), _text_leg(spark, d), KEY).select(*KEY, "score")
    linked = table(spark, d, "labels").where("quality = 1").select("doc_id").distinct().withColumn("linked", F.lit(True))
    boost = F.when(F.col("linked"), scores.KG_BOOST).otherwise(1.0)
    return fused.join(linked, "doc_id", "left").select(*KEY, F.round(F.col("score") * boost, 9).alias("score"))


@query("fan_out_rrf", """WITH a AS (SELECT doc_id, 0 AS scope, ROW_NUMBER() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 10),
b AS (SELECT doc_id, 1 AS scope, ROW_NUMBER() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE source = 'src0' QUALIFY rank <= 10),
c AS (SELECT doc_id, 2 AS scope, ROW_NUMBER() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang = 'en' QUALIFY rank <= 10)
SELECT doc_id, round(SUM(1 / (60 + rank)), 9) AS score, MIN(scope)::BIGINT AS first_scope FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY doc_id""")
def fan_out_rrf(spark, d):
    docs = table(spark, d, "documents")
    return s.fan_out([docs, docs.where("source = 'src0'"), docs.where("lang = 'en'")], "doc_id", "n_chars").withColumn("score", F.round("score", 9))


@query("strategic_reorder", f"""WITH {BM25}, t10 AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm QUALIFY r <= 10), c AS (SELECT COUNT(*) AS n FROM t10)
SELECT doc_id, CASE WHEN n < 3 THEN r WHEN r = 1 THEN 0 WHEN r = 2 THEN n + 1 ELSE r END AS place FROM t10, c""")
def strategic_reorder(spark, d):
    scored = s.bm25(table(spark, d, "documents"), "doc_id", "text", TERMS).withColumn("score", F.round("score", 9))
    top = s.ranked(scored, "score", "doc_id", "r", 10).withColumn("r", F.col("r") + 1)
    return top.withColumn("n", top.agg(F.count("*")).scalar()).select("doc_id", s.strategic_order(F.col("r"), F.col("n")).alias("place"))


@query("postings_stats", f"WITH p AS (SELECT doc_id, unnest({TOK}) AS term FROM documents) SELECT term, COUNT(DISTINCT doc_id) AS df, COUNT(*) AS cf FROM p GROUP BY 1 HAVING COUNT(DISTINCT doc_id) >= 20")
def postings_stats(spark, d):
    p = s.postings(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf")).where("df >= 20")


@query("transcript_search", f"WITH {TRANSCRIPT} SELECT chunk_id FROM transcript WHERE sender = 'assistant' AND contains(lower(content), 'ation')")
def transcript_search(spark, d):
    return transcript(spark, d).where(F.contains(F.lower("content"), F.lit("ation")) & (F.col("sender") == "assistant")).select("chunk_id")


@query("retrieval_strengthening", """WITH r AS (SELECT user_id, COUNT(*) AS n, MAX(epoch_us(ts)) AS last_us FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, n AS retrievals, least(30 + 3 * n, 365)::BIGINT AS half_life, last_us FROM r""")
def retrieval_strengthening(spark, d):
    log = table(spark, d, "events").where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("retrievals"), F.max(micros("ts")).alias("last_us"))
    return log.withColumn("half_life", F.least(30 + 3 * F.col("retrievals"), F.lit(365)).cast("long"))
