"""Decay, periods, histograms, timelines, history, duplicates, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import scores, text
from memlake.operators import dedup, evaluation
from memlake.operators import joins as j
from memlake.operators import temporal as t
from memlake.registry import query
from memlake.sources.tables import CHUNKS, chunks, micros, table


def q(name, select):
    return query(name, f"WITH {CHUNKS} {select}")


NOW = 1_735_689_600_000_000  # 2025-01-01
DAYS = f"(({NOW} - epoch_us(created_at)) / 86400000000.0)"
HALF = "CASE WHEN importance IS NULL THEN 30.0 WHEN least(greatest(importance, 1), 10) <= 5 THEN round(7 + (least(greatest(importance, 1), 10) - 1) * 5.75, 2) ELSE round(30 + (least(greatest(importance, 1), 10) - 5) * 12, 2) END"


def _days():
    return (F.lit(NOW) - micros("created_at")) / 86_400_000_000


@q("decay_score", f"""SELECT chunk_id, round(CASE WHEN k < 3 THEN 1.0 ELSE greatest(0.05, 1 / (1 + {DAYS} / (9 * 30 * (1 + 0.3 * ln(1 + k))))) END, 6) AS score FROM chunks""")
def decay_score(spark, d):
    score = scores.decay(_days(), F.lit(30), F.col("k"), F.col("k") < 3)
    return chunks(spark, d).select("chunk_id", F.round(score, 6).alias("score"))


@q("decay_archive_flags", f"""SELECT content_type, COUNT(*) FILTER (1 / (1 + {DAYS} / (9 * 2.0)) < 0.1 AND k >= 3) AS archived, COUNT(*) AS n FROM chunks GROUP BY 1""")
def decay_archive_flags(spark, d):
    score = scores.decay(_days(), F.lit(2.0), F.lit(0), F.col("k") < 3)
    return chunks(spark, d).groupBy("content_type").agg(F.count_if(score < 0.1).alias("archived"), F.count("*").alias("n"))


@q("half_life_piecewise", f"SELECT chunk_id, round({HALF}, 1) AS half_life FROM chunks")
def half_life_piecewise(spark, d):
    return chunks(spark, d).select("chunk_id", F.round(scores.half_life(F.col("importance")), 1).alias("half_life"))


@query("period_batches", """SELECT year(o_orderdate)::VARCHAR || CASE WHEN month(o_orderdate) <= 6 THEN '-H1' ELSE '-H2' END AS half, year(o_orderdate)::VARCHAR || '-Q' || quarter(o_orderdate) AS quarter,
strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n, CASE WHEN 2000 - year(o_orderdate) < 1 THEN 1.0 WHEN 2000 - year(o_orderdate) < 2 THEN 0.8 WHEN 2000 - year(o_orderdate) < 3 THEN 0.6 ELSE 0.4 END::DOUBLE AS weight
FROM orders GROUP BY ALL""")
def period_batches(spark, d):
    o = table(spark, d, "orders")
    keys = [t.period("o_orderdate", k).alias(k) for k in ("half", "quarter", "month")]
    return o.groupBy(*keys, t.period_weight(2000 - F.year("o_orderdate")).alias("weight")).agg(F.count("*").alias("n"))


@q("activity_buckets", """, s AS (SELECT 1704067200000000 AS start), b AS (SELECT least((epoch_us(created_at) - start) // 86400000000, 29) AS bucket, COUNT(*) AS n FROM chunks, s GROUP BY 1)
SELECT r.range AS bucket, COALESCE(n, 0) AS n FROM range(30) r LEFT JOIN b ON b.bucket = r.range""")
def activity_buckets(spark, d):
    return t.histogram(chunks(spark, d).withColumn("us", micros("created_at")), "us", 1_704_067_200_000_000, 86_400_000_000, 30)


@q("first_ingest_buckets", ", f AS (SELECT k, MIN(created_at) AS first_seen FROM chunks GROUP BY k) SELECT strftime(first_seen, '%Y-%m-%d') AS day, COUNT(*) AS n FROM f GROUP BY 1")
def first_ingest_buckets(spark, d):
    first = chunks(spark, d).groupBy("k").agg(F.min("created_at").alias("first_seen"))
    return first.groupBy(F.date_format("first_seen", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@q("file_session_map", """SELECT k, session_id, epoch_us(MIN(created_at)) AS first_us, epoch_us(MAX(created_at)) AS last_us, string_agg(DISTINCT content_type, ',' ORDER BY content_type) AS actions FROM chunks GROUP BY 1, 2""")
def file_session_map(spark, d):
    c = chunks(spark, d).withColumn("us", micros("created_at"))
    return c.groupBy("k", "session_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.array_join(F.array_sort(F.collect_set("content_type")), ",").alias("actions"))


@q("topic_chains_lead", """, m AS (SELECT k, session_id, MIN(epoch_us(created_at)) AS a, MAX(epoch_us(created_at)) AS z, list(DISTINCT content_type) AS acts FROM chunks GROUP BY 1, 2),
n AS (SELECT *, LEAD(session_id) OVER w AS next_session, LEAD(a) OVER w AS next_a, LEAD(acts) OVER w AS next_acts FROM m WINDOW w AS (PARTITION BY k ORDER BY a, session_id))
SELECT k, session_id, next_session, round((next_a - z) / 3600000000.0, 2) AS hours, len(list_intersect(acts, next_acts))::BIGINT AS shared FROM n WHERE next_session IS NOT NULL""")
def topic_chains_lead(spark, d):
    c = chunks(spark, d).withColumn("us", micros("created_at"))
    m = c.groupBy("k", "session_id").agg(F.min("us").alias("a"), F.max("us").alias("z"), F.collect_set("content_type").alias("acts"))
    n = t.with_next(m, "k", ["a", "session_id"], ["session_id", "a", "acts"]).where("next_session_id is not null")
    return n.select(
        "k", "session_id", F.col("next_session_id").alias("next_session"), F.round((F.col("next_a") - F.col("z")) / 3_600_000_000, 2).alias("hours"), F.size(F.array_intersect("acts", "next_acts")).cast("long").alias("shared")
    )


@q("file_timeline", """SELECT c.k, c.chunk_id, s.n AS session_size FROM chunks c LEFT JOIN (SELECT session_id, COUNT(*) AS n FROM chunks WHERE content_type = 'purchase' GROUP BY 1 HAVING COUNT(*) > 10) s USING (session_id) WHERE c.tag = 'k7'""")
def file_timeline(spark, d):
    c = chunks(spark, d)
    s = c.where("content_type = 'purchase'").groupBy("session_id").agg(F.count("*").alias("session_size")).where("session_size > 10")
    return c.where("tag = 'k7'").join(s, "session_id", "left").select("k", "chunk_id", "session_size")


@q("sessions_recent", "SELECT session_id, epoch_us(MAX(created_at)) AS last_us, COUNT(*) AS n FROM chunks GROUP BY 1 ORDER BY last_us DESC, session_id LIMIT 20")
def sessions_recent(spark, d):
    c = chunks(spark, d).groupBy("session_id").agg(F.max(micros("created_at")).alias("last_us"), F.count("*").alias("n"))
    return c.orderBy(F.desc("last_us"), "session_id").limit(20)


@q("bitemporal_as_of", """, h AS (SELECT *, LEAD(created_at) OVER (PARTITION BY session_id, content_type ORDER BY created_at, chunk_id) AS ended FROM chunks)
SELECT session_id, content_type, chunk_id FROM h WHERE created_at <= TIMESTAMP '2024-01-15' AND (ended IS NULL OR TIMESTAMP '2024-01-15' < ended)""")
def bitemporal_as_of(spark, d):
    c = chunks(spark, d).withColumn("key", F.concat_ws("/", F.col("session_id").cast("string"), "content_type"))
    return t.as_of(t.versions(c, "key", "created_at", "chunk_id"), F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'")).select("session_id", "content_type", "chunk_id")


@q("git_interval_join", """, s AS (SELECT session_id, MIN(created_at) AS a, MAX(created_at) AS z FROM chunks WHERE content_type = 'signup' GROUP BY 1)
SELECT s.session_id, COUNT(*) AS inside FROM s JOIN chunks c ON c.session_id = s.session_id AND c.content_type = 'purchase' AND c.created_at BETWEEN a AND z GROUP BY 1""")
def git_interval_join(spark, d):
    c = chunks(spark, d)
    spans = c.where("content_type = 'signup'").groupBy("session_id").agg(F.min("created_at").alias("a"), F.max("created_at").alias("z"))
    points = c.where("content_type = 'purchase'").select("session_id", "created_at")
    return j.in_interval(points, spans, ["session_id"], "created_at", "a", "z").groupBy("session_id").agg(F.count("*").alias("inside"))


@q("unread_after_ack", """, ack AS (SELECT session_id, MAX(chunk_id) AS floor FROM chunks WHERE content_type = 'click' GROUP BY 1)
SELECT c.session_id, COUNT(*) AS unread FROM chunks c LEFT JOIN ack USING (session_id) WHERE c.chunk_id > COALESCE(floor, -1) GROUP BY 1""")
def unread_after_ack(spark, d):
    c = chunks(spark, d)
    ack = c.where("content_type = 'click'").groupBy("session_id").agg(F.max("chunk_id").alias("floor"))
    return c.join(ack, "session_id", "left").where(F.col("chunk_id") > F.coalesce("floor", F.lit(-1))).groupBy("session_id").agg(F.count("*").alias("unread"))


STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
HASH = f"sha256(array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN ({STOP})), ' '))"


@query("exact_dup_groups", f"SELECT {HASH} AS hash, MIN(doc_id) AS canonical, COUNT(*) AS seen FROM documents GROUP BY 1 HAVING COUNT(*) > 1")
def exact_dup_groups(spark, d):
    return dedup.exact_groups(table(spark, d, "documents"), "doc_id", text.content_hash(F.col("text")))


@query("survivor_pick", f"""WITH h AS (SELECT doc_id, {HASH} AS hash, n_chars FROM documents) SELECT doc_id, ROW_NUMBER() OVER (PARTITION BY hash ORDER BY n_chars DESC, doc_id) = 1 AS survivor FROM h""")
def survivor_pick(spark, d):
    h = table(spark, d, "documents").select("doc_id", "n_chars", text.content_hash(F.col("text")).alias("hash"))
    return dedup.survivors(h, "hash", [F.desc("n_chars"), "doc_id"]).select("doc_id", "survivor")


@q("merge_duplicates", """SELECT session_id, MIN(chunk_id) AS canonical, round(MAX(importance), 6) AS importance, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, COUNT(*) AS seen_count FROM chunks GROUP BY 1""")
def merge_duplicates(spark, d):
    m = dedup.merged(chunks(spark, d), "session_id", "chunk_id")
    return m.select("session_id", "canonical", F.round("importance", 6).alias("importance"), F.array_join("tags", ",").alias("tags"), "seen_count")


@query("simhash_near_dups")
def simhash_near_dups(spark, d):
    return dedup.near_classes(table(spark, d, "documents").where("doc_id is not null"), "doc_id", "text", ["lang"])


@q("claim_authority", """SELECT session_id, k, chunk_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, k ORDER BY CASE content_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END DESC, created_at DESC, chunk_id) AS rn FROM chunks) WHERE rn = 1""")
def claim_authority(spark, d):
    from memlake.operators.aggregates import first_of

    rank = F.when(F.col("content_type") == "purchase", 3).when(F.col("content_type") == "signup", 2).otherwise(1)
    return first_of(chunks(spark, d), ["session_id", "k"], [rank.desc(), F.desc("created_at"), "chunk_id"]).select("session_id", "k", "chunk_id")


EVAL = """WITH run AS (SELECT source AS query, doc_id AS doc, n_chars AS score FROM documents), qrels AS (SELECT source AS query, l.doc_id AS doc, quality * 2 + (1 - toxic) * quality AS grade FROM labels l JOIN documents d USING (doc_id)),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM run QUALIFY rank <= 10),
hits AS (SELECT query, doc, rank, grade, COUNT(*) OVER (PARTITION BY query ORDER BY rank) AS found FROM ranked JOIN qrels USING (query, doc) WHERE grade > 0),
got AS (SELECT query, SUM(grade / log2(rank + 1)) AS dcg, COUNT(*) AS n, SUM(found / rank) AS psum, MIN(rank) AS first FROM hits GROUP BY 1),
best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY grade DESC, doc) AS rank FROM qrels),
ideal AS (SELECT query, SUM(CASE WHEN rank <= 10 THEN grade / log2(rank + 1) ELSE 0 END) AS idcg, COUNT(*) FILTER (grade > 0) AS relevant FROM best GROUP BY 1)
SELECT query, round(COALESCE(dcg / idcg, 0), 6) AS ndcg, round(COALESCE(n / relevant, 0), 6) AS recall, round(COALESCE(n / 10, 0), 6) AS precision, round(COALESCE(psum / relevant, 0), 6) AS ap, round(COALESCE(1 / first, 0), 6) AS rr
FROM ideal LEFT JOIN got USING (query)"""


def _judged(spark, d):
    docs = table(spark, d, "documents")
    run = docs.select(F.col("source").alias("query"), F.col("doc_id").alias("doc"), F.col("n_chars").alias("score"))
    grade = F.col("quality") * 2 + (1 - F.col("toxic")) * F.col("quality")
    qrels = table(spark, d, "labels").join(docs.select("doc_id", "source"), "doc_id").select(F.col("source").alias("query"), F.col("doc_id").alias("doc"), grade.alias("grade"))
    return evaluation.metrics(run, qrels, 10)


@query("eval_metrics", EVAL)
def eval_metrics(spark, d):
    return _judged(spark, d).select("query", *(F.round(c, 6).alias(c) for c in ("ndcg", "recall", "precision", "ap", "rr")))


MEANS = """SELECT COUNT(*) AS queries, round(AVG(COALESCE(dcg / idcg, 0)), 6) AS ndcg, round(AVG(COALESCE(psum / relevant, 0)), 6) AS map, round(AVG(COALESCE(1 / first, 0)), 6) AS mrr
FROM ideal LEFT JOIN got USING (query)"""


@query("eval_means", EVAL[: EVAL.index("SELECT query, round")] + MEANS)
def eval_means(spark, d):
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return _judged(spark, d).agg(F.count("*").alias("queries"), mean("ndcg", "ndcg"), mean("ap", "map"), mean("rr", "mrr"))
