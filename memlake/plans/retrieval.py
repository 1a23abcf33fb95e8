"""Filtered hybrid search, rows for prompts, sessions of hits, order by origin, routing of ids, hidden and recent."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import scores
from memlake.functions import text as x
from memlake.operators import search as s
from memlake.operators import vectors as v
from memlake.plans.search import BM25, SEM, TERMS
from memlake.registry import query
from memlake.sources.tables import TRANSCRIPT, chunks, micros, table, transcript


@query("hybrid_search_filtered", f"""WITH {BM25}, {SEM}, k AS (SELECT * FROM documents WHERE COALESCE(source, '') <> 'src0' AND lang = 'en'),
f AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS r_fts FROM bm SEMI JOIN k USING (doc_id) QUALIFY r_fts < 207),
m AS (SELECT doc_id, ROW_NUMBER() OVER (ORDER BY round(likeness, 9) DESC, doc_id) - 1 AS r_sem FROM sem SEMI JOIN k USING (doc_id) QUALIFY r_sem < 207),
u AS (SELECT doc_id, r_fts, r_sem, COALESCE(0.25 / (60 + r_sem), 0) + COALESCE(0.75 / (60 + r_fts), 0) AS score FROM f FULL JOIN m USING (doc_id))
SELECT doc_id, round(score * (1 + least(greatest(n_chars / 1000, 0), 10) / 20 * 0.5) * (0.7 + 0.3 * exp(-0.023 * (n_chars / 100))), 9) AS score, r_fts, r_sem FROM u JOIN k USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20""")
def hybrid_search_filtered(spark, d):
    docs, e = table(spark, d, "documents"), table(spark, d, "embeddings")
    text = s.bm25(docs, "doc_id", "text", TERMS).withColumn("score", F.round("score", 9))
    one = e.where("vec_id = 0").select("embedding").scalar()
    near = e.withColumn("q", one).select(F.col("vec_id").alias("doc_id"), F.round(v.cosine("embedding", "q"), 9).alias("score"))
    boosts = {"importance": scores.importance_boost(F.col("n_chars") / 1000), "recency": scores.recency_boost(F.col("n_chars") / 100)}
    rows = docs.select("doc_id", "source", "lang", "n_chars")
    return s.hybrid_search(rows, "doc_id", text, near, F.coalesce("source", F.lit("")) != "src0", F.col("lang") == "en", boosts, {"importance": 0.5}, top=20, hidden=7)


@query("prompt_rows", """WITH h AS (SELECT user_id, event_id, round(value / 20000, 9) AS score, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY round(value / 20000, 9) DESC, event_id) AS r FROM events WHERE event_type <> 'error'),
c AS (SELECT user_id, MAX(score) AS top, COUNT(*) FILTER (score > 0.015 AND r <= 3) AS sure, COUNT(*) FILTER (score >= 0.010 AND r <= 3) AS likely, COUNT(*) FILTER (r <= 3) AS every FROM h GROUP BY 1),
n AS (SELECT user_id, least(every, CASE WHEN top < 0.005 THEN 0 WHEN top > 0.015 THEN greatest(sure, 2) WHEN top >= 0.010 THEN likely ELSE 1 END) AS n FROM c)
SELECT user_id, event_id, score, CASE WHEN n < 3 THEN r WHEN r = 1 THEN 0 WHEN r = 2 THEN n + 1 ELSE r END AS place FROM h JOIN n USING (user_id) WHERE r <= n""")
def prompt_rows(spark, d):
    hits = table(spark, d, "events").withColumn("score", F.round(F.col("value") / 20000, 9))
    return s.for_prompt(hits, "user_id", "event_id", "score", F.col("event_type") == "error")


@query("hits_with_session", """WITH s AS (SELECT 'c' || conv_id AS session_id, COUNT(*) AS turns FROM conversations WHERE conv_id % 3 = 0 GROUP BY 1)
SELECT conv_id, turn, 'c' || conv_id AS session_id, turns FROM conversations c LEFT JOIN s ON s.session_id = 'c' || conv_id""")
def hits_with_session(spark, d):
    c = table(spark, d, "conversations")
    number = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    sessions = c.where("conv_id % 3 = 0").groupBy(number.alias("session_id")).agg(F.count("*").alias("turns"))
    hits = c.select("conv_id", "turn", F.concat(F.lit("/logs.d/2024/"), number, F.lit(".jsonl")).alias("source_file"))
    return s.with_session(hits, sessions, "source_file").select("conv_id", "turn", "session_id", "turns")


@query("origin_order", """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_us(ts) END AS us, CASE event_id % 3 WHEN 1 THEN 'soon ' || event_type END AS word FROM events)
SELECT event_id, ROW_NUMBER() OVER (ORDER BY CASE WHEN us IS NOT NULL THEN 0 WHEN word IS NOT NULL THEN 1 ELSE 2 END, us, word, event_id) AS place FROM e ORDER BY place LIMIT 100""")
def origin_order(spark, d):
    from pyspark.sql import Window

    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, iso).when(F.col("event_id") % 3 == 1, F.concat(F.lit("soon "), "event_type")).alias("created"))
    few = e.orderBy(*s.by_origin("created", "event_id")).limit(100)
    return few.select("event_id", F.row_number().over(Window.orderBy(*s.by_origin("created", "event_id"))).cast("long").alias("place"))


@query("exact_id_route", f"""WITH {TRANSCRIPT}, q AS (SELECT DISTINCT ' ' || conv_id || '-' || (turn + 1) || ' ' AS query FROM conversations UNION SELECT DISTINCT lang FROM documents)
SELECT query, chunk_id FROM q JOIN transcript ON trim(query) = chunk_id WHERE regexp_full_match(trim(query), '[0-9]+-[0-9]+')""")
def exact_id_route(spark, d):
    c = table(spark, d, "conversations")
    asked = c.select(F.concat(F.lit(" "), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") + 1).cast("string"), F.lit(" ")).alias("query"))
    return s.exact_ids(transcript(spark, d), "chunk_id", asked.union(table(spark, d, "documents").select("lang")).distinct(), "^[0-9]+-[0-9]+$")


@query("recency_intent", r"SELECT conv_id, turn, regexp_matches(lower(text || CASE WHEN turn % 4 = 0 THEN ' The latest?' WHEN turn % 4 = 1 THEN ' this  Week' WHEN turn % 4 = 2 THEN ' currently' ELSE '' END), '\b(current|latest|recent|today)\b|\bthis\s+week\b') AS recent FROM conversations")
def recency_intent(spark, d):
    n = F.col("turn") % 4
    asked = F.concat("text", F.when(n == 0, " The latest?").when(n == 1, " this  Week").when(n == 2, " currently").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", x.asks_for_recent(asked).alias("recent"))


@query("noise_chunks", """SELECT event_type, COUNT(*) AS n, COUNT(*) FILTER (k % 10 = 3 OR event_type = 'error') AS hidden, COUNT(*) FILTER (k % 10 = 3) AS quarantined
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def noise_chunks(spark, d):
    c = chunks(spark, d)
    tags = F.array("tag", F.when(F.col("content_type") == "error", "Pre-Compact").otherwise(F.lit(None)))
    meta = F.create_map(F.lit("is_quarantine"), F.when(F.col("k") % 10 == 3, "Yes").otherwise("no"))
    rows = c.select("content_type", *(x.noise(tags, meta, F.lit("a text"), snapshots).alias(n) for n, snapshots in (("a", False), ("b", True))))
    return rows.groupBy(F.col("content_type").alias("event_type")).agg(F.count("*").alias("n"), F.count_if("a").alias("hidden"), F.count_if("b").alias("quarantined"))


@query("provenance_class", r"""WITH t AS (SELECT *, LAG(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(COALESCE(text, '')), '[\pL\pN]+')) AS every FROM t),
a AS (SELECT *, ['yeah', 'yep', 'yes', 'okay', 'sure', 'exactly', 'that', 'this', 'right', 'true', 'agree', 'agreed', 'correct', 'good', 'great', 'nice', 'perfect', 'love', 'like', 'fine', 'cool', 'totally', 'absolutely', 'indeed', 'yup'] AS assent FROM w),
e AS (SELECT *, list_filter(every, lambda x: NOT list_contains(assent, x)) AS telling, list_distinct(regexp_extract_all(lower(COALESCE(before, '')), '[\pL\pN]+')) AS heard FROM a),
f AS (SELECT *, COALESCE(before, '') <> '' AND length(trim(text)) <= 80 AND NOT regexp_matches(lower(text), '\b(no|nope|nah|wrong|actually|correction|instead|not)\b')
  AND ((len(every) > 0 AND len(telling) = 0) OR (len(telling) > 0 AND len(list_filter(telling, lambda x: list_contains(heard, x))) >= greatest(1, len(telling) // 2))) AS agrees FROM e)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN agrees THEN 'endorsement' ELSE 'direct' END WHEN role = 'assistant' AND (contains(text, '"') OR contains(lower(text), 'you said') OR contains(text, '> ') OR contains(lower(text), 'quote') OR contains(lower(text), 'storing that')) THEN 'paraphrase' ELSE 'inference' END AS class
FROM f""")
def provenance_class(spark, d):
    from pyspark.sql import Window

    before = F.lag(F.when(F.col("role") == "assistant", F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    t = table(spark, d, "conversations").withColumn("before", before)
    return t.select("conv_id", "turn", x.provenance(F.lit(None).cast("string"), F.col("role"), F.col("text"), F.col("before")).alias("class"))


@query("tag_normal_forms", r"""WITH t AS (SELECT part.p_partkey, ' ' || p_type || '_' || p_brand || '- ' AS raw FROM part)
SELECT p_partkey, rtrim(regexp_replace(regexp_replace(lower(trim(raw)), '[_\s]', '-', 'g'), '-{2,}', '-', 'g'), '-') AS tag FROM t""")
def tag_normal_forms(spark, d):
    return table(spark, d, "part").select("p_partkey", x.tag(F.concat(F.lit(" "), "p_type", F.lit("_"), "p_brand", F.lit("- "))).alias("tag"))


@query("related_memories", """WITH p AS (SELECT q.vec_id AS asked, e.vec_id, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS distance FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id)
SELECT asked, vec_id, distance FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY asked ORDER BY distance, vec_id) <= 3""")
def related_memories(spark, d):
    e = table(spark, d, "embeddings")
    return v.search(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 3, "cosine", itself=False).select("asked", "vec_id", F.round(1 + F.col("distance"), 9).alias("distance"))
