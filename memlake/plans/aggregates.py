"""Aggregates, joins, windows and set operations over chunks, tags and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memlake.functions.scores import rounded
from memlake.operators import aggregates as a
from memlake.operators import joins as j
from memlake.registry import query
from memlake.sources.tables import CHUNKS, GRAPH, TRANSCRIPT, chunks, entities, mentions, micros, relations, table, transcript


def q(name, select):
    return query(name, f"WITH {CHUNKS} {select}")


@q("intent_distribution", "SELECT content_type, COUNT(*) AS n FROM chunks GROUP BY 1")
def intent_distribution(spark, d):
    return a.top_counts(chunks(spark, d), "content_type")


@q("distinct_files", "SELECT content_type, COUNT(DISTINCT k) AS files, COUNT(DISTINCT session_id) AS sessions FROM chunks GROUP BY 1")
def distinct_files(spark, d):
    return chunks(spark, d).groupBy("content_type").agg(F.countDistinct("k").alias("files"), F.countDistinct("session_id").alias("sessions"))


@q("tags_top", "SELECT tag, COUNT(*) AS n FROM chunks GROUP BY tag ORDER BY n DESC, tag LIMIT 10")
def tags_top(spark, d):
    return a.top_counts(chunks(spark, d), "tag", limit=10)


@q("tags_by_project", "SELECT project, tag, COUNT(*) AS n FROM chunks WHERE project IS NOT NULL GROUP BY 1, 2")
def tags_by_project(spark, d):
    return a.top_counts(chunks(spark, d).where("project is not null"), "project", "tag")


@q("tags_prefix", "SELECT tag, COUNT(*) AS n FROM chunks WHERE lower(tag) LIKE 'k1%' GROUP BY tag")
def tags_prefix(spark, d):
    return a.top_counts(chunks(spark, d).where(F.lower("tag").startswith("k1")), "tag")


@q("tag_suggest", """SELECT tag, MAX(n) AS n FROM (SELECT tag, COUNT(*) AS n FROM chunks GROUP BY tag) t
JOIN (SELECT unnest(['1', '27', 'k9']) AS word) w ON contains(lower(tag), word) GROUP BY tag""")
def tag_suggest(spark, d):
    counts = chunks(spark, d).groupBy("tag").agg(F.count("*").alias("n"))
    words = F.array(*map(F.lit, ("1", "27", "k9")))
    return counts.where(F.exists(words, lambda w: F.contains(F.lower("tag"), w))).select("tag", "n")


@q("tag_promotion_having", "SELECT tag, COUNT(*) AS n, COUNT(DISTINCT session_id) AS sessions FROM chunks GROUP BY tag HAVING COUNT(*) >= 90 AND COUNT(DISTINCT session_id) >= 50")
def tag_promotion_having(spark, d):
    return chunks(spark, d).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions")).where("n >= 90 and sessions >= 50")


@q("tag_singletons", """, st AS (SELECT session_id, tag, COUNT(*) AS m FROM chunks GROUP BY 1, 2),
ones AS (SELECT session_id || tag AS pair FROM st WHERE m = 1) SELECT tag, COUNT(*) AS n FROM chunks WHERE session_id || tag NOT IN (SELECT pair FROM ones) GROUP BY tag""")
def tag_singletons(spark, d):
    pairs = chunks(spark, d).select("tag", F.concat(F.col("session_id").cast("string"), "tag").alias("pair"))
    return a.without(pairs, a.singletons(pairs, "pair"), "pair").groupBy("tag").agg(F.count("*").alias("n"))


@q("group_concat_sessions", "SELECT tag, string_agg(DISTINCT session_id::VARCHAR, ',' ORDER BY session_id::VARCHAR) AS sessions FROM chunks WHERE content_type = 'error' GROUP BY tag")
def group_concat_sessions(spark, d):
    return chunks(spark, d).where("content_type = 'error'").groupBy("tag").agg(a.joined_distinct("session_id").alias("sessions"))


@q("session_importance", "SELECT session_id, round(AVG(importance), 6) AS mean_importance, MAX(k) AS top_k, COUNT(*) AS n FROM chunks GROUP BY 1")
def session_importance(spark, d):
    return chunks(spark, d).groupBy("session_id").agg(F.round(F.avg("importance"), 6).alias("mean_importance"), F.max("k").alias("top_k"), F.count("*").alias("n"))


@q("status_counts", """SELECT COUNT(*) FILTER (content_type = 'purchase') AS success, COUNT(*) FILTER (content_type = 'error') AS failed,
COUNT(*) FILTER (superseded_by IS NOT NULL) AS skipped, COUNT(*) FILTER (importance IS NULL) AS pending FROM chunks""")
def status_counts(spark, d):
    count = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    return chunks(spark, d).agg(
        count("content_type = 'purchase'", "success"), count("content_type = 'error'", "failed"), count("superseded_by is not null", "skipped"), count("importance is null", "pending")
    )


@q("importance_histogram", """SELECT CASE WHEN importance IS NULL THEN 'NULL' WHEN importance < 3 THEN '1-2' WHEN importance < 5 THEN '3-4' WHEN importance < 7 THEN '5-6'
WHEN importance < 9 THEN '7-8' ELSE '9-10' END AS bucket, COUNT(*) AS n FROM chunks GROUP BY 1""")
def importance_histogram(spark, d):
    return chunks(spark, d).groupBy(a.importance_bucket("importance").alias("bucket")).agg(F.count("*").alias("n"))


@q("percentile_latency", "SELECT content_type, round(quantile_cont(importance, 0.5), 6) AS p50, round(quantile_cont(importance, 0.95), 6) AS p95 FROM chunks GROUP BY 1")
def percentile_latency(spark, d):
    at = lambda p, name: F.round(F.percentile("importance", F.lit(p)), 6).alias(name)
    return chunks(spark, d).groupBy("content_type").agg(at(0.5, "p50"), at(0.95, "p95"))


@q("project_activity", "SELECT project, CAST(MAX(created_at) AS VARCHAR) AS last_seen FROM chunks WHERE project IS NOT NULL GROUP BY 1 ORDER BY MAX(created_at) DESC, project LIMIT 5")
def project_activity(spark, d):
    last = chunks(spark, d).where("project is not null").groupBy("project").agg(F.max("created_at").alias("t"))
    return last.orderBy(F.desc("t"), "project").limit(5).select("project", F.col("t").cast("string").alias("last_seen"))


@q("coverage", "SELECT c.content_class, COUNT(DISTINCT s.chunk_id) AS covered FROM chunks c JOIN chunks s ON s.session_id = c.session_id AND s.k = c.k AND s.content_type = 'click' GROUP BY 1")
def coverage(spark, d):
    c = chunks(spark, d)
    signal = c.where("content_type = 'click'").select("session_id", "k", F.col("chunk_id").alias("signal"))
    return c.join(signal, ["session_id", "k"]).groupBy("content_class").agg(F.countDistinct("signal").alias("covered"))


@q("exact_twin_flag", """, g AS (SELECT session_id, k, COUNT(DISTINCT chunk_id) AS n, COUNT(DISTINCT CASE WHEN importance IS NOT NULL THEN chunk_id END) AS m FROM chunks GROUP BY 1, 2)
SELECT c.chunk_id, g.m - CASE WHEN c.importance IS NOT NULL THEN 1 ELSE 0 END > 0 AS has_enriched_twin FROM chunks c JOIN g USING (session_id, k)""")
def exact_twin_flag(spark, d):
    c = chunks(spark, d)
    rich = c.groupBy("session_id", "k").agg(F.countDistinct(F.when(F.col("importance").isNotNull(), F.col("chunk_id"))).alias("m"))
    own = F.when(F.col("importance").isNotNull(), 1).otherwise(0)
    return c.join(rich, ["session_id", "k"]).select("chunk_id", (F.col("m") - own > 0).alias("has_enriched_twin"))


@q("dedup_row_number_hash", """SELECT chunk_id, session_id, k FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, k ORDER BY chunk_id DESC) AS rn FROM chunks) WHERE rn = 1""")
def dedup_row_number_hash(spark, d):
    return a.first_of(chunks(spark, d), ["session_id", "k"], [F.desc("chunk_id")]).select("chunk_id", "session_id", "k")


@q("top_tags_per_session", """, g AS (SELECT session_id, tag, COUNT(*) AS n FROM chunks GROUP BY 1, 2)
SELECT session_id, tag, n, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY n DESC, tag) AS rank FROM g) WHERE rank <= 5""")
def top_tags_per_session(spark, d):
    counts = chunks(spark, d).groupBy("session_id", "tag").agg(F.count("*").alias("n"))
    return a.best_of(counts, ["session_id"], [F.desc("n"), "tag"], 5, "rank")


@q("rank_correlation", """, r AS (SELECT content_type, RANK() OVER (PARTITION BY content_type ORDER BY importance) + (COUNT(*) OVER (PARTITION BY content_type, importance) - 1) / 2.0 AS x,
RANK() OVER (PARTITION BY content_type ORDER BY k) + (COUNT(*) OVER (PARTITION BY content_type, k) - 1) / 2.0 AS y FROM chunks WHERE importance IS NOT NULL)
SELECT content_type, round(corr(x, y), 6) AS spearman FROM r GROUP BY 1""")
def rank_correlation(spark, d):
    c = chunks(spark, d).where("importance is not null")
    ranks = c.select("content_type", a.mean_rank("importance", "content_type").alias("x"), a.mean_rank("k", "content_type").alias("y"))
    return ranks.groupBy("content_type").agg(F.round(F.corr("x", "y"), 6).alias("spearman"))


@q("file_regression", """, s AS (SELECT k, MAX(CASE WHEN content_type = 'purchase' THEN created_at END) AS last_ok FROM chunks GROUP BY k)
SELECT c.k, COUNT(*) AS changes_after FROM chunks c JOIN s USING (k) WHERE c.created_at > s.last_ok GROUP BY c.k""")
def file_regression(spark, d):
    c = chunks(spark, d)
    ok = c.groupBy("k").agg(F.max(F.when(F.col("content_type") == "purchase", F.col("created_at"))).alias("last_ok"))
    return c.join(ok, "k").where("created_at > last_ok").groupBy("k").agg(F.count("*").alias("changes_after"))


@q("cochange_pairs", "SELECT a.k AS a, b.k AS b, COUNT(*) AS n FROM (SELECT DISTINCT session_id, k FROM chunks) a JOIN (SELECT DISTINCT session_id, k FROM chunks) b ON a.session_id = b.session_id AND a.k < b.k GROUP BY 1, 2")
def cochange_pairs(spark, d):
    return j.pairs_within(chunks(spark, d), "session_id", "k")


@q("duplicate_groups", "SELECT session_id, k, content_type, COUNT(*) AS n FROM chunks GROUP BY 1, 2, 3 HAVING COUNT(*) > 1")
def duplicate_groups(spark, d):
    return j.repeated(chunks(spark, d), "session_id", "k", "content_type")


@q("coverage_census", """, base AS (SELECT chunk_id, content_class FROM chunks WHERE archived_at IS NULL), idx AS (SELECT chunk_id, content_class FROM chunks WHERE superseded_by IS NULL)
SELECT 'missing' AS state, COUNT(*) AS n FROM base WHERE chunk_id NOT IN (SELECT chunk_id FROM idx)
UNION ALL SELECT 'orphan', COUNT(*) FROM idx WHERE chunk_id NOT IN (SELECT chunk_id FROM base)
UNION ALL SELECT 'misrouted', COUNT(*) FROM base JOIN idx USING (chunk_id) WHERE base.content_class = 'operational' AND idx.content_class = 'operational'""")
def coverage_census(spark, d):
    c = chunks(spark, d)
    base, index = c.where("archived_at is null"), c.where("superseded_by is null")
    count = lambda df, state: df.agg(F.lit(state).alias("state"), F.count("*").alias("n"))
    misrouted = base.where("content_class = 'operational'").join(index.where("content_class = 'operational'").select("chunk_id"), "chunk_id")
    return count(j.missing_from(base, index, "chunk_id"), "missing").union(count(j.missing_from(index, base, "chunk_id"), "orphan")).union(count(misrouted, "misrouted"))


@query("missing_embeddings_except", "SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings")
def missing_embeddings_except(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")))


@q("alias_surfaces_union", "SELECT tag AS surface FROM chunks WHERE tag IS NOT NULL UNION SELECT project FROM chunks WHERE project IS NOT NULL")
def alias_surfaces_union(spark, d):
    c = chunks(spark, d)
    return c.where("tag is not null").select(F.col("tag").alias("surface")).union(c.where("project is not null").select("project")).distinct()


@q("session_jaccard", """, s AS (SELECT DISTINCT session_id, k FROM chunks WHERE k IS NOT NULL AND session_id IS NOT NULL), n AS (SELECT session_id, COUNT(*) AS n FROM s GROUP BY 1)
SELECT a.session_id AS a, b.session_id AS b, round(COUNT(*) / (ANY_VALUE(x.n) + ANY_VALUE(y.n) - COUNT(*)), 6) AS jaccard
FROM s a JOIN s b ON a.k = b.k AND a.session_id < b.session_id JOIN n x ON x.session_id = a.session_id JOIN n y ON y.session_id = b.session_id GROUP BY 1, 2""")
def session_jaccard(spark, d):
    return j.jaccard_within(chunks(spark, d), "k", "session_id").select("a", "b", rounded(F.col("jaccard"), 6).alias("jaccard"))


@query("prev_assistant_asof", f"""WITH {TRANSCRIPT} SELECT t.chunk_id, (SELECT p.chunk_id FROM transcript p WHERE p.conversation_id = t.conversation_id AND p.position < t.position
AND p.sender = 'assistant' ORDER BY p.position DESC LIMIT 1) AS previous FROM transcript t""")
def prev_assistant_asof(spark, d):
    return j.previous_of(transcript(spark, d), "conversation_id", ["position"], F.col("sender") == "assistant", "chunk_id", "previous").select("chunk_id", "previous")


@query("context_window", f"""WITH {TRANSCRIPT} SELECT t.chunk_id AS target, c.chunk_id, c.sender FROM transcript t JOIN transcript c
ON c.conversation_id = t.conversation_id AND c.position BETWEEN t.position - 2 AND t.position + 1 WHERE t.sender = 'assistant'""")
def context_window(spark, d):
    t = transcript(spark, d)
    targets = t.where("sender = 'assistant'").select("conversation_id", F.col("position").alias("_target"), F.col("chunk_id").alias("target"))
    return j.around(t, targets, "conversation_id", "position", 2, 1).select("target", "chunk_id", "sender")


@query("session_reconstruction", f"WITH {TRANSCRIPT} SELECT conversation_id, string_agg(sender, '>' ORDER BY position) AS senders, SUM(length(content))::BIGINT AS n_chars FROM transcript GROUP BY 1")
def session_reconstruction(spark, d):
    in_order = F.array_sort(F.collect_list(F.struct("position", "sender")))
    return transcript(spark, d).groupBy("conversation_id").agg(
        F.array_join(F.transform(in_order, lambda x: x["sender"]), ">").alias("senders"), F.sum(F.length("content")).cast("long").alias("n_chars")
    )


@query("correction_pairs", f"""WITH {TRANSCRIPT}, n AS (SELECT *, LEAD(sender) OVER w AS next_sender, LEAD(chunk_id) OVER w AS next_id FROM transcript WINDOW w AS (PARTITION BY conversation_id ORDER BY position))
SELECT chunk_id, next_id FROM n WHERE sender = 'user' AND next_sender = 'assistant'""")
def correction_pairs(spark, d):
    w = Window.partitionBy("conversation_id").orderBy("position")
    named = transcript(spark, d).withColumn("next_sender", F.lead("sender").over(w)).withColumn("next_id", F.lead("chunk_id").over(w))
    return named.where("sender = 'user' and next_sender = 'assistant'").select("chunk_id", "next_id")


@query("style_stats", r"""SELECT role, round(AVG(length(text)), 6) AS mean_chars, COUNT(*) FILTER (contains(text, '?')) AS questions,
COUNT(*) FILTER (regexp_matches(text, '[!]')) AS exclaims, round(AVG(len(regexp_extract_all(text, '[^ \t\n\r]+'))), 6) AS mean_words FROM conversations GROUP BY role""")
def style_stats(spark, d):
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]+"), F.lit(0)))
    return table(spark, d, "conversations").groupBy("role").agg(
        F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.count_if(F.contains("text", F.lit("?"))).alias("questions"),
        F.count_if(F.col("text").rlike("[!]")).alias("exclaims"), F.round(F.avg(words), 6).alias("mean_words"),
    )


@query("timeline_stats", "SELECT source, lang, COUNT(*) AS n, MIN(n_chars) AS shortest, MAX(n_chars) AS longest FROM documents GROUP BY 1, 2")
def timeline_stats(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


@query("normal_key_join", f"""WITH {GRAPH} SELECT e.id, c.c_custkey FROM entities e JOIN customer c
ON regexp_replace(lower(e.name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(replace(c.c_name, '#', '-')), '[^a-z0-9]', '', 'g') WHERE e.entity_type = 'customer'""")
def normal_key_join(spark, d):
    e = entities(spark, d).where("entity_type = 'customer'").select("id", j.normal_key("name").alias("key"))
    c = table(spark, d, "customer").select("c_custkey", j.normal_key(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("key"))
    return e.join(c, "key").select("id", "c_custkey")


@query("kg_stats", f"""WITH {GRAPH} SELECT 'entities' AS what, entity_type AS kind, COUNT(*) AS n FROM entities GROUP BY 2
UNION ALL SELECT 'relations', relation_type, COUNT(*) FROM relations GROUP BY 2 UNION ALL SELECT 'mentions', NULL, COUNT(*) FROM mentions""")
def kg_stats(spark, d):
    count = lambda df, what, kind: df.groupBy(F.lit(what).alias("what"), kind.alias("kind")).agg(F.count("*").alias("n"))
    return (
        count(entities(spark, d), "entities", F.col("entity_type")).union(count(relations(spark, d), "relations", F.col("relation_type")))
        .union(count(mentions(spark, d), "mentions", F.lit(None).cast("string")))
    )


@q("session_gap_ops", """, o AS (SELECT *, CASE WHEN epoch_us(created_at) - LAG(epoch_us(created_at)) OVER w > 3600000000 THEN 1 ELSE 0 END AS fresh FROM chunks WINDOW w AS (PARTITION BY session_id ORDER BY created_at, chunk_id)),
g AS (SELECT *, SUM(fresh) OVER (PARTITION BY session_id ORDER BY created_at, chunk_id) AS grp FROM o)
SELECT session_id, grp::BIGINT AS op, COUNT(*) AS steps FROM g GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def session_gap_ops(spark, d):
    from memlake.operators.temporal import gap_sessions

    c = chunks(spark, d).withColumn("us", micros("created_at"))
    return gap_sessions(c, "session_id", "us", "chunk_id", 3_600_000_000, "op").groupBy("session_id", "op").agg(F.count("*").alias("steps")).where("steps > 1")
