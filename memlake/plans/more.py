"""Secondary operators: calibration, both-way facts, suggestions, labels, context, invalidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text
from memlake.functions.scores import rounded
from memlake.operators import aggregates as a
from memlake.operators import clusters as c
from memlake.operators import graph as g
from memlake.operators import search as s
from memlake.operators.joins import jaccard_within, normal_key
from memlake.operators.vectors import mean_vectors
from memlake.registry import query
from memlake.sources.tables import CHUNKS, GRAPH, TRANSCRIPT, chunks, entities, micros, relations, table, transcript


@query("importance_calibration", f"""WITH {CHUNKS}, s AS (SELECT *, COALESCE(importance, 5.0) AS x FROM chunks), t AS (SELECT *, CASE WHEN content_type = 'purchase' THEN greatest(x, 8.0) ELSE x END AS y FROM s),
u AS (SELECT *, CASE WHEN content_type = 'view' THEN least(y, 5.0) ELSE y END AS z FROM t)
SELECT content_type, round(SUM(greatest(CASE WHEN content_type IN ('click', 'error') AND NOT k >= 50 THEN least(z - 2, 5.0) ELSE z END, 1.0)), 4) AS total FROM u GROUP BY 1""")
def importance_calibration(spark, d):
    kind = F.col("content_type")
    value = c.calibrated(F.col("importance"), kind == "purchase", kind == "view", kind.isin("click", "error"), F.col("k") >= 50)
    return chunks(spark, d).groupBy("content_type").agg(F.round(F.sum(value), 4).alias("total"))


@query("kg_semantic_entities", f"WITH {GRAPH} SELECT id FROM entities e WHERE EXISTS (SELECT 1 FROM relations r WHERE (r.source_id = e.id OR r.target_id = e.id) AND r.relation_type <> 'supplied_by')")
def kg_semantic_entities(spark, d):
    ends = relations(spark, d).where("relation_type <> 'supplied_by'").select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return entities(spark, d).select("id").join(ends, "id", "left_semi")


@query("kg_facts_both_ways", f"""WITH {GRAPH}, named AS (SELECT id FROM entities WHERE lower(name) = lower('{{name}}'))
SELECT target_id AS other, relation_type FROM relations WHERE source_id IN (SELECT id FROM named) UNION ALL SELECT source_id, relation_type FROM relations WHERE target_id IN (SELECT id FROM named)""".replace("'{name}'", "(SELECT MIN(r_name) FROM region)"))
def kg_facts_both_ways(spark, d):
    asked = table(spark, d, "region").agg(F.lower(F.min("r_name")).alias("key"))
    named = entities(spark, d).withColumn("key", F.lower("name")).join(asked, "key", "left_semi").select("id")
    r = relations(spark, d)
    out = r.join(named, r.source_id == named.id, "left_semi").select(F.col("target_id").alias("other"), "relation_type")
    return out.union(r.join(named, r.target_id == named.id, "left_semi").select("source_id", "relation_type"))


@query("kg_duplicate_suggestions", f"WITH {GRAPH} SELECT entity_type, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, COUNT(*) AS n, MIN(id) AS canonical FROM entities GROUP BY 1, 2 HAVING COUNT(*) > 1")
def kg_duplicate_suggestions(spark, d):
    return entities(spark, d).groupBy("entity_type", normal_key("name").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("canonical")).where("n > 1")


@query("kg_entity_fts", f"WITH {GRAPH} SELECT id, len(list_intersect(regexp_extract_all(lower(name), '[a-z0-9]+'), ['blue', 'widget', 'bolt']))::BIGINT AS hits FROM entities WHERE list_has_any(regexp_extract_all(lower(name), '[a-z0-9]+'), ['blue', 'widget', 'bolt'])")
def kg_entity_fts(spark, d):
    return s.matching(entities(spark, d), "id", "name", ["blue", "widget", "bolt"], "or")


@query("kg_hybrid_facts", f"""WITH {GRAPH}, f AS (SELECT source_id, target_id, confidence, importance, ROW_NUMBER() OVER (ORDER BY importance DESC, round(confidence, 6) DESC, source_id, target_id) AS rank FROM relations WHERE relation_type = 'supplied_by' QUALIFY rank <= 30)
SELECT source_id, target_id, round(1.0 / (60 + rank) * importance * confidence, 6) AS score FROM f""")
def kg_hybrid_facts(spark, d):
    facts = relations(spark, d).where("relation_type = 'supplied_by'").withColumn("all", F.lit(1)).withColumn("c", F.round("confidence", 6))
    few = facts.orderBy(F.desc("importance"), F.desc("c"), "source_id", "target_id").limit(30)
    top = a.best_of(few, ["all"], [F.desc("importance"), F.desc("c"), "source_id", "target_id"], 30, "rank")
    return top.select("source_id", "target_id", F.round(1 / (60 + F.col("rank")) * F.col("importance") * F.col("confidence"), 6).alias("score"))


@query("kg_entities_in_query", f"WITH {GRAPH}, w AS (SELECT unnest(['france', 'asia', 'red widget', 'from', 'blue bolt']) AS surface) SELECT id, surface FROM entities JOIN w ON lower(name) = surface")
def kg_entities_in_query(spark, d):
    surfaces = spark.createDataFrame([(x,) for x in ("france", "asia", "red widget", "from", "blue bolt")], "surface string")
    return entities(spark, d).join(F.broadcast(surfaces), F.lower("name") == F.col("surface")).select("id", "surface")


@query("next_positions", f"WITH {TRANSCRIPT} SELECT conversation_id, MAX(position) + 1 AS next_position FROM transcript GROUP BY 1")
def next_positions(spark, d):
    return transcript(spark, d).groupBy("conversation_id").agg((F.max("position") + 1).alias("next_position"))


@query("think_by_intent", f"""WITH {CHUNKS} SELECT content_type, chunk_id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY content_type ORDER BY importance DESC, chunk_id) AS rank FROM chunks WHERE importance >= 3) WHERE rank <= 5""")
def think_by_intent(spark, d):
    return a.best_of(chunks(spark, d).where("importance >= 3"), ["content_type"], [F.desc("importance"), "chunk_id"], 5, "rank").select("content_type", "chunk_id", "rank")


@query("resume_checkpoints", f"WITH {CHUNKS} SELECT chunk_id, tag FROM chunks WHERE content_type = 'signup' AND lower(tag) LIKE 'k2%' AND created_at >= TIMESTAMP '2024-01-05' ORDER BY created_at DESC, chunk_id LIMIT 20")
def resume_checkpoints(spark, d):
    recent = chunks(spark, d).where((F.col("content_type") == "signup") & F.lower("tag").startswith("k2") & (F.col("created_at") >= F.expr("TIMESTAMP_NTZ'2024-01-05 00:00:00'")))
    return recent.orderBy(F.desc("created_at"), "chunk_id").limit(20).select("chunk_id", "tag")


@query("migration_invalidation", "SELECT doc_id, round(n_chars / 1000 * CASE WHEN EXISTS (SELECT 1 FROM region WHERE contains(lower(text), substr(lower(r_name), 1, 3))) THEN 0.3 ELSE 1 END, 6) AS strength FROM documents")
def migration_invalidation(spark, d):
    # the patterns are a table of a few rows
    patterns = table(spark, d, "region").agg(F.collect_list(F.substring(F.lower("r_name"), 1, 3))).scalar()
    docs = table(spark, d, "documents").withColumn("patterns", patterns).withColumn("low", F.lower("text"))
    hit = F.exists("patterns", lambda p: F.contains("low", p))
    return docs.select("doc_id", F.round(F.col("n_chars") / 1000 * F.when(hit, 0.3).otherwise(1.0), 6).alias("strength"))


@query("failed_queries", f"WITH {CHUNKS} SELECT tag, content_type, COUNT(*) AS n FROM chunks GROUP BY 1, 2 HAVING COUNT(*) <= 12 AND MIN(importance) IS NOT NULL")
def failed_queries(spark, d):
    return chunks(spark, d).groupBy("tag", "content_type").agg(F.count("*").alias("n"), F.min("importance").alias("m")).where("n <= 12 and m is not null").drop("m")


@query("group_term_labels", """WITH p AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), tf AS (SELECT lang, term, COUNT(*) AS tf FROM p GROUP BY 1, 2), f AS (SELECT term, SUM(tf) AS f FROM tf GROUP BY 1),
n AS (SELECT lang, SUM(tf) AS n FROM tf GROUP BY 1), m AS (SELECT AVG(n) AS mean FROM n), s AS (SELECT lang, term, tf / n * ln(1 + mean / f) AS score FROM tf JOIN n USING (lang) JOIN f USING (term), m)
SELECT lang, term, round(score, 6) AS score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY round(score, 9) DESC, term) AS rank FROM s) WHERE rank <= 5""")
def group_term_labels(spark, d):
    return c.term_labels(table(spark, d, "documents"), "lang", text.tokens(F.col("text"))).withColumn("score", F.round("score", 6))


@query("session_similarity", f"""WITH {CHUNKS}, v AS (SELECT session_id, p, AVG(x) AS x FROM (SELECT session_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM chunks JOIN embeddings ON vec_id = chunk_id) GROUP BY 1, 2),
vs AS (SELECT session_id, list(x ORDER BY p) AS v FROM v GROUP BY 1), f AS (SELECT DISTINCT session_id, k FROM chunks WHERE k IS NOT NULL),
s AS (SELECT session_id, COUNT(DISTINCT k) AS n, AVG(epoch_us(created_at)) / 3600000000.0 AS h, MIN(project) AS p, MIN(source_class) AS plan FROM chunks GROUP BY 1),
sh AS (SELECT a.session_id AS a, b.session_id AS b, COUNT(*) AS m FROM f a JOIN f b ON a.k = b.k AND a.session_id < b.session_id GROUP BY 1, 2)
SELECT a, b, round(0.40 * COALESCE(list_cosine_similarity(va.v, vb.v), 0) + 0.35 * m / (x.n + y.n - m) + 0.15 * greatest(0.0, 1 - abs(x.h - y.h) / 168)
  + 0.10 * CASE WHEN x.p = y.p THEN 1.0 WHEN x.plan = y.plan THEN 0.7 ELSE 0.0 END, 5) AS likeness
FROM sh JOIN s x ON x.session_id = a JOIN s y ON y.session_id = b LEFT JOIN vs va ON va.session_id = a LEFT JOIN vs vb ON vb.session_id = b""")
def session_similarity(spark, d):
    own = chunks(spark, d)
    facts = own.groupBy("session_id").agg((F.avg(micros("created_at")) / 3_600_000_000).alias("h"), F.min("project").alias("p"), F.min("source_class").alias("plan"))
    spoken = own.select("chunk_id", "session_id").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")
    # vectors are dealt by their sessions before they are taken apart, so that components are not exchanged
    facts = facts.join(mean_vectors(spoken.repartition("session_id"), "session_id", "embedding"), "session_id", "left")
    facts = facts.withColumn("centroid", F.when(F.forall("centroid", lambda x: x.isNotNull()), F.col("centroid")))
    pairs = jaccard_within(own, "k", "session_id", facts, cosines=("centroid",), gaps=("h",), same=("p", "plan"))
    like = F.coalesce("centroid", F.lit(0.0))
    return pairs.select("a", "b", rounded(c.session_likeness(like, F.col("jaccard"), F.col("h"), F.col("p"), F.col("plan")), 5).alias("likeness"))


@query("communities")
def communities(spark, d):
    from memlake.operators.vectors import neighbour_edges

    return c.label_propagation(neighbour_edges(table(spark, d, "embeddings"), "vec_id", "embedding", 3), 4)


@query("kg_upsert_latest", f"""WITH {GRAPH}, o AS (SELECT 'order:' || l_orderkey AS source_id, 'part:' || l_partkey AS target_id, l_linenumber AS o, l_discount AS confidence FROM lineitem)
SELECT source_id, target_id, round(arg_max(confidence, o), 6) AS confidence FROM o GROUP BY 1, 2 HAVING COUNT(DISTINCT o) = COUNT(*)""")
def kg_upsert_latest(spark, d):
    items = table(spark, d, "lineitem").select(
        F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("source_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id"), F.lit("has").alias("relation_type"),
        F.col("l_linenumber").alias("o"), F.col("l_discount").alias("confidence"), F.lit(None).cast("double").alias("importance"), F.lit(None).cast("string").alias("valid_from"),
    )
    sound = items.groupBy("source_id", "target_id").agg(F.countDistinct("o").alias("x"), F.count("*").alias("y")).where("x = y").select("source_id", "target_id")
    return g.merged_edges(items, "o").join(sound, ["source_id", "target_id"], "left_semi").select("source_id", "target_id", F.round("confidence", 6).alias("confidence"))
