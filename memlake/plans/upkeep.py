"""Upkeep of memories and of the knowledge graph: backlogs, merges, names, facts, watched sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as x
from memlake.operators import graph as g
from memlake.operators import upkeep as u
from memlake.registry import query
from memlake.sources.tables import CHUNKS, GRAPH, chunks, entities, mentions, micros, relations, table


def q(name, select):
    return query(name, f"WITH {GRAPH}{select}")


def _name(kind, key):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


@q("entity_support", """, r AS (SELECT id, COUNT(*) AS n FROM (SELECT source_id AS id FROM relations UNION ALL SELECT target_id FROM relations WHERE source_id <> target_id) GROUP BY 1), m AS (SELECT entity_id AS id, COUNT(*) AS n FROM mentions GROUP BY 1)
SELECT e.id, COALESCE(r.n, 0) AS relations, COALESCE(m.n, 0) AS chunks FROM entities e LEFT JOIN r USING (id) LEFT JOIN m USING (id)""")
def entity_support(spark, d):
    return g.support(entities(spark, d), relations(spark, d), mentions(spark, d))


@query("sounding_like", """WITH n AS (SELECT 'nation:' || n_nationkey AS asked, list_distinct(string_split(n_name, '')) AS k FROM nation), a AS (SELECT 'region:' || r_regionkey AS id, list_distinct(string_split(r_name, '')) AS k FROM region),
p AS (SELECT asked, id, len(list_intersect(n.k, a.k)) AS b, len(n.k) AS x, len(a.k) AS y FROM n, a)
SELECT asked, id, round(b / (x + y - b), 9) AS score FROM p WHERE b > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY asked ORDER BY b / (x + y - b) DESC, id) = 1""")
def sounding_like(spark, d):
    signs = lambda c: F.array_distinct(F.split(c, ""))
    n = table(spark, d, "nation").select(_name("nation", "n_nationkey").alias("asked"), signs("n_name").alias("key"))
    a = table(spark, d, "region").select(_name("region", "r_regionkey").alias("id"), F.col("r_name").alias("alias"), signs("r_name").alias("key"))
    return g.sounding_like(n, a).select("asked", "id", F.round("score", 9).alias("score"))


_MERGED = ", g AS (SELECT 'supplier:' || s_suppkey AS merge_id, 'supplier:' || (s_suppkey - 1) AS keep_id FROM supplier WHERE s_suppkey % 2 = 1)"


def _merges(spark, d):
    return table(spark, d, "supplier").where("s_suppkey % 2 = 1").select(_name("supplier", "s_suppkey").alias("merge_id"), F.concat(F.lit("supplier:"), (F.col("s_suppkey") - 1).cast("string")).alias("keep_id"))


@q("merged_mentions", _MERGED + """, m AS (SELECT COALESCE(keep_id, entity_id) AS entity_id, chunk_id, relevance, CASE WHEN chunk_id % 2 = 0 THEN 'of ' || entity_id END AS context, keep_id IS NOT NULL AS moved FROM mentions LEFT JOIN g ON entity_id = merge_id)
SELECT entity_id, chunk_id, MAX(relevance) AS relevance, arg_max(context, (relevance, moved, context)) FILTER (context IS NOT NULL) AS context FROM m GROUP BY 1, 2""")
def merged_mentions(spark, d):
    m = mentions(spark, d).withColumn("context", F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("of "), "entity_id")))
    return g.merge_mentions(m, _merges(spark, d), "context")


@q("merged_entity_edges", _MERGED + """, m AS (SELECT COALESCE(a.keep_id, source_id) AS s, COALESCE(b.keep_id, target_id) AS t, relation_type, confidence, importance FROM relations LEFT JOIN g a ON source_id = a.merge_id LEFT JOIN g b ON target_id = b.merge_id)
SELECT s AS source_id, t AS target_id, relation_type, round(MAX(confidence), 9) AS confidence, MAX(importance) AS importance FROM m WHERE s <> t GROUP BY 1, 2, 3""")
def merged_entity_edges(spark, d):
    return g.merge_edges(relations(spark, d), _merges(spark, d)).withColumn("confidence", F.round("confidence", 9))


@query("promoted_tags", f"""WITH {CHUNKS} SELECT tag, COUNT(DISTINCT chunk_id) AS n, COUNT(DISTINCT session_id) AS sessions, 'auto-tag-' || tag AS entity_id FROM chunks WHERE tag IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT chunk_id) >= 5 AND COUNT(DISTINCT session_id) >= 3""")
def promoted_tags(spark, d):
    return g.promoted_tags(chunks(spark, d).select("chunk_id", "session_id", "tag"), "session_id", 5, 3)


@query("superseded_only_chunks", """WITH f AS (SELECT l_partkey AS entity_id, CASE WHEN l_returnflag = 'R' THEN 'superseded' ELSE 'active' END AS status, l_linenumber AS s, unnest([l_orderkey, l_orderkey // 2]) AS chunk_id FROM lineitem)
SELECT entity_id, chunk_id FROM f WHERE status = 'active' OR s > 1 GROUP BY 1, 2 HAVING NOT bool_or(status = 'active')""")
def superseded_only_chunks(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("entity_id"), F.when(F.col("l_returnflag") == "R", "superseded").otherwise("active").alias("status"),
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("superseded_by"), F.array(F.col("l_orderkey"), F.floor(F.col("l_orderkey") / 2)).alias("chunk_ids"),
    )
    return g.superseded_only(rows)


@query("refreshed_facts", """WITH e AS (SELECT user_id AS entity_id, event_type || ' at level ' || (CAST(json_extract_string(props, '$.k') AS BIGINT) // 10) AS fact, event_id % 2 AS n FROM events),
o AS (SELECT DISTINCT entity_id, fact FROM e WHERE n = 0), n AS (SELECT DISTINCT entity_id, fact FROM e WHERE n = 1),
c AS (SELECT n.entity_id, n.fact, o.fact AS against, len(list_intersect(list_filter(string_split(n.fact, ' '), lambda w: w <> 'at'), string_split(o.fact, ' '))) AS c FROM n ANTI JOIN o USING (entity_id, fact) JOIN o ON o.entity_id = n.entity_id),
b AS (SELECT entity_id, fact, against FROM c WHERE c >= 2 QUALIFY ROW_NUMBER() OVER (PARTITION BY entity_id, fact ORDER BY c DESC, against) = 1)
SELECT entity_id, fact, CASE WHEN o.fact IS NOT NULL AND n.fact IS NOT NULL THEN 'kept' WHEN o.fact IS NOT NULL THEN 'vanished' WHEN against IS NOT NULL THEN 'conflict' ELSE 'new' END AS change, against
FROM o FULL JOIN n USING (entity_id, fact) LEFT JOIN b USING (entity_id, fact)""")
def refreshed_facts(spark, d):
    level = F.floor(F.get_json_object("props", "$.k").cast("long") / 10).cast("string")
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("entity_id"), F.concat("event_type", F.lit(" at level "), level).alias("fact"))
    return g.refreshed_facts(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))


@q("alias_groups", """, a AS (SELECT 'part:' || p_partkey AS id, upper(p_name) AS alias FROM part WHERE p_partkey % 10 = 0),
s AS (SELECT id AS canonical, id AS member FROM entities UNION SELECT e.id, m.id FROM a JOIN entities e USING (id) JOIN entities m ON m.entity_type = e.entity_type AND lower(m.name) = lower(a.alias))
SELECT canonical, COUNT(DISTINCT chunk_id) AS chunks FROM s LEFT JOIN mentions ON entity_id = member GROUP BY 1""")
def alias_groups(spark, d):
    a = table(spark, d, "part").where("p_partkey % 10 = 0").select(_name("part", "p_partkey").alias("id"), F.upper("p_name").alias("alias"))
    return u.alias_mentions(entities(spark, d), a, mentions(spark, d))


@q("alias_lookup", """, a AS (SELECT 'nation:' || n_nationkey AS id, 'Land ' || n_nationkey AS alias FROM nation) SELECT asked, e.id, e.name FROM (SELECT DISTINCT 'LAND ' || (s_suppkey % 40) AS asked FROM supplier) JOIN a ON lower(asked) = lower(alias) JOIN entities e ON e.id = a.id""")
def alias_lookup(spark, d):
    a = table(spark, d, "nation").select(_name("nation", "n_nationkey").alias("id"), F.concat(F.lit("Land "), F.col("n_nationkey").cast("string")).alias("alias"))
    asked = table(spark, d, "supplier").select(F.concat(F.lit("LAND "), (F.col("s_suppkey") % 40).cast("string")).alias("asked")).distinct()
    return u.by_alias(asked, a, entities(spark, d))


@query("shown_events", """WITH e AS (SELECT o_orderkey, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey), c AS (SELECT p_partkey, p_type IN ('ECONOMY', 'PROMO') AS hidden FROM part WHERE p_partkey % 3 > 0)
SELECT o_orderkey FROM e LEFT JOIN c ON p_partkey = l_partkey GROUP BY 1 HAVING bool_or(l_partkey IS NULL OR COALESCE(NOT hidden, FALSE))""")
def shown_events(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_partkey").alias("ids"))
    events = table(spark, d, "orders").select("o_orderkey").join(items, "o_orderkey", "left")
    c = table(spark, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("chunk_id"), "p_type")
    return u.shown_events(events, "o_orderkey", "ids", c, F.col("p_type").isin("ECONOMY", "PROMO"))


@query("enrichment_backlog", f"""WITH {CHUNKS} SELECT content_type, COUNT(*) AS n, COUNT(importance) AS done, COUNT(*) - COUNT(importance) AS open, COUNT(*) FILTER (importance IS NOT NULL AND k % 4 = 0) AS again FROM chunks GROUP BY 1""")
def enrichment_backlog(spark, d):
    return u.backlog(chunks(spark, d), "content_type", F.col("importance").isNotNull(), F.col("k") % 4 == 0)


@query("unvectored_rows", """SELECT doc_id AS id, 'open' AS side FROM documents ANTI JOIN (SELECT vec_id * 2 AS doc_id FROM embeddings) USING (doc_id)
UNION ALL SELECT vec_id * 2, 'orphan' FROM embeddings ANTI JOIN (SELECT doc_id // 2 AS vec_id FROM documents WHERE doc_id % 2 = 0) USING (vec_id)""")
def unvectored_rows(spark, d):
    return u.unvectored(table(spark, d, "documents").select(F.col("doc_id").alias("id")), table(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("id")), "id")


@query("merged_duplicate_texts", r"""WITH t AS (SELECT p_brand AS g, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE replace(p_name, ' ', '  ') END AS c FROM part),
o AS (SELECT g, MIN(p_partkey) AS k, arg_min(c, p_partkey) AS c FROM t GROUP BY g, lower(trim(regexp_replace(c, '\s+', ' ', 'g')))),
l AS (SELECT g, list(c ORDER BY k) AS l FROM o GROUP BY 1)
SELECT g, CASE WHEN len(l) = 1 THEN l[1] ELSE l[1] || chr(10) || chr(10) || '[merged]' || chr(10) || array_to_string(list_transform(l[2:], lambda x, i: i || '. ' || x), chr(10)) END AS content FROM l""")
def merged_duplicate_texts(spark, d):
    c = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("  ")))
    return u.merged_text(table(spark, d, "part").select(F.col("p_brand").alias("g"), "p_partkey", c.alias("c")), "g", "p_partkey", "c")


@query("already_enriched", "SELECT p_partkey FROM part WHERE p_partkey % 5 > 0 AND lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_partkey % 5 = 0 AND p_size > 20)")
def already_enriched(spark, d):
    p = table(spark, d, "part")
    return u.known_content(p.where("p_partkey % 5 > 0").select("p_partkey", F.upper("p_name").alias("p_name")), p.where("p_partkey % 5 = 0 and p_size > 20"), "p_name").select("p_partkey")


@query("decay_fields", f"""WITH {CHUNKS} SELECT chunk_id, tag IN ('k1', 'k2') AS pinned, CASE WHEN importance IS NULL THEN 30.0 ELSE round(CASE WHEN i <= 5 THEN 7 + (i - 1) * 5.75::DOUBLE ELSE 30 + (i - 5) * 12 END, 2) END AS half_life
FROM (SELECT *, least(greatest(floor(importance), 1.0), 10.0) AS i FROM chunks)""")
def decay_fields(spark, d):
    return u.with_decay_fields(chunks(spark, d).withColumns({"tags": F.array("tag"), "importance": F.floor("importance").cast("double")}), "tags", ["k1", "k2"]).select("chunk_id", "pinned", "half_life")


@query("numeric_projects", f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE regexp_full_match(substr(project, 2) || CASE WHEN k % 3 = 0 THEN 'x' ELSE '' END, '[0-9]{{1,2}}')")
def numeric_projects(spark, d):
    c = chunks(spark, d).withColumn("project", F.concat(F.substring("project", 2, 9), F.when(F.col("k") % 3 == 0, "x").otherwise("")))
    return c.where(u.numeric_project("project")).select("chunk_id")


@query("quarantine_candidates", """SELECT p_partkey, CASE WHEN p_name LIKE 'cold %' THEN 'headline' WHEN p_partkey::VARCHAR LIKE '1%' THEN 'id' WHEN p_brand = 'Brand#13' THEN 'tag' END AS reason FROM part""")
def quarantine_candidates(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("id"), F.array("p_brand").alias("tags"), F.concat(F.lit("\n ## "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(":\nmore")).alias("c"))
    return p.select("p_partkey", u.quarantine_reason("c", "id", "tags", ["cold"], ["1"], ["Brand#13"]).alias("reason"))


@q("entity_name_plan", r""", k AS (SELECT id, entity_type, CASE WHEN id LIKE '%7' THEN '#' || split_part(id, ':', 2) WHEN entity_type = 'supplier' THEN 'Name ' || (CAST(split_part(id, ':', 2) AS BIGINT) % 6) ELSE name END AS name, CAST(split_part(id, ':', 2) AS BIGINT) % 4 AS support FROM entities),
s AS (SELECT *, regexp_replace(lower(name), '[^\pL\pN]', '', 'g') AS key FROM k), j AS (SELECT *, length(key) < 2 OR NOT regexp_matches(key, '\pL') AS junk FROM s),
b AS (SELECT entity_type, key, id AS best FROM j WHERE NOT junk QUALIFY ROW_NUMBER() OVER (PARTITION BY entity_type, key ORDER BY support DESC, id) = 1)
SELECT id, CASE WHEN junk THEN 'junk' WHEN best = id THEN 'keep' ELSE 'merge' END AS plan, CASE WHEN NOT junk AND best <> id THEN best END AS into FROM j LEFT JOIN b USING (entity_type, key)""")
def entity_name_plan(spark, d):
    number = F.split_part("id", F.lit(":"), F.lit(2))
    name = F.when(F.col("id").endswith("7"), F.concat(F.lit("#"), number)).when(F.col("entity_type") == "supplier", F.concat(F.lit("Name "), (number.cast("long") % 6).cast("string"))).otherwise(F.col("name"))
    return u.name_plan(entities(spark, d).select("id", "entity_type", name.alias("name"), (number.cast("long") % 4).alias("support")))


@q("valid_relations", """, f AS (SELECT source_id, target_id, CASE relation_type WHEN 'supplied_by' THEN 'supplies' ELSE 'is_in' END AS t FROM relations)
SELECT DISTINCT CASE t WHEN 'supplies' THEN target_id ELSE source_id END AS source_id, CASE t WHEN 'supplies' THEN source_id ELSE target_id END AS target_id, t AS relation_type FROM f""")
def valid_relations(spark, d):
    r = relations(spark, d).select("source_id", "target_id", F.replace(F.upper("relation_type"), F.lit("_"), F.lit(" - ")).alias("relation_type"))
    loops = r.select("source_id", F.col("source_id").alias("target_id"), "relation_type")
    return u.valid_relations(r.union(loops), {"part_of": "is_in", "based_in": "is_in"}, {"supplied_by": "supplies"})


@query("retargeted_aliases", """WITH a AS (SELECT s_suppkey AS old_id, s_suppkey % 10 AS new_id FROM supplier WHERE s_suppkey >= 10), m AS (SELECT s_suppkey AS old_id, s_suppkey % 3 AS new_id FROM supplier WHERE s_suppkey BETWEEN 3 AND 12),
r AS (SELECT a.old_id, COALESCE(m.new_id, a.new_id) AS new_id FROM a LEFT JOIN m ON m.old_id = a.new_id WHERE a.old_id NOT IN (SELECT old_id FROM m))
SELECT DISTINCT * FROM (SELECT * FROM r UNION ALL SELECT * FROM m) WHERE old_id <> new_id""")
def retargeted_aliases(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("old_id"))
    a = s.where("old_id >= 10").withColumn("new_id", F.col("old_id") % 10)
    return u.retargeted(a, s.where("old_id between 3 and 12").withColumn("new_id", F.col("old_id") % 3))


@query("session_plans", """WITH b AS (SELECT DISTINCT o_orderpriority AS branch, 'plan ' || o_orderpriority AS plan FROM orders WHERE o_orderpriority <> '3-MEDIUM'), r AS (SELECT c_custkey AS request, 'by ' || c_nationkey AS plan FROM customer WHERE c_custkey % 3 = 0)
SELECT o_orderkey, COALESCE(r.plan, b.plan) AS plan, CASE WHEN r.plan IS NOT NULL THEN 'request' WHEN b.plan IS NOT NULL THEN 'branch' END AS matched_by FROM orders LEFT JOIN b ON branch = o_orderpriority LEFT JOIN r ON request = o_custkey""")
def session_plans(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("branch"), F.col("o_custkey").alias("request"))
    b = o.where("branch <> '3-MEDIUM'").select("branch", F.concat(F.lit("plan "), "branch").alias("plan")).distinct()
    r = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("request"), F.concat(F.lit("by "), F.col("c_nationkey").cast("string")).alias("plan"))
    return u.plan_of(o, b, r).select("o_orderkey", "plan", "matched_by")


@query("frustration_pairs", """WITH t AS (SELECT user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, CASE WHEN event_type IN ('error', 'view') THEN 'frustration' ELSE 'neutral' END AS f FROM events),
n AS (SELECT user_id, p AS angry, f, MIN(CASE WHEN f <> 'frustration' THEN p END) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS calm FROM t)
SELECT user_id, angry, calm, calm - angry AS gap FROM n WHERE f = 'frustration' AND calm - angry <= 3""")
def frustration_pairs(spark, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    t = table(spark, d, "events").select("user_id", place.alias("p"), F.when(F.col("event_type").isin("error", "view"), "frustration").otherwise("neutral").alias("f"))
    return u.frustrated_then(t, "user_id", "p", "f", 3)


@query("late_sources", """WITH s AS (SELECT event_type, epoch_us(ts) AS us, value, value > 20 AS late, event_id FROM events),
g AS (SELECT *, COUNT(*) FILTER (NOT late) OVER (PARTITION BY event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s)
SELECT event_type, MIN(us) AS began, MAX(us) AS ended, MAX(value) AS worst FROM g WHERE late GROUP BY event_type, g HAVING MAX(us) - MIN(us) >= 300000000""")
def late_sources(spark, d):
    return u.late_spans(table(spark, d, "events").withColumn("us", micros("ts")), "event_type", "us", "value", 20.0, 300)


@query("wanted_enrichments", """WITH s AS (SELECT user_id, MAX(event_id) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT user_id, MAX(event_id) AS event_id FROM events e LEFT JOIN s USING (user_id) WHERE event_type = 'view' AND (v IS NULL OR event_id > v) GROUP BY 1""")
def wanted_enrichments(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return u.still_wanted(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "event_id").select("user_id", "event_id")


@query("cluster_silhouette", """WITH r AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
u AS (SELECT vec_id, label, list_transform(e, lambda v: v / sqrt(list_sum(list_transform(e, lambda w: w * w)))) AS e FROM r WHERE list_sum(list_transform(e, lambda w: w * w)) > 0),
p AS (SELECT label, p, SUM(v) AS v FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS p FROM u) GROUP BY 1, 2),
c AS (SELECT label AS c, list(v ORDER BY p) AS s FROM p GROUP BY 1), n AS (SELECT label AS c, COUNT(*) AS n FROM u GROUP BY 1),
d AS (SELECT vec_id, label, CASE WHEN c = label THEN 1 - (list_dot_product(e, s) - 1) / (n - 1) END AS a, CASE WHEN c <> label THEN 1 - list_dot_product(e, s) / n END AS b FROM u, c JOIN n USING (c)),
m AS (SELECT vec_id, label, round(MAX(a), 9) AS a, round(MIN(b), 9) AS b FROM d GROUP BY 1, 2)
SELECT vec_id, label, round((b - a) / greatest(a, b), 6) AS silhouette FROM m""")
def cluster_silhouette(spark, d):
    return u.silhouette(table(spark, d, "embeddings"), "vec_id", "label", "embedding").withColumn("silhouette", F.round("silhouette", 6))
