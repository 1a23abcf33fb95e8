"""Knowledge-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import aggregates as a
from memlake.operators import filters as f
from memlake.operators import graph as g
from memlake.registry import query
from memlake.sources.tables import GRAPH, entities, mentions, relations, table


def q(name, select):
    return query(name, f"WITH {GRAPH} {select}")




@q("kg_neighbors_both", """SELECT target_id AS neighbour, relation_type, 'out' AS direction FROM relations WHERE source_id = 'nation:3'
UNION ALL SELECT source_id, relation_type, 'in' FROM relations WHERE target_id = 'nation:3'""")
def kg_neighbors_both(spark, d):
    return g.neighbours(relations(spark, d), "nation:3")


@query("kg_traverse", f"""WITH RECURSIVE {GRAPH}, walk AS (SELECT id AS start, id, [id] AS path, 0 AS depth FROM entities WHERE entity_type = 'part'
UNION ALL SELECT w.start, r.target_id, list_append(w.path, r.target_id), w.depth + 1 FROM walk w JOIN relations r ON r.source_id = w.id WHERE w.depth < 3 AND NOT list_contains(w.path, r.target_id))
SELECT DISTINCT start, id, depth::BIGINT AS depth FROM walk WHERE depth > 0""")
def kg_traverse(spark, d):
    return g.traverse(relations(spark, d), entities(spark, d).where("entity_type = 'part'").select("id"), 3)


@query("kg_traverse_typed", f"""WITH {GRAPH} SELECT a.source_id AS start, a.target_id AS id, 1::BIGINT AS depth FROM relations a JOIN entities e ON e.id = a.source_id WHERE e.entity_type = 'supplier' AND a.relation_type IN ('based_in', 'part_of')
UNION SELECT a.source_id, b.target_id, 2 FROM relations a JOIN entities e ON e.id = a.source_id JOIN relations b ON b.source_id = a.target_id WHERE e.entity_type = 'supplier' AND b.relation_type IN ('based_in', 'part_of') AND a.relation_type IN ('based_in', 'part_of')""")
def kg_traverse_typed(spark, d):
    return g.traverse(relations(spark, d), entities(spark, d).where("entity_type = 'supplier'").select("id"), 2, ["based_in", "part_of"])


@q("kg_children", "SELECT p.id AS parent, COUNT(*) AS children FROM entities c JOIN entities p ON c.parent_id = p.id GROUP BY 1")
def kg_children(spark, d):
    e = entities(spark, d)
    return e.select(F.col("parent_id").alias("parent")).join(e.select(F.col("id").alias("parent")), "parent").groupBy("parent").agg(F.count("*").alias("children"))


@q("kg_current_facts", """SELECT s.name AS source, t.name AS target, r.relation_type FROM relations r JOIN entities s ON s.id = r.source_id JOIN entities t ON t.id = r.target_id
WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '1998-06-01') AND (valid_until IS NULL OR valid_until >= TIMESTAMP '1998-06-01')""")
def kg_current_facts(spark, d):
    e = entities(spark, d)
    source, target = e.select(F.col("id").alias("source_id"), F.col("name").alias("source")), e.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    return relations(spark, d).where(f.valid_at(F.expr("TIMESTAMP_NTZ'1998-06-01 00:00:00'"))).join(source, "source_id").join(target, "target_id").select("source", "target", "relation_type")


@q("kg_fact_search", """SELECT r.source_id, r.target_id, round(r.confidence, 6) AS confidence, o.o_orderstatus FROM relations r LEFT JOIN orders o ON o.o_orderkey = r.source_chunk
WHERE r.relation_type <> 'based_in' AND (r.source_chunk IS NULL OR o.o_orderstatus <> 'F') ORDER BY r.importance DESC, round(r.confidence, 6) DESC, r.source_id, r.target_id LIMIT 50""")
def kg_fact_search(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("source_chunk"), "o_orderstatus")
    rows = relations(spark, d).where("relation_type <> 'based_in'").join(o, "source_chunk", "left").where("source_chunk is null or o_orderstatus <> 'F'")
    rows = rows.withColumn("confidence", F.round("confidence", 6))
    return rows.orderBy(F.desc("importance"), F.desc("confidence"), "source_id", "target_id").limit(50).select("source_id", "target_id", "confidence", "o_orderstatus")


@q("kg_degree", "SELECT id, COUNT(*) AS degree FROM (SELECT source_id AS id FROM relations UNION ALL SELECT target_id FROM relations) GROUP BY 1")
def kg_degree(spark, d):
    return g.degrees(relations(spark, d))


@q("kg_entity_importance", """, m AS (SELECT entity_id AS id, COUNT(*) AS links, AVG(relevance) / 10 AS mean FROM mentions GROUP BY 1), r AS (SELECT source_id AS id, COUNT(*) AS rels FROM relations GROUP BY 1),
raw AS (SELECT m.id, log2(1 + links) * (mean / 10) * (1 + 0.1 * COALESCE(rels, 0)) AS x FROM m LEFT JOIN r USING (id)), e AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM raw)
SELECT id, round(0.5 + (x - lo) / (hi - lo) * 9.0, 5) AS importance FROM raw, e""")
def kg_entity_importance(spark, d):
    m = mentions(spark, d).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("links"), (F.avg("relevance") / 10).alias("mean"))
    r = relations(spark, d).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("rels"))
    raw = m.join(r, "id", "left").select("id", g.importance(F.col("links"), F.col("mean"), F.coalesce("rels", F.lit(0))).alias("x"))
    return a.scaled(raw, "x", 0.5, 9.5, "importance").select("id", F.round("importance", 5).alias("importance"))


@q("kg_effective_score", """SELECT source_id, target_id, round(confidence * importance * exp(-0.0077 * date_diff('day', valid_from, TIMESTAMP '2000-01-01')), 6) AS score FROM relations WHERE valid_from IS NOT NULL""")
def kg_effective_score(spark, d):
    rows = relations(spark, d).where("valid_from is not null").withColumn("days", F.date_diff(F.lit("2000-01-01").cast("date"), F.col("valid_from").cast("date")))
    return rows.select("source_id", "target_id", F.round(g.faded(rows, F.col("days"), "relation_type"), 6).alias("score"))


@q("kg_comention_pairs", """, u AS (SELECT DISTINCT chunk_id, entity_id FROM mentions) SELECT x.entity_id AS a, y.entity_id AS b, COUNT(*) AS n FROM u x JOIN u y ON x.chunk_id = y.chunk_id AND x.entity_id < y.entity_id GROUP BY 1, 2 HAVING COUNT(*) >= 2""")
def kg_comention_pairs(spark, d):
    return g.co_mentions(mentions(spark, d)).where("n >= 2")


@q("kg_cooccurrence_cross_type", """, u AS (SELECT DISTINCT chunk_id, entity_id, split_part(entity_id, ':', 1) AS kind FROM mentions)
SELECT x.entity_id AS a, y.entity_id AS b, COUNT(*) AS n FROM u x JOIN u y ON x.chunk_id = y.chunk_id AND x.entity_id < y.entity_id AND x.kind <> y.kind GROUP BY 1, 2 HAVING COUNT(*) >= 3""")
def kg_cooccurrence_cross_type(spark, d):
    return g.co_mentions(mentions(spark, d), F.split_part("entity_id", F.lit(":"), F.lit(1))).where("n >= 3")


@q("kg_resolution_cascade", """, names AS (SELECT upper(n_name) AS asked FROM nation UNION SELECT r_name || '!' FROM region UNION SELECT 'N' || n_nationkey FROM nation), al AS (SELECT 'n' || n_nationkey AS alias, 'nation:' || n_nationkey AS id FROM nation),
hits AS (SELECT asked, id, 1 AS stage FROM names JOIN entities ON lower(asked) = lower(name) UNION ALL SELECT asked, id, 2 FROM names JOIN al ON lower(asked) = lower(alias)
UNION ALL SELECT asked, id, 3 FROM names JOIN entities ON regexp_replace(lower(asked), '[^a-z0-9]', '', 'g') = regexp_replace(lower(name), '[^a-z0-9]', '', 'g'))
SELECT asked, id, stage::INTEGER AS stage FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY asked ORDER BY stage, id) AS rn FROM hits) WHERE rn = 1""")
def kg_resolution_cascade(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    number = F.col("n_nationkey").cast("string")
    names = nation.select(F.upper("n_name").alias("asked")).union(region.select(F.concat("r_name", F.lit("!")))).union(nation.select(F.concat(F.lit("N"), number))).distinct()
    aliases = nation.select(F.concat(F.lit("n"), number).alias("alias"), F.concat(F.lit("nation:"), number).alias("id"))
    return g.resolve(names, entities(spark, d).select("id", "name"), aliases)


@q("entity_fact_agg", """SELECT l_partkey AS part, COUNT(*) AS frequency, MIN(l_orderkey) AS first_order, MAX(l_orderkey) AS last_order, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1""")
def entity_fact_agg(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(
        F.count("*").alias("frequency"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order"), a.joined_distinct("l_returnflag").alias("flags")
    )


@q("entity_health", """, r AS (SELECT target_id AS id, COUNT(*) AS n FROM relations GROUP BY 1), m AS (SELECT entity_id AS id, COUNT(*) AS n FROM mentions GROUP BY 1)
SELECT e.id, round(0.40 * (CASE WHEN e.name IS NOT NULL THEN 1 ELSE 0 END) + 0.25 * (CASE WHEN s.s_acctbal > 0 THEN 1 ELSE 0 END) + 0.15 * least(COALESCE(r.n, 0) / 10, 1.0) + 0.10 * least(COALESCE(m.n, 0) / 500, 1.0) + 0.05, 4) AS health
FROM entities e JOIN supplier s ON e.id = 'supplier:' || s.s_suppkey LEFT JOIN r ON r.id = e.id LEFT JOIN m ON m.id = e.id""")
def entity_health(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), "s_acctbal")
    r = relations(spark, d).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("r"))
    m = mentions(spark, d).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("m"))
    rows = entities(spark, d).join(s, "id").join(r, "id", "left").join(m, "id", "left")
    share = lambda c, n: F.coalesce(c, F.lit(0)) / n
    required, expected = F.when(F.col("name").isNotNull(), 1.0).otherwise(0.0), F.when(F.col("s_acctbal") > 0, 1.0).otherwise(0.0)
    return rows.select("id", g.health(required, expected, share("r", 10), share("m", 500), F.lit(None).cast("double")).alias("health"))


@q("kg_preferred_entity", """SELECT entity_type, id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_type, substr(name, 1, 4) ORDER BY degree DESC, id) AS rn FROM
(SELECT e.*, COALESCE(x.n, 0) AS degree FROM entities e LEFT JOIN (SELECT target_id AS id, COUNT(*) AS n FROM relations GROUP BY 1) x USING (id))) WHERE rn = 1""")
def kg_preferred_entity(spark, d):
    n = relations(spark, d).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("n"))
    rows = entities(spark, d).join(n, "id", "left").withColumns({"relations": F.coalesce("n", F.lit(0)), "chunks": F.lit(0), "head": F.substring("name", 1, 4)})
    # names of one head have capitals alike
    return g.preferred(rows, ["entity_type", "head"]).select("entity_type", "id")
