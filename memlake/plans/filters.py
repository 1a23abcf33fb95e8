"""Scans, filters and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators import filters as f
from memlake.registry import query
from memlake.sources.tables import CHUNKS, GRAPH, chunks, entities, relations, table

OUT = "chunk_id, session_id, content_type"


@query("chunk_count", f"WITH {CHUNKS} SELECT COUNT(*) AS n FROM chunks")
def chunk_count(spark, d):
    return chunks(spark, d).agg(F.count("*").alias("n"))


@query("filtered_scan_visibility", f"""WITH {CHUNKS} SELECT chunk_id, session_id, content_type, project FROM chunks
WHERE COALESCE(content_class, 'knowledge') NOT IN ('operational', 'test', 'benchmark', 'cold')
  AND (source_class IS NULL OR source_class NOT IN ('desktop', 'background-worker'))
  AND superseded_by IS NULL AND aggregated_into IS NULL AND archived_at IS NULL AND invalid_at IS NULL
  AND (project IN ('p1', 'p3') OR project IS NULL)""")
def filtered_scan_visibility(spark, d):
    seen = f.content_visible() & f.source_visible() & f.active() & f.current() & f.in_projects(["p1", "p3"])
    return chunks(spark, d).where(seen).select("chunk_id", "session_id", "content_type", "project")


@query("filter_equality_range", f"""WITH {CHUNKS} SELECT chunk_id, session_id, content_type FROM chunks
WHERE content_type = 'purchase' AND importance >= 1 AND CAST(created_at AS VARCHAR) >= '2024-01-02' AND CAST(created_at AS VARCHAR) <= '2024-01-20'""")
def filter_equality_range(spark, d):
    at = F.col("created_at").cast("string")
    return chunks(spark, d).where(f.equal_to(content_type="purchase") & (F.col("importance") >= 1) & (at >= "2024-01-02") & (at <= "2024-01-20")).select(*OUT.split(", "))


@query("consumer_scopes", f"""WITH {CHUNKS} SELECT 'worker' AS consumer, COUNT(*) AS n FROM chunks WHERE project IN ('p2')
UNION ALL SELECT 'lead', COUNT(*) FROM chunks WHERE project IN ('p2') OR project IS NULL
UNION ALL SELECT 'orchestrator', COUNT(*) FROM chunks UNION ALL SELECT 'coach', 0""")
def consumer_scopes(spark, d):
    of = {"worker": ["p2"], "lead": ["p2"], "orchestrator": [], "coach": []}
    seen = [F.count_if(f.consumer_scope(c, p)).alias(c) for c, p in of.items()]
    return chunks(spark, d).agg(*seen).unpivot([], list(of), "consumer", "n")


@query("like_escape_filter", "SELECT doc_id, source FROM documents WHERE lower(source) LIKE 'src1_' OR lower(source) LIKE '%\\_x%' ESCAPE '\\'")
def like_escape_filter(spark, d):
    return table(spark, d, "documents").where(f.like_any_case("source", "SRC1_") | f.like_any_case("source", "%!_x%", "!")).select("doc_id", "source")


@query("tag_semi_join", f"WITH {CHUNKS} SELECT {OUT} FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE tag IN ('k1', 'k7', 'k42'))")
def tag_semi_join(spark, d):
    c = chunks(spark, d)
    return f.tagged(c, c.select("chunk_id", "tag"), ["k1", "k7", "k42"]).select(*OUT.split(", "))


@query("audit_anti_join", f"WITH {CHUNKS} SELECT {OUT} FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks t WHERE t.chunk_id = c.chunk_id AND regexp_full_match(t.tag, 'k0|k9[0-9]'))")
def audit_anti_join(spark, d):
    c = chunks(spark, d)
    return f.untagged(c, c.select("chunk_id", "tag"), "k0|k9[0-9]").select(*OUT.split(", "))


@query("noise_exclusion", """SELECT doc_id FROM documents WHERE NOT (lower(text) LIKE '%password%' OR lower(text) LIKE '%licensed under%')
AND NOT (substr(lower(ltrim(text)), 1, 1024) LIKE 'the %' OR substr(lower(ltrim(text)), 1, 1024) LIKE 'die %')""")
def noise_exclusion(spark, d):
    return table(spark, d, "documents").where(f.contains_none("text", ["password", "Licensed under"]) & f.starts_with_none("text", ["the ", "die "])).select("doc_id")


@query("pending_enrichment", f"WITH {CHUNKS} SELECT {OUT} FROM chunks WHERE importance IS NULL AND archived_at IS NULL AND k >= 20")
def pending_enrichment(spark, d):
    return chunks(spark, d).where("importance is null and archived_at is null and k >= 20").select(*OUT.split(", "))


@query("interval_valid", f"""WITH {GRAPH} SELECT source_id, target_id, relation_type FROM relations
WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '1997-06-01') AND (valid_until IS NULL OR valid_until >= TIMESTAMP '1997-06-01')""")
def interval_valid(spark, d):
    return relations(spark, d).where(f.valid_at(F.expr("TIMESTAMP_NTZ'1997-06-01 00:00:00'"))).select("source_id", "target_id", "relation_type")


@query("glob_filter", "SELECT doc_id, source FROM documents WHERE source GLOB 'src[0-9]'")
def glob_filter(spark, d):
    return table(spark, d, "documents").where(f.glob("source", "src[0-9]")).select("doc_id", "source")


@query("reject_reasons", """SELECT reason, COUNT(*) AS n FROM (SELECT CASE WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) < 60 THEN 'too short'
WHEN regexp_matches(lower(trim(text)), '<(tool|system)[_-]') THEN 'machine output' END AS reason FROM conversations) GROUP BY reason""")
def reject_reasons(spark, d):
    return table(spark, d, "conversations").groupBy(f.reject_reason("text", 60).alias("reason")).agg(F.count("*").alias("n"))


@query("alias_resolve_join", f"""WITH {CHUNKS} SELECT c.chunk_id AS asked, t.chunk_id AS found, t.content_type FROM chunks c
JOIN chunks t ON t.chunk_id = CASE WHEN c.k = 3 THEN c.chunk_id - 1 ELSE c.chunk_id END WHERE t.superseded_by IS NULL AND t.aggregated_into IS NULL AND t.archived_at IS NULL""")
def alias_resolve_join(spark, d):
    from memlake.operators.joins import resolve_aliases

    c = chunks(spark, d)
    alias = c.where("k = 3").select(F.col("chunk_id").alias("old_id"), (F.col("chunk_id") - 1).alias("new_id"))
    asked = resolve_aliases(c.select(F.col("chunk_id").alias("asked")), alias, "asked")
    return asked.join(c.where(f.active()), F.col("found") == F.col("chunk_id")).select("asked", "found", "content_type")


@query("keyset_page", f"""WITH {GRAPH} SELECT id, entity_type, name FROM entities
WHERE entity_type > 'customer' OR (entity_type = 'customer' AND name < 'Customer#000000500') OR (entity_type = 'customer' AND name = 'Customer#000000500' AND id > 'customer:1')
ORDER BY entity_type, name DESC, id LIMIT 51""")
def keyset_page(spark, d):
    after = f.after_key([("entity_type", False), ("name", True), ("id", False)], ["customer", "Customer#000000500", "customer:1"])
    return entities(spark, d).where(after).orderBy("entity_type", F.desc("name"), "id").limit(51).select("id", "entity_type", "name")


@query("offset_page", f"WITH {GRAPH} SELECT id, name, (SELECT COUNT(*) FROM entities) AS total FROM entities ORDER BY name, id LIMIT 20 OFFSET 40")
def offset_page(spark, d):
    e = entities(spark, d)
    return e.orderBy("name", "id").offset(40).limit(20).select("id", "name").withColumn("total", e.agg(F.count("*").alias("n")).scalar())
