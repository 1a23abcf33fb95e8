"""The tables of a folder, and the views over them that stand for chunks, tags, facts and the knowledge graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Events as chunks with lifecycle, class and project columns."""
    e = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.select(
        F.col("event_id").alias("chunk_id"), F.col("user_id").alias("session_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("content_type"),
        F.when(F.col("event_type") != "view", F.col("value") / 50).alias("importance"), "k", F.concat(F.lit("k"), F.col("k").cast("string")).alias("tag"),
        F.expr("case event_type when 'error' then 'operational' when 'signup' then 'test' when 'click' then null else 'knowledge' end").alias("content_class"),
        F.expr("case when k < 5 then 'desktop' when k < 10 then 'background-worker' when k < 50 then null else 'terminal' end").alias("source_class"),
        F.expr("case when k < 80 then concat('p', cast(k div 10 as string)) end").alias("project"),
        F.when(F.col("value") > 100, F.col("ts")).alias("archived_at"),
        F.expr("case when event_type = 'error' and value > 50 then event_id end").alias("superseded_by"),
        F.expr("case when event_type = 'click' and value > 60 then event_id end").alias("aggregated_into"),
        F.expr("case when value < 1 then ts end").alias("invalid_at"),
    )


#: The same in SQL.
CHUNKS = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
chunks AS (
  SELECT event_id AS chunk_id, user_id AS session_id, ts AS created_at, event_type AS content_type,
    CASE WHEN event_type <> 'view' THEN value / 50 END AS importance, k, 'k' || k AS tag,
    CASE event_type WHEN 'error' THEN 'operational' WHEN 'signup' THEN 'test' WHEN 'click' THEN NULL ELSE 'knowledge' END AS content_class,
    CASE WHEN k < 5 THEN 'desktop' WHEN k < 10 THEN 'background-worker' WHEN k < 50 THEN NULL ELSE 'terminal' END AS source_class,
    CASE WHEN k < 80 THEN 'p' || (k // 10) END AS project,
    CASE WHEN value > 100 THEN ts END AS archived_at,
    CASE WHEN event_type = 'error' AND value > 50 THEN event_id END AS superseded_by,
    CASE WHEN event_type = 'click' AND value > 60 THEN event_id END AS aggregated_into,
    CASE WHEN value < 1 THEN ts END AS invalid_at
  FROM ev)"""


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """id, entity_type, name, parent_id of regions, nations, customers, suppliers and parts."""

    def of(kind: str, key: str, name: str, parent: Column) -> DataFrame:
        return table(spark, folder, kind).select(
            F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("entity_type"), F.col(name).alias("name"), parent.alias("parent_id")
        )

    nation = lambda c: F.concat(F.lit("nation:"), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    return (
        of("region", "r_regionkey", "r_name", none)
        .union(of("nation", "n_nationkey", "n_name", F.concat(F.lit("region:"), F.col("n_regionkey").cast("string"))))
        .union(of("customer", "c_custkey", "c_name", nation("c_nationkey")))
        .union(of("supplier", "s_suppkey", "s_name", nation("s_nationkey")))
        .union(of("part", "p_partkey", "p_name", none))
    )


#: Rows of lineitem that one task groups.
EACH = 250_000


def relations(spark: SparkSession, folder: str) -> DataFrame:
    """source_id, target_id, relation_type, confidence, importance, valid_from, valid_until, source_chunk of the graph's edges."""
    open_ = [F.lit(None).cast("timestamp_ntz").alias(c) for c in ("valid_from", "valid_until")]
    own = entities(spark, folder).where("parent_id is not null").select(
        F.col("id").alias("source_id"), F.col("parent_id").alias("target_id"), F.when(F.col("entity_type") == "nation", "part_of").otherwise("based_in").alias("relation_type"),
        F.lit(1.0).alias("confidence"), F.lit(5.0).alias("importance"), *open_, F.lit(None).cast("long").alias("source_chunk"),
    )
    items = table(spark, folder, "lineitem")
    # most pairs are in one row: rows are dealt before they are grouped, so that a task's groups are about EACH at any size
    parts = max(spark.sparkContext.defaultParallelism, items.count() // EACH)
    supplied = items.repartition(parts, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(
        F.min("l_discount").alias("least"), F.count("*").alias("n"), F.min("l_shipdate").alias("valid_from"), F.max("l_shipdate").alias("valid_until"), F.min("l_orderkey").alias("source_chunk")
    ).select(
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("source_id"), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("target_id"),
        F.lit("supplied_by").alias("relation_type"), (1 - F.col("least")).alias("confidence"), F.col("n").cast("double").alias("importance"), "valid_from", "valid_until", "source_chunk",
    )
    return own.union(supplied)


def mentions(spark: SparkSession, folder: str) -> DataFrame:
    """entity_id, chunk_id (the order), relevance of the parts and suppliers in orders."""
    items = table(spark, folder, "lineitem")
    return items.select(
        F.explode(F.array(F.concat(F.lit("part:"), F.col("l_partkey").cast("string")), F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")))).alias("entity_id"),
        F.col("l_orderkey").alias("chunk_id"), F.col("l_quantity").alias("relevance"),
    )


#: The same in SQL.
GRAPH = """
entities AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS entity_type, r_name AS name, NULL::VARCHAR AS parent_id FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, NULL FROM part),
relations AS (
  SELECT id AS source_id, parent_id AS target_id, CASE WHEN entity_type = 'nation' THEN 'part_of' ELSE 'based_in' END AS relation_type,
    1.0::DOUBLE AS confidence, 5.0::DOUBLE AS importance, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_until, NULL::BIGINT AS source_chunk
  FROM entities WHERE parent_id IS NOT NULL
  UNION ALL
  SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied_by', 1 - MIN(l_discount), COUNT(*)::DOUBLE, MIN(l_shipdate), MAX(l_shipdate), MIN(l_orderkey)
  FROM lineitem GROUP BY l_partkey, l_suppkey),
mentions AS (
  SELECT 'part:' || l_partkey AS entity_id, l_orderkey AS chunk_id, l_quantity AS relevance FROM lineitem
  UNION ALL SELECT 'supplier:' || l_suppkey, l_orderkey, l_quantity FROM lineitem)"""


def transcript(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as chunks: chunk_id, conversation_id, position, sender, content."""
    return table(spark, folder, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("conv_id").alias("conversation_id"), F.col("turn").alias("position"),
        F.col("role").alias("sender"), F.col("text").alias("content"),
    )


TRANSCRIPT = "transcript AS (SELECT conv_id || '-' || turn AS chunk_id, conv_id AS conversation_id, turn AS position, role AS sender, text AS content FROM conversations)"
