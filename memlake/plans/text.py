"""Text functions over documents, conversations and pages; streaming counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.functions import text as x
from memlake.operators import chunking
from memlake.registry import query
from memlake.sources.tables import table

FEEL = {k: " + ".join(f"CASE WHEN regexp_matches(low, '{x.sign(p).replace(chr(39), chr(39) * 2)}') THEN {w} ELSE 0 END" for p, w in signs) for k, signs in x.FEELINGS.items()}


@query("sentiment_label", f"""WITH l AS (SELECT conv_id, turn, lower(text) AS low FROM conversations),
s AS (SELECT conv_id, turn, ({FEEL['frustration']})::DOUBLE AS f, ({FEEL['confusion']})::DOUBLE AS c, ({FEEL['positive']})::DOUBLE AS p, ({FEEL['satisfaction']})::DOUBLE AS a FROM l),
t AS (SELECT *, greatest(f, c, p, a) AS top, p + a - f - c * 0.5 AS raw FROM s),
j AS (SELECT *, CASE WHEN top = 0 THEN 'neutral' WHEN f = top OR (f > 0 AND a > 0 AND f >= a) THEN 'frustration' WHEN c = top THEN 'confusion' WHEN p = top THEN 'positive'
WHEN a < 0.6 AND p = 0 THEN 'neutral' ELSE 'satisfaction' END AS label, greatest(-1.0, least(1.0, raw / greatest(abs(raw), 1.0))) AS score FROM t)
SELECT conv_id, turn, label, round(CASE WHEN top = 0 THEN 0.0 WHEN label = 'neutral' THEN score * 0.5 ELSE score END, 3)::DOUBLE AS score FROM j""")
def sentiment_label(spark, d):
    c = table(spark, d, "conversations").withColumn("s", x.feeling(F.col("text")))
    return c.select("conv_id", "turn", "s.label", "s.score")


@query("content_class", rf"""WITH l AS (SELECT lower(trim(text || CASE turn % 5 WHEN 1 THEN ' smoke test' WHEN 2 THEN chr(10) || 'heartbeat ok' ELSE '' END)) AS low FROM conversations
  UNION ALL SELECT 'heartbeat ' || conv_id || chr(10) || 'worker done' || CASE conv_id % 3 WHEN 0 THEN chr(10) || 'doctor' ELSE '' END FROM conversations WHERE turn = 0),
s AS (SELECT low, trim(regexp_replace(regexp_replace(low, '{x.OPERATIONAL_LINE}', '', 'g'), '\s+', ' ', 'g')) AS rest, regexp_matches(low, '{x.DECISION}') AS decides, regexp_matches(low, '{x.PERSONAL}') AS own FROM l)
SELECT class, COUNT(*) AS n FROM (SELECT CASE WHEN decides THEN 'decision' WHEN contains(low, 'smoke test') THEN CASE WHEN own THEN 'knowledge' ELSE 'test' END
  WHEN regexp_matches(low, '{x.OPERATIONAL}') AND (length(rest) <= 20 OR NOT regexp_matches(rest, '[\pL\pN]')) THEN CASE WHEN own THEN 'knowledge' ELSE 'operational' END ELSE 'knowledge' END AS class FROM s) GROUP BY 1""")
def content_class(spark, d):
    c, nl = table(spark, d, "conversations"), F.lit("\n")
    n = F.col("turn") % 5
    said = c.select(F.concat("text", F.when(n == 1, " smoke test").when(n == 2, "\nheartbeat ok").otherwise("")).alias("text"))
    own = F.when(F.col("conv_id") % 3 == 0, "\ndoctor").otherwise("")
    notes = c.where("turn = 0").select(F.concat(F.lit("heartbeat "), F.col("conv_id").cast("string"), nl, F.lit("worker done"), own))
    return said.union(notes).groupBy(x.content_class(F.col("text")).alias("class")).agg(F.count("*").alias("n"))


@query("pii_email_redact", f"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '{x.EMAIL}', '[EMAIL]', 'g'), '{x.PHONE}', '[PHONE]', 'g')) AS digest FROM documents")
def pii_email_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(x.redacted(F.col("text")), 256).alias("digest"))


@query("pii_numbered_redact")
def pii_numbered_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", x.numbered(F.col("text"), x.EMAIL, "EMAIL").alias("text"))


@query("regex_extract_paths", r"SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(url, '[A-Za-z0-9_-]+(?:/[A-Za-z0-9_.-]+)+'))), ' ') AS paths FROM pages")
def regex_extract_paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(x.file_paths(F.col("url")), " ").alias("paths"))


@query("timestamp_normalise", """SELECT event_id, round(epoch_us(ts) / 1000000.0, 3) AS iso, round((epoch_us(ts) // 1000) / 1000.0, 3) AS ms, round(epoch_us(ts) // 1000000, 3)::DOUBLE AS s FROM events""")
def timestamp_normalise(spark, d):
    from memlake.sources.tables import micros

    us = micros("ts")
    forms = {"iso": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "ms": F.floor(us / 1000).cast("string"), "s": F.floor(us / 1_000_000).cast("string")}
    return table(spark, d, "events").select("event_id", *(F.round(x.instant(c), 3).alias(n) for n, c in forms.items()))


@query("html_titles", r"""SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html[^>]* lang="([a-z]+)"', 1), '') AS lang FROM pages""")
def html_titles(spark, d):
    return table(spark, d, "pages").select("page_id", x.html_title(F.col("html")).alias("title"), x.language_of_page(F.col("html")).alias("lang"))


@query("tag_edit_distance", "SELECT DISTINCT a.source AS a, b.source AS b FROM (SELECT DISTINCT source FROM documents) a JOIN (SELECT DISTINCT source FROM documents) b ON length(a.source) = length(b.source) AND a.source < b.source WHERE levenshtein(a.source, b.source) <= 1")
def tag_edit_distance(spark, d):
    s = table(spark, d, "documents").select("source").distinct().withColumn("n", F.length("source"))
    a, b = s.withColumnRenamed("source", "a"), s.withColumnRenamed("source", "b")
    return a.join(b, "n").where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b") <= 1)).select("a", "b")


@query("chunk_paragraphs")
def chunk_paragraphs(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(x.paragraphs(F.col("text"), 2000)).alias("chunk", "content")).select("doc_id", "chunk", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("digest"))


KINDS = ("build_log", "user_message", "stack_trace", "assistant_text", "ai_code")


@query("chunked_documents")
def chunked_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % len(KINDS) + 1).cast("int")).alias("kind"))
    return chunking.chunked(docs, "doc_id", "text", "kind").select("doc_id", "chunk", "kind", "masked", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("digest"))


@query("masked_outputs", r"""WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 50)
SELECT doc_id, length(text) > 4000 AS masked, sha256(CASE WHEN length(text) <= 4000 THEN text ELSE
  array_to_string(l[1 : 5], chr(10)) || chr(10) || chr(10) || '[... ' || greatest(0, len(l) - 8) || ' lines elided ...]' || chr(10) || chr(10) || array_to_string(l[greatest(1, len(l) - 2) : len(l)], chr(10)) END) AS digest
FROM t WHERE length(text) <= 2000 OR length(text) > 4000""")
def masked_outputs(spark, d):
    made = chunking.chunked(table(spark, d, "documents").withColumn("kind", F.lit("file_read")), "doc_id", "text", "kind")
    whole = made.join(table(spark, d, "documents").where("length(text) <= 2000 or length(text) > 4000").select("doc_id"), "doc_id", "left_semi")
    return whole.select("doc_id", "masked", F.sha2("content", 256).alias("digest"))


@query("stream_ingest_counts", "SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT event_id) AS events FROM events GROUP BY 1")
def stream_ingest_counts(spark, d):
    from memlake.streaming.ingest import ingested

    return ingested(spark, d, "events", "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))
