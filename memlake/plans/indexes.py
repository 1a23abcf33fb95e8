"""Search through indexes that are written once; names in texts; logs that grow, and events by kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from memlake.operators.kmeans import sampled
from memlake.operators.spans import name_spans, name_table, words_of
from memlake.operators.textindex import TextIndex, add_part
from memlake.operators.vectorindex import VectorIndex
from memlake.plans.search import BM25, TERMS, TOK
from memlake.registry import query
from memlake.sources.tables import table
from memlake.storage import new_path


def _index(spark, d, kind="postings"):
    """Documents in three parts: some as they were before, then all of these and the others as they are, then one in ten deleted."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), new_path(spark, "index")
    old = docs.where("doc_id % 3 = 0").withColumn("text", F.concat(F.reverse("text"), F.lit(" the und est tion th wave thin")))
    add_part(old, path, 0, "doc_id", "text", None, 8, (kind,))
    add_part(docs, path, 1, "doc_id", "text", docs.where("doc_id % 7 = 0"), 8, (kind,))
    none = docs.limit(0)
    add_part(none, path, 2, "doc_id", "text", docs.where("doc_id % 10 = 3"), 8, (kind,))
    return TextIndex(spark, path, 8)


LIVE = BM25.replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 3)", 1)


@query("indexed_bm25", f"WITH {LIVE} SELECT doc_id, round(score, 6) AS score FROM bm")
def indexed_bm25(spark, d):
    return _index(spark, d).bm25(TERMS).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("indexed_groups", f"SELECT doc_id FROM documents WHERE doc_id % 10 <> 3 AND list_has_any({TOK}, ['the', 'le']) AND list_has_any({TOK}, ['on', 'ist'])")
def indexed_groups(spark, d):
    return _index(spark, d).holding([["the", "le"], ["on", "ist"]]).select(F.col("key").alias("doc_id"))


@query("indexed_prefixes", f"SELECT doc_id FROM documents WHERE doc_id % 10 <> 3 AND len(list_filter({TOK}, lambda x: starts_with(x, 'thi'))) > 0 AND len(list_filter({TOK}, lambda x: starts_with(x, 'wa'))) > 0")
def indexed_prefixes(spark, d):
    return _index(spark, d).holding([["thi"], ["wa"]], begins=True).select(F.col("key").alias("doc_id"))


@query("indexed_substring", "SELECT doc_id FROM documents WHERE doc_id % 10 <> 3 AND contains(lower(text), 'tion th')")
def indexed_substring(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return _index(spark, d, "trigrams").containing(docs, "doc_id", "text", "Tion th").select("doc_id")


@query("vector_lists", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT a.vec_id AS asked, b.vec_id, ROW_NUMBER() OVER (PARTITION BY a.vec_id ORDER BY round(-list_cosine_similarity(a.e, b.e), 9), b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10""")
def vector_lists(spark, d):
    e = table(spark, d, "embeddings")
    found = VectorIndex(e, "vec_id", "embedding").search(e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, itself=False)
    return found.select("asked", F.col("key").alias("vec_id"), F.col("rank").cast("long").alias("rank"))


@query("kmeans_sample")
def kmeans_sample(spark, d):
    """The three rows nearest to each of 16 centres; held against the same steps on one machine in the tests."""
    return sampled(table(spark, d, "embeddings"), "vec_id", "embedding", 16).select("vec_id", "centre", F.round("distance", 6).alias("distance"), "rank")


@query("names_in_documents", r"""WITH RECURSIVE c AS (SELECT conv_id * 1000 + turn AS turn_id, regexp_extract_all(lower(COALESCE(text, '')), '[\pL\pN_''-]+') AS ws FROM conversations),
named AS (SELECT array_to_string(ws[1 : n], ' ') AS phrase, n, MIN(turn_id * 4 + n) AS id FROM c, range(2, 5) AS r(n) WHERE len(ws) >= n GROUP BY ALL),
w AS (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[\pL\pN_''-]+') AS ws FROM documents),
runs AS (SELECT doc_id, n, unnest(range(0, len(ws) - n + 1)) AS place, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i : i + n - 1], ' '))) AS phrase FROM w, range(2, 5) AS r(n) WHERE len(ws) >= n),
hits AS (SELECT doc_id, place, runs.n, id, place + runs.n AS stop FROM runs JOIN named USING (phrase) QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id, place ORDER BY runs.n DESC) = 1),
steps AS (SELECT a.doc_id, a.place, a.n, a.id, b.place AS next FROM hits a ASOF LEFT JOIN hits b ON a.doc_id = b.doc_id AND a.stop <= b.place),
chain AS (SELECT * FROM steps QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY place) = 1 UNION ALL SELECT s.* FROM chain JOIN steps s ON s.doc_id = chain.doc_id AND s.place = chain.next)
SELECT doc_id, place, n, id FROM chain""")
def names_in_documents(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("t"), words_of(F.col("text")).alias("ws"))
    n = F.explode(F.array(*(F.lit(k).cast("long") for k in (2, 3, 4)))).alias("n")
    names = c.select("t", "ws", n).where("size(ws) >= n").select((F.col("t") * 4 + F.col("n")).cast("long").alias("id"), F.array_join(F.slice("ws", 1, F.col("n").cast("int")), " ").alias("name"))
    return name_spans(table(spark, d, "documents"), "doc_id", "text", name_table(names, "id", "name")).withColumnsRenamed({"owner": "doc_id", "at": "place"})


@query("tailed_events", """SELECT event_type, COUNT(*) AS n, COUNT(DISTINCT event_id) AS events, SUM(event_id)::BIGINT AS ids FROM events GROUP BY 1""")
def tailed_events(spark, d):
    """Events written as lines in three rounds, with the stream begun anew after each."""
    from memlake.streaming.ingest import work_folder
    from memlake.streaming.tail import tail

    root = work_folder(spark, "tailed")
    lines = table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("value"), "event_id")
    for k in range(3):
        lines.where(F.col("event_id") % 3 == k).select("value").write.text(f"{root}/logs/round={k}")
        stream = tail(spark, [f"{root}/logs"], f"{root}/checkpoint", "part-*", batch_bytes=1 << 26)
        run = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/batch={n}")).option("checkpointLocation", f"{root}/checkpoint").start()
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    got = spark.read.parquet(f"{root}/out").where("kind = 'line'").select(F.from_json("raw", "event_id long, event_type string").alias("e")).select("e.*")
    return got.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.sum("event_id").alias("ids"))


@query("dispatched_state", """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, epoch_us(ts) AS us FROM events),
c AS (SELECT 'c' || k AS chunk_id, arg_max('text ' || event_id, event_id) AS content, arg_max(user_id, event_id) AS user_id, MAX(event_id) AS last, COUNT(*) AS seen_count FROM e WHERE event_type IN ('view', 'click') GROUP BY 1),
n AS (SELECT 'c' || k AS chunk_id, arg_max('about ' || event_id, event_id) AS summary FROM e WHERE event_type = 'purchase' GROUP BY 1)
SELECT chunk_id, content, seen_count, summary, EXISTS (SELECT 1 FROM e WHERE event_type = 'error' AND e.user_id = c.user_id AND e.event_id > last AND last > e.event_id - 300) AS archived FROM c LEFT JOIN n USING (chunk_id)""")
def dispatched_state(spark, d):
    """Events as those of a queue in two batches, each put twice and the later one first: what they leave."""
    from memlake.streaming import dispatch
    from memlake.streaming.ingest import work_folder

    root, id_ = work_folder(spark, "dispatched"), F.col("event_id")
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    kind = F.expr(f"case event_type when 'purchase' then '{dispatch.ENRICHMENT}' when 'error' then '{dispatch.REWIND}' when 'signup' then 'unknown' else '{dispatch.WATCHER}' end")
    file = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    fields = {"kind": kind, "chunk_id": F.concat(F.lit("c"), "k"), "content": F.concat(F.lit("text "), id_.cast("string")), "source_file": file, "source_end_offset": id_, "summary": F.concat(F.lit("about "), id_.cast("string")),
              "old_offset": id_, "new_offset": F.greatest(id_ - 300, F.lit(0))}
    line = F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    tailed = e.select(F.lit("queue").alias("file"), F.lit(0).alias("generation"), F.lit("line").alias("kind"), id_.alias("first"), id_.alias("last"), line.alias("raw"))
    half = (e.agg(F.max("event_id")).first()[0] or 0) // 2
    for number in (1, 0, 1, 0):
        dispatch.put(dispatch.parsed(tailed.where((F.col("first") > half) == bool(number))), number, f"{root}/queue")
    return dispatch.state(spark, f"{root}/queue").select("chunk_id", "content", "seen_count", "summary", "archived")
