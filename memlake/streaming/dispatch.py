"""Dispatch of queued events by kind, and the state that they make.

A batch of events is written once, in parts by kind, under its own number: a
batch that runs again replaces its part, so replays change nothing. No batch
rewrites the state; it is the fold of all parts, each key by itself, and
`compacted` writes it down so that older parts need not be read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of events.
STORE, WATCHER, HOOK, ENRICHMENT, REWIND = "store_memory", "watcher_chunk", "hook_chunk", "enrichment_update", "rewind_archive"
#: What rows of each kind are called by their source, and the type of content if an event names none.
SOURCES = {STORE: "manual", WATCHER: "realtime_watcher", HOOK: "realtime"}
REJECTED = "rejected"
#: Times that a batch is tried.
TRIES = 3

EVENT = (
    "kind string, chunk_id string, content string, source_file string, conversation_id string, session_id string, content_type string, tags array<string>, "
    "created_at string, queued_at double, source_end_offset long, content_hash string, summary string, importance double, old_offset long, new_offset long, rewind_detected_at double"
)


def parsed(tailed: DataFrame) -> DataFrame:
    """Tailed lines as events with why: what is wrong with a line, or null. Rewinds of files become events that archive what was read past the new end."""
    e = F.from_json("raw", EVENT)
    rewind = F.struct(
        F.lit(REWIND).alias("kind"), *(F.lit(None).cast("string").alias(c) for c in ("chunk_id", "content")), F.col("file").alias("source_file"),
        *(F.lit(None).cast(t).alias(c) for c, t in (x.rsplit(" ", 1) for x in EVENT.split(", ")[4:14])),
        F.col("first").alias("old_offset"), F.col("last").alias("new_offset"), F.lit(None).cast("double").alias("rewind_detected_at"),
    )
    fields = F.when(F.col("kind") == "rewind", rewind).otherwise(e)
    place = F.struct("generation", "first").alias("place")
    why = F.when(F.col("kind") == "oversized", "oversized").when((F.col("kind") == "line") & (e.isNull() | e["kind"].isNull()), "no event")
    return tailed.select("file", place, "raw", why.alias("why"), fields.alias("_e")).select("file", "place", "raw", "why", "_e.*")


def checked(events: DataFrame) -> DataFrame:
    """Events with content trimmed, chunk_id (of those that name none, from what they hold), hash of the content, and why they are rejected."""
    content = F.trim(F.coalesce("content", F.lit("")))
    digest = F.sha2(content, 256)
    kind = F.col("kind")
    session = F.coalesce("session_id", F.lit("unknown"))
    made = F.when(kind == STORE, F.concat(F.lit("manual-"), F.substring(digest, 1, 16))).when(
        kind == HOOK, F.concat(F.lit("rt-"), F.substring(session, 1, 8), F.lit("-"), F.substring(F.coalesce("content_hash", digest), 1, 16))
    )
    key = F.coalesce("chunk_id", made)
    bounds = F.coalesce((F.col("old_offset") > F.col("new_offset")) & (F.col("new_offset") >= 0) & (F.trim("source_file") != ""), F.lit(False))
    why = (
        F.when(F.col("why").isNotNull(), F.col("why")).when(kind.isin(*SOURCES) & (content == ""), "empty content")
        .when(kind.isin(WATCHER, ENRICHMENT) & key.isNull(), "no chunk_id").when((kind == REWIND) & ~bounds, "bad bounds").when(~kind.isin(*SOURCES, ENRICHMENT, REWIND), "unknown kind")
    )
    expected = F.when(kind == ENRICHMENT, F.col("content_hash")).when(kind.isin(*SOURCES), digest)
    return events.withColumns({
        "why": why, "chunk_id": key, "content": F.when(kind.isin(*SOURCES), content), "content_hash": expected,
        "conversation_id": F.when(kind == HOOK, session).otherwise(F.col("conversation_id")),
    })


def put(events: DataFrame, number: int, root: str, tries: int = TRIES) -> None:
    """Write a batch's events, in parts by kind, under its number; tried again up to `tries` times in all."""
    routed = checked(events).withColumn("route", F.when(F.col("why").isNull(), F.col("kind")).otherwise(REJECTED))
    for left in range(tries - 1, -1, -1):
        try:
            routed.write.mode("overwrite").partitionBy("route").parquet(f"{root}/batch={number}")
            return
        except Exception:
            if not left:
                raise


def run(stream: DataFrame, root: str, checkpoint: str, most: Callable[[DataFrame], DataFrame] = lambda x: x) -> None:
    """Take what there is in the stream into `root`, until nothing new comes."""
    query = stream.writeStream.foreachBatch(lambda batch, number: put(most(parsed(batch)), number, root)).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def events_of(spark: SparkSession, root: str, route: str) -> DataFrame:
    """The events of a route with the number of their batch."""
    return spark.read.option("basePath", root).parquet(root).where(F.col("route") == route)


def state(spark: SparkSession, root: str, base: DataFrame | None = None) -> DataFrame:
    """chunk_id, content, content_hash, source, source_file, conversation_id, content_type, tags, created_at, first_seen, seen_count, summary, importance, archived.

    Of several events of one chunk the last one (by batch, generation and
    place in its file) counts; seen_count is how many there were. An enrichment
    counts if it was made for the content as it is now or names no content; the
    last such one. A rewind archives the watcher's chunks of its file (and
    conversation, if it names one) that end after the new end and up to the old
    one and came before it. base: what `compacted` wrote, of batches that are
    no longer read.
    """
    every = spark.read.option("basePath", root).parquet(root)
    order = F.struct("batch", "place", "file")
    sources = F.create_map(*(F.lit(x) for kv in SOURCES.items() for x in kv))
    kept = ["content", "content_hash", "source", "source_file", "conversation_id", "content_type", "tags", "created_at", "source_end_offset", "queued_at"]
    stored = every.where(F.col("route").isin(*SOURCES)).withColumns({"source": sources[F.col("kind")], "_o": order, "_n": F.lit(1).cast("long"), "content_type": F.coalesce("content_type", F.lit("assistant_text"))})
    stored = stored.select("chunk_id", *kept, "_o", "_n", F.col("created_at").alias("first_seen"))
    if base is not None:
        stored = stored.unionByName(base.select("chunk_id", *kept, "_o", F.col("seen_count").alias("_n"), "first_seen"))
    chunks = stored.groupBy("chunk_id").agg(F.max_by(F.struct(*kept), "_o").alias("_s"), F.max("_o").alias("_o"), F.sum("_n").alias("seen_count"), F.min("first_seen").alias("first_seen"))
    chunks = chunks.select("chunk_id", "_s.*", "_o", "seen_count", "first_seen")
    updates = every.where(F.col("route") == ENRICHMENT).select("chunk_id", F.col("content_hash").alias("_h"), "summary", "importance", order.alias("_at"))
    if base is not None:
        updates = updates.unionByName(base.where("_at is not null").select("chunk_id", F.col("content_hash").alias("_h"), "summary", "importance", "_at"))
    fresh = updates.join(chunks.select("chunk_id", "content_hash"), "chunk_id").where("_h is null or _h = content_hash")
    enriched = fresh.groupBy("chunk_id").agg(F.max_by(F.struct("summary", "importance", "_at"), "_at").alias("_e")).select("chunk_id", "_e.*")
    rewinds = every.where(F.col("route") == REWIND).select(
        F.col("source_file").alias("_f"), F.col("conversation_id").alias("_c"), "old_offset", "new_offset", "rewind_detected_at", order.alias("_r")
    )
    past = (
        (F.col("source_file") == F.col("_f")) & (F.col("source") == SOURCES[WATCHER]) & (F.col("_c").isNull() | (F.col("_c") == F.col("conversation_id")))
        & (F.col("source_end_offset") > F.col("new_offset")) & (F.col("source_end_offset") <= F.col("old_offset"))
        & (F.col("rewind_detected_at").isNull() | F.col("queued_at").isNull() | (F.col("queued_at") <= F.col("rewind_detected_at"))) & (F.col("_o") < F.col("_r"))
    )
    gone = chunks.join(rewinds, past, "left_semi").select("chunk_id", F.lit(True).alias("_gone"))
    if base is not None:  # what comes again after its rewind is there again
        gone = gone.union(chunks.join(base.where("archived").select("chunk_id", F.col("_o").alias("_b")), "chunk_id").where("_o = _b").select("chunk_id", F.lit(True))).distinct()
    out = chunks.join(enriched, "chunk_id", "left").join(gone, "chunk_id", "left")
    return out.select("chunk_id", *kept, "first_seen", "seen_count", "summary", "importance", F.coalesce("_gone", F.lit(False)).alias("archived"), "_o", "_at")


def compacted(spark: SparkSession, root: str, out: str, base: DataFrame | None = None) -> DataFrame:
    """The state, written to `out`; the batches that it holds can then be removed."""
    state(spark, root, base).write.parquet(out)
    return spark.read.parquet(out)
