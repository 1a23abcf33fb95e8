"""Knowledge graph: neighbours, traversal, resolution, importance, fading, co-mentions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.scores import FADING, faded_fact
from memlake.functions.text import STOP_WORDS
from memlake.operators.joins import normal_key, pairs_within
from memlake.storage import materialize


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """neighbour, relation_type, direction of a node's edges both ways."""
    out = edges.where(F.col("source_id") == node).select(F.col("target_id").alias("neighbour"), "relation_type", F.lit("out").alias("direction"))
    return out.union(edges.where(F.col("target_id") == node).select("source_id", "relation_type", F.lit("in")))


def traverse(edges: DataFrame, start: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """start, id, depth: what outgoing edges reach in 1 to `depth` steps on a path that meets no node twice; one row for each depth.

    start: id. The edges and what each step reaches are written once, so no
    step is computed again for the next. Edges that can be the second, third and
    further ones of a walk are told apart first: where walks end within `depth`
    edges, there is no cycle, and steps need no paths.
    """
    own = edges.where(F.col("relation_type").isin(*types)) if types else edges
    own = own.where("source_id is not null and target_id is not null").select("source_id", "target_id")
    later = [materialize(own, "edges")]
    n = None
    while len(later) <= depth and n != 0:
        ends = materialize(later[-1].select(F.col("target_id").alias("source_id")).distinct(), "ends")
        later.append(materialize(later[-1].join(ends, "source_id", "left_semi"), "later"))
        last, n = n, later[-1].count()
        if n == last:  # all that is left is on cycles or behind them
            break
    found = []
    if n == 0:
        reached = start.select(F.col("id").alias("start"), "id")
        for own in later[:-1]:
            reached = reached.join(own, reached.id == own.source_id).select("start", F.col("target_id").alias("id")).distinct()
            found.append(materialize(reached, f"step-{len(found) + 1}"))
            reached = found[-1]
        found = [x.withColumn("depth", F.lit(k).cast("long")) for k, x in enumerate(found, 1)]
        return reduce(DataFrame.union, found)
    own = materialize(later[0].distinct(), "edges")
    reached = start.select(F.col("id").alias("start"), "id", F.array("id").alias("path"))
    for n in range(1, depth + 1):
        reached = reached.join(own, reached.id == own.source_id).where(~F.array_contains("path", F.col("target_id"))).select(
            "start", F.col("target_id").alias("id"), F.array_append("path", F.col("target_id")).alias("path")
        )
        reached = materialize(reached, f"step-{n}")
        found.append(reached.select("start", "id", F.lit(n).cast("long").alias("depth")))
    return reduce(DataFrame.union, found).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def importance(links: Column, mean: Column, relations: Column) -> Column:
    return F.log2(1 + links) * (mean / 10) * (1 + 0.1 * relations)


def faded(edges: DataFrame, days: Column, kind: str) -> Column:
    rate = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in FADING.items() for x in kv)), F.col(kind)), F.lit(FADING["preference"]))
    return faded_fact(F.col("confidence"), F.col("importance"), days, rate)


def resolve(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked, id, stage: the first of exact name, alias, normal key that finds an entity; ties to the smaller id.

    names: asked; entities: id, name; aliases: alias, id.
    """
    exact = names.join(entities, F.lower("asked") == F.lower("name")).select("asked", "id", F.lit(1).alias("stage"))
    alias = names.join(aliases, F.lower("asked") == F.lower("alias")).select("asked", "id", F.lit(2))
    key = names.join(entities, normal_key("asked") == normal_key("name")).select("asked", "id", F.lit(3))
    w = Window.partitionBy("asked").orderBy("stage", "id")
    return exact.union(alias).union(key).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def co_mentions(mentions: DataFrame, kind: Column | None = None) -> DataFrame:
    """a, b, n: entities that chunks mention together; with `kind`, a column made of entity_id, those of two kinds."""
    return pairs_within(mentions, "chunk_id", "entity_id", kind=kind)


def health(required: Column, expected: Column, relations: Column, chunks: Column, days: Column) -> Column:
    """Score from 0 to 1 of an entity against its contract; all parts but the days are shares from 0 to 1, unknown days count half."""
    fresh = F.coalesce(F.pow(F.lit(0.5), days / 90), F.lit(0.5))
    return F.round(0.40 * required + 0.25 * expected + 0.15 * F.least(relations, F.lit(1.0)) + 0.10 * F.least(chunks, F.lit(1.0)) + 0.10 * fresh, 4)


def preferred(variants: DataFrame, keys: list[str]) -> DataFrame:
    """The variant of each group with most relations, then chunks, then a capital, then the smallest id."""
    order = [F.desc("relations"), F.desc("chunks"), F.desc(F.col("name").rlike("[A-Z]")), "id"]
    return variants.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def merged_edges(edges: DataFrame, order: str) -> DataFrame:
    """The latest state of each (source, target, type): confidence is replaced, the rest keeps its last known value."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return edges.groupBy("source_id", "target_id", "relation_type").agg(F.max_by("confidence", order).alias("confidence"), last("importance"), last("valid_from"))


def support(entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """id, relations, chunks: edges at either end and mentions of each entity; 0 where there are none."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.where("source_id <> target_id").select("target_id")).groupBy("id").agg(F.count("*").alias("relations"))
    seen = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("chunks"))
    return entities.select("id").join(ends, "id", "left").join(seen, "id", "left").fillna(0, ["relations", "chunks"])


def sounding_like(names: DataFrame, aliases: DataFrame, key: str = "key") -> DataFrame:
    """asked, id, score: for each name the entity whose alias shares most of its sounds; ties to the smaller id.

    names: asked and `key`, its distinct sounds as an array; aliases: id and
    `key`. The score is shared by all sounds, 1 for the same. Names meet aliases
    by a sound in common; what they share is counted, no pair is made twice.
    """
    n = names.select("asked", F.size(key).alias("_x"), F.explode(key).alias("_s"))
    a = aliases.withColumn("_alias", F.monotonically_increasing_id()) if "alias" not in aliases.columns else aliases.withColumn("_alias", F.col("alias"))
    a = a.select("id", "_alias", F.size(key).alias("_y"), F.explode(key).alias("_s"))
    shared = n.join(a, "_s").groupBy("asked", "id", "_alias", "_x", "_y").agg(F.count("*").alias("_n"))
    scored = shared.groupBy("asked", "id").agg(F.max(F.col("_n") / (F.col("_x") + F.col("_y") - F.col("_n"))).alias("score"))
    best = scored.groupBy("asked").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    return best.select("asked", "b.id", (-F.col("b.s")).alias("score"))


def merge_mentions(mentions: DataFrame, merges: DataFrame, context: str) -> DataFrame:
    """entity_id, chunk_id, relevance, `context` after entities were merged; merges: merge_id, keep_id (one hop).

    Links that come together keep the largest relevance and the context of the
    most relevant link that has one (ties: the kept entity's own does not win).
    """
    moved = mentions.join(merges, mentions.entity_id == merges.merge_id, "left").select(F.coalesce("keep_id", "entity_id").alias("entity_id"), "chunk_id", "relevance", context, F.col("keep_id").isNotNull().alias("_moved"))
    order = F.when(F.col(context).isNotNull(), F.struct(F.coalesce("relevance", F.lit(0.0)), "_moved", context))
    return moved.groupBy("entity_id", "chunk_id").agg(F.max("relevance").alias("relevance"), F.max_by(context, order).alias(context))


def merge_edges(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """source_id, target_id, relation_type, confidence, importance after entities were merged: the strongest of edges that come together; edges of a node to itself go."""
    to = lambda c: merges.select(F.col("merge_id").alias(c), F.col("keep_id").alias(f"_{c}"))
    moved = edges.join(to("source_id"), "source_id", "left").join(to("target_id"), "target_id", "left")
    moved = moved.select(F.coalesce("_source_id", "source_id").alias("source_id"), F.coalesce("_target_id", "target_id").alias("target_id"), "relation_type", "confidence", "importance")
    return moved.where("source_id <> target_id").groupBy("source_id", "target_id", "relation_type").agg(F.max("confidence").alias("confidence"), F.max("importance").alias("importance"))


def promoted_tags(tags: DataFrame, session: str, least: int, sessions: int) -> DataFrame:
    """tag, n, sessions, entity_id of tags in use often enough, in enough sessions, to be entities; tags: chunk_id, tag, the session."""
    often = tags.where("tag is not null").groupBy("tag").agg(F.countDistinct("chunk_id").alias("n"), F.countDistinct(session).alias("sessions"))
    slug = F.regexp_replace(F.regexp_replace(F.lower("tag"), "[^a-z0-9]+", "-"), "^-|-$", "")
    return often.where((F.col("n") >= least) & (F.col("sessions") >= sessions)).withColumn("entity_id", F.concat(F.lit("auto-tag-"), slug))


def superseded_only(facts: DataFrame) -> DataFrame:
    """entity_id, chunk_id: chunks that stand for superseded facts of an entity and for none that is active.

    facts: entity_id, status, superseded_by, chunk_ids. A superseded fact without a successor just vanished and does not count.
    """
    each = facts.where("status = 'active' or (status = 'superseded' and superseded_by is not null)").select("entity_id", "status", F.explode("chunk_ids").alias("chunk_id"))
    return each.groupBy("entity_id", "chunk_id").agg(F.bool_or(F.col("status") == "active").alias("on")).where("not on").select("entity_id", "chunk_id")


def refreshed_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """entity_id, fact, change, against: what a fresh list of facts makes of the active ones.

    old: entity_id, fact (active); new: entity_id, fact. change: kept, vanished,
    new, or conflict, where a new fact shares two or more telling words with
    active ones (against: the smallest of these with most words shared).
    """
    words = F.filter(F.array_distinct(F.regexp_extract_all(F.lower("fact"), F.lit("[a-z0-9]+"), F.lit(0))), lambda t: ~t.isin(*STOP_WORDS))
    o, n = old.select("entity_id", "fact").distinct(), new.select("entity_id", "fact").distinct()
    both = o.withColumn("o", F.lit(True)).join(n.withColumn("n", F.lit(True)), ["entity_id", "fact"], "full")
    fresh = both.where("o is null").select("entity_id", "fact", F.explode(words).alias("w"))
    held = o.select("entity_id", F.col("fact").alias("against"), F.explode(words).alias("w"))
    shared = fresh.join(held, ["entity_id", "w"]).groupBy("entity_id", "fact", "against").agg(F.count("*").alias("c")).where("c >= 2")
    clash = shared.groupBy("entity_id", "fact").agg(F.min(F.struct((-F.col("c")).alias("c"), "against"))["against"].alias("against"))
    change = F.when(F.col("o") & F.col("n"), "kept").when(F.col("o"), "vanished").when(F.col("against").isNotNull(), "conflict").otherwise("new")
    return both.join(clash, ["entity_id", "fact"], "left").select("entity_id", "fact", change.alias("change"), "against")
