"""Upkeep of stored memories: backlogs, orphans, merges of texts, aliases and names, clean relations, watched sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.storage import materialize

#: Clusters that a row is compared with at a time.
CLUSTERS = 512

from memlake.functions.scores import half_life
from memlake.functions.text import content_hash, entity_key


def alias_groups(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """canonical, member: each entity with itself and with those of its type whose name is one of its aliases in any case.

    entities: id, entity_type, name; aliases: id, alias.
    """
    named = entities.select(F.col("id").alias("member"), "entity_type", F.lower("name").alias("_n"))
    own = aliases.select("id", F.lower("alias").alias("_n")).join(entities.select("id", "entity_type"), "id")
    found = own.join(named, ["entity_type", "_n"]).select(F.col("id").alias("canonical"), "member")
    return entities.select(F.col("id").alias("canonical"), F.col("id").alias("member")).union(found).distinct()


def group_mentions(groups: DataFrame, mentions: DataFrame) -> DataFrame:
    """canonical, chunks: different chunks that mention any member of a group; 0 for none. mentions: entity_id, chunk_id."""
    seen = groups.join(mentions, groups.member == mentions.entity_id).groupBy("canonical").agg(F.countDistinct("chunk_id").alias("chunks"))
    return groups.select("canonical").distinct().join(seen, "canonical", "left").fillna(0, ["chunks"])


def alias_mentions(entities: DataFrame, aliases: DataFrame, mentions: DataFrame) -> DataFrame:
    """canonical, chunks: as `group_mentions` of `alias_groups`, without a row for each member of each entity.

    Entities whose aliases are the same names have the same members but for
    themselves, so that chunks are counted once for each set of names; what an
    entity has beyond that is what mentions it alone. Chunks of a name come
    together before names meet sets, so entities of one name make no pairs.
    """
    named = entities.select("id", F.struct("entity_type", F.lower("name").alias("n")).alias("_n"))
    own = aliases.join(entities.select("id", "entity_type"), "id").where("alias is not null").select("id", F.struct("entity_type", F.lower("alias").alias("n")).alias("_n"))
    sets = materialize(own.groupBy("id").agg(F.array_sort(F.collect_set("_n")).alias("_names")), "alias-sets")
    names = materialize(sets.select("_names").distinct().withColumn("_c", F.monotonically_increasing_id()), "names")
    asked = sets.join(names, "_names").select("id", "_names", "_c")
    each = names.select("_c", F.explode("_names").alias("_n"))
    seen = mentions.where("chunk_id is not null").select(F.col("entity_id").alias("id"), "chunk_id")
    heard = named.join(each.select("_n").distinct(), "_n", "left_semi").join(seen, "id").select("_n", "chunk_id").distinct()
    heard = materialize(heard.join(each, "_n").select("_c", "chunk_id").distinct(), "heard")
    # entities that are no members of their own set add the chunks that the set has not
    inside = entities.join(asked, "id", "left").select("id", "_c", F.coalesce(F.array_contains("_names", F.struct("entity_type", F.lower("name").alias("n"))), F.lit(False)).alias("_in"))
    alone = inside.groupBy("id").agg(F.max("_c").alias("_c"), F.bool_or("_in").alias("_in")).where("not _in")
    extra = alone.join(seen, "id").distinct().join(heard, ["_c", "chunk_id"], "left_anti").groupBy("id").agg(F.count("*").alias("_x"))
    common = asked.select("id", "_c").join(heard.groupBy("_c").agg(F.count("*").alias("_y")), "_c")
    total = entities.select("id").distinct().join(extra, "id", "left").join(common, "id", "left")
    return total.select(F.col("id").alias("canonical"), (F.coalesce("_x", F.lit(0)) + F.coalesce("_y", F.lit(0))).cast("long").alias("chunks"))


def by_alias(asked: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """asked, id, name of the entities that an alias in any case leads to. asked: asked; aliases: id, alias."""
    return asked.join(aliases, F.lower("asked") == F.lower("alias")).select("asked", "id").distinct().join(entities.select("id", "name"), "id")


def shown_events(events: DataFrame, key: str, ids: str, chunks: DataFrame, hidden: Column) -> DataFrame:
    """Keys of events that name no chunk, or one at least that is there and not hidden. chunks: chunk_id and what `hidden` reads."""
    known = chunks.select("chunk_id", (~F.coalesce(hidden, F.lit(False))).alias("_on")).groupBy("chunk_id").agg(F.bool_or("_on").alias("_on"))
    each = events.select(key, F.explode_outer(ids).alias("chunk_id")).join(known, "chunk_id", "left")
    return each.groupBy(key).agg(F.bool_or(F.col("chunk_id").isNull() | F.coalesce("_on", F.lit(False))).alias("_s")).where("_s").select(key)


def backlog(df: DataFrame, group: str, done: Column, stale: Column) -> DataFrame:
    """group, rows, done, open, again: how much of each group is enriched, waits, or is to be done again."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(done).alias("done"), F.count_if(~done).alias("open"), F.count_if(done & stale).alias("again"))


def unvectored(base: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """key, side: rows without a vector (`open`) and vectors without a row (`orphan`)."""
    one = base.join(vectors.select(key), key, "left_anti").select(key, F.lit("open").alias("side"))
    return one.union(vectors.join(base.select(key), key, "left_anti").select(key, F.lit("orphan")))


def merged_text(df: DataFrame, group: str, key: str, content: str, mark: str = "[merged]") -> DataFrame:
    """group, content of texts that were found to be duplicates: the first as it is if all say the same, else the first, a mark and the others numbered.

    Texts that differ in spaces and case say the same; one of each (of the
    smallest key) is listed. Copies meet before texts are gathered, so a group
    of copies of any size is one row by then.
    """
    plain = F.lower(F.trim(F.regexp_replace(content, r"\s+", " ")))
    one = df.where(F.col(content).isNotNull()).groupBy(group, plain.alias("_p")).agg(F.min(F.struct(key, content)).alias("_x"))
    listed = F.transform(F.array_sort(F.collect_list("_x")), lambda x: x[content])
    numbered = F.transform(F.slice(F.col("_l"), 2, 1 << 30), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    all_of = F.concat(F.col("_l")[0], F.lit(f"\n\n{mark}\n"), F.array_join(numbered, "\n"))
    return one.groupBy(group).agg(listed.alias("_l")).select(group, F.when(F.size("_l") == 1, F.col("_l")[0]).otherwise(all_of).alias("content"))


def known_content(new: DataFrame, done: DataFrame, content: str) -> DataFrame:
    """New rows whose content hash a finished row has, so that nothing is to be done for them."""
    return new.withColumn("_h", content_hash(F.col(content))).join(done.select(content_hash(F.col(content)).alias("_h")), "_h", "left_semi").drop("_h")


def with_decay_fields(df: DataFrame, tags: str, pinned: list[str]) -> DataFrame:
    """`df` with pinned and half_life (days, by importance), for rows that have none yet: columns that are there and not null stay."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    held = F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), F.array(*map(F.lit, pinned)))
    return df.withColumns({"pinned": F.coalesce(has("pinned").cast("boolean"), held, F.lit(False)), "half_life": F.coalesce(has("half_life").cast("double"), half_life(F.col("importance")))})


def numeric_project(project: str) -> Column:
    """Whether a project's name is one or two digits alone, as misread paths give."""
    return F.coalesce(F.col(project).rlike("^[0-9]{1,2}$"), F.lit(False))


def headline(content: str) -> Column:
    """The first line that is not blank, in lower case, without marks around it."""
    first = F.regexp_extract(F.coalesce(F.col(content), F.lit("")), r"^\s*([^\n]*)", 1)
    return F.regexp_replace(F.lower(F.trim(first)), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def quarantine_reason(content: str, key: str, tags: str, headlines: list[str], prefixes: list[str], marks: list[str]) -> Column:
    """headline, id or tag: why a chunk may be noise, in this order; null if it is none."""
    by_id = reduce(lambda a, b: a | b, (F.col(key).startswith(p) for p in prefixes), F.lit(False))
    return F.when(headline(content).isin(*headlines), "headline").when(by_id, "id").when(F.arrays_overlap(tags, F.array(*map(F.lit, marks))), "tag")


def name_plan(entities: DataFrame) -> DataFrame:
    """id, plan, into: what becomes of entities by their names: junk (no letters, or one), merge into the entity of its type and key with most support, or keep.

    entities: id, entity_type, name, support; ties go to the smaller id.
    """
    keyed = entities.withColumn("_k", entity_key(F.col("name")))
    junk = (F.length("_k") < 2) | ~F.col("_k").rlike(r"\p{L}")
    best = keyed.where(~junk).groupBy("entity_type", "_k").agg(F.min(F.struct((-F.col("support")).alias("s"), "id"))["id"].alias("_best"))
    rows = keyed.join(best, ["entity_type", "_k"], "left")
    plan = F.when(F.col("_best").isNull(), "junk").when(F.col("_best") == F.col("id"), "keep").otherwise("merge")
    return rows.select("id", plan.alias("plan"), F.when(plan == "merge", F.col("_best")).alias("into"))


def valid_relations(found: DataFrame, kinds: dict[str, str], inverse: dict[str, str]) -> DataFrame:
    """source_id, target_id, relation_type of extracted relations: types in their one form, the passive ones turned round, loops and blanks gone, each once.

    kinds: other spellings of types; inverse: types that say an active one from the other end.
    """
    flat = F.regexp_replace(F.lower(F.trim("relation_type")), r"[\s-]+", "_")
    of = lambda m, c: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), c)
    rows = found.withColumn("_t", F.coalesce(of(kinds, flat), flat)).withColumn("_i", of(inverse, F.col("_t")))
    turned = F.col("_i").isNotNull()
    made = rows.select(
        F.when(turned, F.col("target_id")).otherwise(F.col("source_id")).alias("source_id"), F.when(turned, F.col("source_id")).otherwise(F.col("target_id")).alias("target_id"),
        F.coalesce("_i", "_t").alias("relation_type"),
    )
    return made.where("source_id <> target_id and relation_type <> ''").distinct()


def retargeted(aliases: DataFrame, merges: DataFrame) -> DataFrame:
    """old_id, new_id of aliases after more merges: those that led to a merged id lead on to what it became, and merged ids are aliases too; one hop, none to itself."""
    m = merges.select(F.col("old_id").alias("_o"), F.col("new_id").alias("_n"))
    moved = aliases.join(m, aliases.new_id == m["_o"], "left").select("old_id", F.coalesce("_n", "new_id").alias("new_id"))
    # a merged id that was an alias before now leads where the later merge says
    kept = moved.join(merges.select("old_id"), "old_id", "left_anti")
    return kept.union(merges.select("old_id", "new_id")).where("old_id <> new_id").distinct()


def plan_of(sessions: DataFrame, by_branch: DataFrame, by_request: DataFrame) -> DataFrame:
    """`sessions` with plan and matched_by: the plan of its pull request, else of its branch. by_branch: branch, plan; by_request: request, plan; each key once."""
    rows = sessions.join(by_request.select("request", F.col("plan").alias("_r")), "request", "left").join(by_branch.select("branch", F.col("plan").alias("_b")), "branch", "left")
    how = F.when(F.col("_r").isNotNull(), "request").when(F.col("_b").isNotNull(), "branch")
    return rows.select(*(rows[c] for c in sessions.columns), F.coalesce("_r", "_b").alias("plan"), how.alias("matched_by"))


def frustrated_then(turns: DataFrame, scope: str, position: str, feeling: str, within: int) -> DataFrame:
    """scope, angry, calm, gap: each frustrated turn with the first one after it in the scope that is not, if at most `within` positions later.

    Only positions are compared, in one pass over a scope's turns from its last to its first.
    """
    after = Window.partitionBy(scope).orderBy(F.desc(position)).rowsBetween(Window.unboundedPreceding, -1)
    calm = F.last(F.when(F.col(feeling) != "frustration", F.col(position)), ignorenulls=True).over(after)
    rows = turns.select(scope, F.col(position).alias("angry"), calm.alias("calm"), feeling).where(F.col(feeling) == "frustration")
    return rows.withColumn("gap", F.col("calm") - F.col("angry")).where(F.col("gap") <= within).select(scope, "angry", "calm", "gap")


def late_spans(samples: DataFrame, source: str, us: str, lag: str, limit: float, lasting: int) -> DataFrame:
    """source, began, ended, worst: spans of samples whose lag is over the limit all the time, for `lasting` seconds at least."""
    w = Window.partitionBy(source).orderBy(us)
    late = samples.where(F.col(us).isNotNull()).withColumn("_late", F.coalesce(F.col(lag) > limit, F.lit(False)))
    spans = late.withColumn("_span", F.count_if(~F.col("_late")).over(w)).where("_late")
    out = spans.groupBy(source, "_span").agg(F.min(us).alias("began"), F.max(us).alias("ended"), F.max(lag).alias("worst"))
    return out.where(F.col("ended") - F.col("began") >= lasting * 1_000_000).select(source, "began", "ended", "worst")


def still_wanted(events: DataFrame, state: DataFrame, key: str, version: str) -> DataFrame:
    """Enrichment events that are not older than what is stored: unknown keys and newer versions; of one key the newest."""
    held = state.groupBy(key).agg(F.max(version).alias("_v"))
    fresh = events.join(held, key, "left").where(F.col("_v").isNull() | (F.col(version) > F.col("_v"))).drop("_v")
    return fresh.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_r = 1").drop("_r")


def silhouette(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """key, label, silhouette by cosine distance, exact and over all rows; 0 in a cluster of one. Zero and null vectors are left out.

    The mean cosine distance to a cluster is 1 less the dot product with the
    mean of its unit vectors, so that rows are compared with clusters' sums,
    not with rows: with `CLUSTERS` of them at a time, each such block a row.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(key, label, F.transform(vector, lambda x: x.cast("double") / F.nullif(norm, F.lit(0.0))).alias("_u"), norm.alias("_norm")).where("_norm > 0").drop("_norm")
    parts = unit.select(label, F.posexplode("_u").alias("p", "x")).groupBy(label, "p").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = parts.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("s"))
    blocks = max(1, -(-sums.count() // CLUSTERS))
    every = materialize(sums.groupBy(F.pmod(F.xxhash64(label), F.lit(blocks)).cast("int").alias("_b")).agg(F.collect_list(F.struct(F.col(label).alias("l"), "n", "s")).alias("_c")), "clusters")
    dealt = unit.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(F.broadcast(every) if blocks <= 16 else every, "_b")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    seen = dealt.withColumn("_d", F.transform("_c", lambda c: F.struct(c["l"].alias("l"), c["n"].alias("n"), dot(F.col("_u"), c["s"]).alias("d"))))
    own = F.filter("_d", lambda x: x["l"] == F.col(label))[0].alias("own")
    near = F.array_min(F.transform(F.filter("_d", lambda x: x["l"] != F.col(label)), lambda x: 1 - x["d"] / x["n"])).alias("b")
    parts = seen.select(key, label, own, near)
    if blocks > 1:  # rows that share a key and a label have one value
        parts = parts.groupBy(key, label).agg(F.max("own").alias("own"), F.min("b").alias("b"))
    own, b = F.col("own"), F.col("b")
    a = 1 - (own["d"] - 1) / F.nullif(own["n"] - 1, F.lit(0))
    # rounded, so that two distances that are equal but for the last bits stay so
    a, b = F.round(a, 9), F.round(b, 9)
    value = F.when((own["n"] < 2) | b.isNull() | (F.greatest(a, b) == 0), 0.0).otherwise((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)))
    return parts.select(key, label, value.alias("silhouette"))
