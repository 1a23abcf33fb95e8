"""Full-text search over postings: BM25, term modes, prefixes, trigrams, rank fusion, fan-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.scores import ALPHA, K, damped
from memlake.functions.text import instant, tokens
from memlake.storage import materialize


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, size: how often each term is in a text, and the text's number of tokens."""
    split = df.select(key, tokens(F.col(text)).alias("t")).withColumn("size", F.size("t"))
    return split.select(F.explode("t").alias("term"), key, "size").groupBy("term", key, "size").agg(F.count("*").alias("tf"))


def bm25(df: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """key, score of the rows with a term and a score over 0; idf is ln((N - df + 0.5) / (df + 0.5)).

    Texts are split once: each row's size and counts of the asked terms are
    written, and the totals and the scores read these few numbers. Scores
    need no exchange by key; rows that share a key are texts of their own.
    """
    asked = list(dict.fromkeys(terms))
    split = df.select(key, tokens(F.col(text)).alias("t"))
    count = lambda term: F.size(F.filter("t", lambda x: x == term))
    counted = materialize(split.select(F.col(key), F.size("t").alias("_size"), *(count(t).alias(f"_c{n}") for n, t in enumerate(asked))), "counts")
    totals = counted.agg(F.count("*").alias("n"), F.avg("_size").alias("mean"), *(F.count_if(F.col(f"_c{n}") > 0).alias(f"d{n}") for n in range(len(asked))))
    x = totals.select(F.struct("*").alias("x")).scalar()

    def part(n: int) -> Column:
        idf = F.log((F.col("_x.n") - F.col(f"_x.d{n}") + 0.5) / (F.col(f"_x.d{n}") + 0.5))
        c = F.col(f"_c{n}")
        return F.when(c > 0, idf * (c * (k1 + 1) / (c + k1 * (1 - b + b * F.col("_size") / F.col("_x.mean"))))).otherwise(0.0)

    found = counted.where(reduce(lambda l, r: l | r, (F.col(f"_c{n}") > 0 for n in range(len(asked))))).withColumn("_x", x)
    return found.select(key, reduce(lambda l, r: l + r, map(part, range(len(asked)))).alias("score")).where("score > 0")


def matching(df: DataFrame, key: str, text: str, terms: list[str], mode: str | None = None) -> DataFrame:
    """key, hits: texts with all terms, or with any (`or`); unless said, up to three terms must all be there."""
    least = 1 if (mode or ("and" if len(terms) <= 3 else "or")) == "or" else len(set(terms))
    own = F.array_intersect(tokens(F.col(text)), F.array(*map(F.lit, terms)))
    return df.select(key, F.size(own).cast("long").alias("hits")).where(F.col("hits") >= least)


def matching_groups(df: DataFrame, key: str, text: str, groups: list[list[str]]) -> DataFrame:
    """key of the texts with a term of every group: (a or b) and (c or d)."""
    t = tokens(F.col(text))
    return df.where(reduce(lambda a, b: a & b, (F.arrays_overlap(t, F.array(*map(F.lit, g))) for g in groups))).select(key)


def with_prefix(df: DataFrame, key: str, text: str, prefixes: list[str]) -> DataFrame:
    def one(prefix: str) -> Column:
        return F.exists(tokens(F.col(text)), lambda x: x.startswith(prefix))

    return df.where(reduce(lambda a, b: a & b, map(one, prefixes))).select(key)


def ranked(df: DataFrame, score: str, key: str, name: str, limit: int) -> DataFrame:
    """key and its rank from 0 among the `limit` best."""
    few = df.orderBy(F.desc(score), key).limit(limit)
    return few.select(key, (F.row_number().over(Window.orderBy(F.desc(score), key)) - 1).cast("long").alias(name))


def fuse(legs: list[tuple[DataFrame, str, float]], key: str | list[str], k: int = K) -> DataFrame:
    """key, score, and each leg's rank: the sum of weight / (k + rank) over the legs that have the row."""
    out = reduce(lambda a, b: a.join(b, key, "full"), (leg for leg, _, _ in legs))
    return out.withColumn("score", reduce(lambda a, b: a + b, (F.coalesce(w / (k + F.col(name)), F.lit(0.0)) for _, name, w in legs)))


def hybrid(semantic: DataFrame, text: DataFrame, key: str | list[str], alpha: float = ALPHA) -> DataFrame:
    """Two legs with ranks r_sem and r_fts fused; a leg without rows leaves all weight to the other."""
    return fuse([(semantic, "r_sem", alpha), (text, "r_fts", 1 - alpha)], key)


def fan_out(scopes: list[DataFrame], key: str, score: str, each: int = 10, k: int = K) -> DataFrame:
    """key, score, first_scope: the best of each scope fused by their ranks from 1; ties by first scope, then key."""
    rows = []
    for n, s in enumerate(scopes):
        few = s.orderBy(F.desc(score), key).limit(each)
        rows.append(few.select(key, F.lit(n).alias("scope"), F.row_number().over(Window.orderBy(F.desc(score), key)).alias("rank")))
    every = reduce(lambda a, b: a.union(b), rows)
    return every.groupBy(key).agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min("scope").cast("long").alias("first_scope"))


def strategic_order(rank: Column, n: Column) -> Column:
    """Order for a prompt: the best first, the second last, the rest between; as it is for fewer than three."""
    return F.when(n < 3, rank).when(rank == 1, 0).when(rank == 2, n + 1).otherwise(rank)


#: Rows looked at for each row asked for, most of them, and most with hidden rows added.
WIDER, WIDEST, HARD_LIMIT = 10, 1000, 4096


def hybrid_search(
    rows: DataFrame, key: str, text_scores: DataFrame, vector_scores: DataFrame, shown: Column, only: Column | None = None,
    boosts: dict[str, Column] | None = None, profile: dict[str, float] | None = None, top: int = 10, hidden: int = 0,
) -> DataFrame:
    """key, score, r_fts, r_sem of the `top` best of `rows`: two legs of scores, fused by rank, filtered and boosted.

    text_scores and vector_scores: key, score. `shown` (who may see what, what
    is hidden) holds for both legs before ranks are given, so that a hidden
    row takes nobody's place; `only` (what the user filters by) is tried again
    on what is fused. Each leg gives WIDER rows for each that is asked for,
    and `hidden` more. boosts: multipliers by name, each as much as the
    profile weighs it (1 if it says nothing).
    """
    wanted = shown if only is None else shown & only
    each = min(min(WIDER * top, WIDEST) + hidden, HARD_LIMIT)
    kept = rows.where(wanted).select(key)
    legs = [ranked(s.join(kept, key, "left_semi"), "score", key, name, each) for s, name in ((vector_scores, "r_sem"), (text_scores, "r_fts"))]
    fused = hybrid(*legs, key).join(rows, key)
    factor = reduce(lambda a, b: a * b, (damped(c, (profile or {}).get(n, 1.0)) for n, c in (boosts or {}).items()), F.lit(1.0))
    best = fused.where(wanted).withColumn("score", F.round(F.col("score") * factor, 9))
    return best.orderBy(F.desc("score"), key).limit(top).select(key, "score", "r_fts", "r_sem")


#: Scores from which hits are sure, likely or possible enough to be put into a prompt, and how many at most.
SURE, LIKELY, POSSIBLE, MOST_IN_PROMPT = 0.015, 0.010, 0.005, 3


def for_prompt(hits: DataFrame, group: str, key: str, score: str, polluted: Column, most: int = MOST_IN_PROMPT) -> DataFrame:
    """group, key, score, place of the hits of each query that go into its prompt: none below POSSIBLE, then one, the likely ones, or two at least.

    polluted: hits of tests, which never go. The best stands first, the second best last.
    """
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    own = hits.where(~F.coalesce(polluted, F.lit(False))).select(group, key, score).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= MOST_IN_PROMPT)
    first = F.max(score).over(Window.partitionBy(group))
    sure = F.count_if(F.col(score) > SURE).over(Window.partitionBy(group))
    n = F.when(first < POSSIBLE, 0).when(first > SURE, F.greatest(sure, F.lit(2))).when(first >= LIKELY, F.count_if(F.col(score) >= LIKELY).over(Window.partitionBy(group))).otherwise(1)
    few = own.withColumn("_n", F.least(n, F.lit(most))).where(F.col("_r") <= F.col("_n"))
    few = few.withColumn("_n", F.count("*").over(Window.partitionBy(group)))
    return few.select(group, key, score, strategic_order(F.col("_r"), F.col("_n")).cast("long").alias("place"))


def with_session(hits: DataFrame, sessions: DataFrame, source_file: str) -> DataFrame:
    """Hits with what is known of the session that their file is named after; sessions: session_id and more."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(source_file, F.lit("")), "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return hits.withColumn("session_id", F.nullif(stem, F.lit(""))).join(sessions, "session_id", "left")


def by_origin(created: str, rank: str) -> list[Column]:
    """Order by time of origin: what can be read as a time, other texts as they are, then none; ties by rank."""
    at = instant(F.col(created))
    known = F.coalesce(created, F.lit("")) != ""
    return [F.when(at.isNotNull(), 0).when(known, 1).otherwise(2), at, F.when(at.isNull() & known, F.col(created)), F.col(rank)]


def exact_ids(rows: DataFrame, key: str, queries: DataFrame, shape: str) -> DataFrame:
    """query, key: queries that are an id by their shape and in being there; the others go to search.

    queries: query.
    """
    asked = queries.select("query", F.trim("query").alias(key)).where(F.col(key).rlike(shape))
    return asked.join(rows.select(key), key).select("query", key)
