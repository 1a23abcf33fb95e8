"""Predicates as columns: visibility, lifecycle, scope, patterns, validity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes that are hidden unless asked for, and phrases of chatter about the system itself.
HIDDEN_CONTENT, HIDDEN_SOURCES = ("operational", "test", "benchmark", "cold"), ("desktop", "background-worker")


def equal_to(**values: object) -> Column:
    """All columns equal their values; none given: true."""
    return reduce(lambda a, b: a & b, (F.col(c) == v for c, v in values.items() if v is not None), F.lit(True))


def active() -> Column:
    return F.col("superseded_by").isNull() & F.col("aggregated_into").isNull() & F.col("archived_at").isNull()


def current() -> Column:
    return F.col("invalid_at").isNull()


def content_visible(hidden: tuple[str, ...] = HIDDEN_CONTENT) -> Column:
    return ~F.coalesce("content_class", F.lit("knowledge")).isin(*hidden)


def source_visible(shown: tuple[str, ...] = ()) -> Column:
    return F.col("source_class").isNull() | ~F.col("source_class").isin(*(s for s in HIDDEN_SOURCES if s not in shown))


def in_projects(projects: list[str], or_none: bool = True) -> Column:
    own = F.col("project").isin(*projects)
    return own | F.col("project").isNull() if or_none else own


#: Who may see what: (project scope may be null, everything is denied without a project).
POLICIES = {"worker": (False, True), "lead": (True, True), "orchestrator": (True, False), "coach": (False, True)}


def consumer_scope(consumer: str, projects: list[str]) -> Column:
    """Scope of a kind of consumer: the own projects; a lead also sees chunks of none, an orchestrator without projects all."""
    or_none, deny = POLICIES[consumer]
    if not projects:
        return F.lit(not deny)
    return in_projects(projects, or_none)


def tagged(df: DataFrame, tags: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows with one of the tags; tags: chunk_id, tag."""
    return df.join(tags.where(F.col("tag").isin(*wanted)).select("chunk_id"), "chunk_id", "left_semi")


def untagged(df: DataFrame, tags: DataFrame, pattern: str) -> DataFrame:
    """Rows without a tag that the pattern matches whole."""
    return df.join(tags.where(F.col("tag").rlike(f"^(?:{pattern})$")).select("chunk_id"), "chunk_id", "left_anti")


def like_any_case(column: str, pattern: str, escape: str = "\\") -> Column:
    return F.expr(f"lower({column}) like lower('{pattern}') escape '{escape * 2 if escape == chr(92) else escape}'")


def glob(column: str, pattern: str) -> Column:
    """Case-sensitive glob over the whole value: * any run, ? one character, [..] a class."""
    out = "".join({"*": ".*", "?": "."}.get(c, c if c in "[]-" or c.isalnum() else "\\" + c) for c in pattern)
    return F.col(column).rlike(f"^{out}$")


def valid_at(now: Column) -> Column:
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= now)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= now))


def contains_none(column: str, phrases: list[str]) -> Column:
    lowered = F.lower(F.coalesce(F.col(column), F.lit("")))
    return ~reduce(lambda a, b: a | b, (lowered.contains(p.lower()) for p in phrases), F.lit(False))


def starts_with_none(column: str, prefixes: list[str], within: int = 1024) -> Column:
    head = F.substring(F.lower(F.ltrim(F.coalesce(F.col(column), F.lit("")))), 1, within)
    return ~reduce(lambda a, b: a | b, (head.startswith(p) for p in prefixes), F.lit(False))


def reject_reason(text: str, least: int) -> Column:
    """Why a record is not taken in; null if it is."""
    bare = F.trim(F.coalesce(F.col(text), F.lit("")))
    return (
        F.when(bare == "", "empty").when(F.length(bare) < least, "too short").when(F.lower(bare).rlike("<(tool|system)[_-]"), "machine output")
    )


def searchable() -> Column:
    return (F.trim(F.coalesce(F.col("content"), F.lit(""))) != "") & active() & source_visible()


def after_key(columns: list[tuple[str, bool]], key: list[object]) -> Column:
    """Rows after `key` in the order of `columns` (name, descending): lexicographic, for seek pagination."""
    out = F.lit(False)
    for (name, down), value in reversed(list(zip(columns, key, strict=True))):
        c = F.col(name)
        out = (c < value if down else c > value) | ((c == value) & out)
    return out
