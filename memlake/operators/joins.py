"""Joins: aliases, as-of, neighbours in a sequence, intervals, censuses of an index against its base."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import blocks
from memlake.operators.vectors import cosine
from memlake.storage import materialize


def resolve_aliases(asked: DataFrame, alias: DataFrame, key: str) -> DataFrame:
    """`asked` with found: the id that `key` was merged into, one hop, or itself; alias: old_id, new_id."""
    return asked.join(alias, asked[key] == alias.old_id, "left").select(asked["*"], F.coalesce("new_id", key).alias("found"))


def normal_key(name: str | Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(F.col(name) if isinstance(name, str) else name), "[^a-z0-9]", "")


def previous_of(df: DataFrame, scope: str, order: list[str], where: Column, value: str, name: str) -> DataFrame:
    """`df` with `name`: `value` of the last row before in the scope for which `where` holds (a backward as-of join)."""
    before = Window.partitionBy(scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(where, F.col(value)), ignorenulls=True).over(before))


def around(df: DataFrame, targets: DataFrame, scope: str, position: str, before: int, after: int) -> DataFrame:
    """Rows at most so far before or after a target of the same scope; targets: the scope, _target.

    Each target offers its few positions, so that the join is by equality.
    """
    wanted = targets.withColumn(position, F.explode(F.sequence(F.col("_target") - before, F.col("_target") + after)))
    return df.join(wanted, [scope, position])


def missing_from(base: DataFrame, index: DataFrame, key: str) -> DataFrame:
    return base.join(index.select(key), key, "left_anti")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def in_interval(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points with the intervals of the same key that hold them."""
    return points.join(intervals, key).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))


#: Members from which a group is dealt into parts of about so many.
LARGE = 1000


#: Members of a block, and groups that two blocks are compared in at a time; blocks from which they are written instead of exchanged.
BLOCK, COLUMNS, WRITTEN = 1024, 4096, 8


def _shared(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many groups each of the one side has in common with each of the other; a side: groups for each member, and all of them in a row."""
    shared = np.zeros((len(x[0]), len(y[0])), np.float32)
    if not shared.size:
        return shared
    codes, known = pd.factorize(np.concatenate([x[1], y[1]]))
    cut = len(x[1])
    sides = [(np.repeat(np.arange(len(s)), s), c, len(s)) for (s, _), c in zip((x, y), (codes[:cut], codes[cut:]), strict=True)]
    for first in range(0, len(known), COLUMNS):
        held = []
        for rows, c, n in sides:
            here = (c >= first) & (c < first + COLUMNS)
            m = np.zeros((n, min(COLUMNS, len(known) - first)), np.float32)
            m[rows[here], c[here] - first] = 1
            held.append(m)
        shared += held[0] @ held[1].T
    return shared


def _dense_pairs(own: DataFrame, group: str, member: str, members: int) -> DataFrame:
    """As `pairs_within`, for members that mostly have groups in common: blocks of members as rows of zeros and ones, multiplied block by block.

    Bounded by a block with a block in a task, and no pair is exchanged; the
    work is by pairs of members, whatever the number of groups they share. Few
    blocks are exchanged, many are written and read by the tasks.
    """
    parts = max(1, -(-members // BLOCK))
    if parts >= WRITTEN:
        return _compared(own, group, member, members, "n long", lambda x, y: lambda i, j, n: [n.astype(np.int64)])
    grouped = own.distinct().groupBy(member).agg(F.collect_list(group).alias("_g")).withColumn("_k", F.pmod(F.xxhash64(member), F.lit(parts)).cast("int"))
    left = grouped.select(F.col(member).alias("_m"), "_g", F.col("_k").alias("_i"), F.explode(F.sequence(F.col("_k"), F.lit(parts - 1))).alias("_j"))
    right = grouped.select(F.col(member).alias("_m"), "_g", F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("_i"), F.col("_k").alias("_j"))
    kind = own.schema[member].dataType.simpleString()

    def compare(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        side = lambda f: (np.fromiter(map(len, f["_g"]), np.int64, len(f)), np.concatenate([*f["_g"]]) if len(f) else np.zeros(0))
        shared = _shared(side(x), side(y))
        i, j = np.nonzero(shared)
        a, b, n = x["_m"].to_numpy()[i], y["_m"].to_numpy()[j], shared[i, j].astype(np.int64)
        if key[0] == key[1]:
            once = (a < b).astype(bool)
            return pd.DataFrame({"a": a[once], "b": b[once], "n": n[once]})
        swap = (a > b).astype(bool)
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "n": n})

    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInPandas(compare, f"a {kind}, b {kind}, n long")


def _compared(own: DataFrame, group: str, member: str, members: int, made: str, values, facts: DataFrame | None = None) -> DataFrame:
    """a, b and the columns `made` of all pairs of members that have a group in common; own: group, member.

    Members are written with their groups and `facts` (a row for each member),
    in files of a block; a task reads two at a time. `values` makes of two
    blocks, tables of _m, _g and the facts, what makes the columns of some
    pairs: of their places in both and how many groups each has in common.
    """
    rows = own.repartition(member).groupBy(member).agg(F.collect_set(group).alias("_g"))
    if facts is not None:
        rows = rows.join(facts, member, "left")
    # a file is of one partition: not more partitions than blocks
    files = blocks.written(rows.withColumnRenamed(member, "_m").coalesce(max(1, -(-members // BLOCK))), BLOCK, "members")
    kind = own.schema[member].dataType.simpleString()
    held: dict[str, pa.Table] = {}  # the block that the next pairs have as well

    def read(uri: str) -> pa.Table:
        if uri not in held:
            held.clear()
            held[uri] = blocks.block(uri)
        return held[uri]

    def groups(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        lists = blocks.column(rows, "_g")
        return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)

    def run(k: int) -> Iterator[pa.RecordBatch]:
        at, other = blocks.pairs_of(len(files), k)
        x = read(files[at])
        y = x if at == other else blocks.block(files[other])
        shared = _shared(groups(x), groups(y))
        if at == other:
            shared = np.triu(shared, 1)  # each pair of rows once
        i, j = np.nonzero(shared)
        both, n, of = (blocks.column(x, "_m"), blocks.column(y, "_m")), shared[i, j], values(x, y)
        for first in range(0, len(i), blocks.BATCH):
            p, q, m = (z[first : first + blocks.BATCH] for z in (i, j, n))
            a, b = both[0].take(pa.array(p)), both[1].take(pa.array(q))
            less = pc.less(a, b)
            columns = [pc.if_else(less, a, b), pc.if_else(less, b, a), *of(p, q, m)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["a", "b", *names])

    names = [c.split()[0] for c in made.split(", ")]
    return blocks.dealt(own.sparkSession, len(files) * (len(files) + 1) // 2, run, f"a {kind}, b {kind}, {made}")


def _pairs_of_small(own: DataFrame, group: str) -> DataFrame:
    """a, b, _kind, _other of groups that are gathered as an array each: group, _m, _kind, in any number of rows."""
    held = own.groupBy(group).agg(F.array_sort(F.collect_set(F.struct("_m", "_kind") if "_kind" in own.columns else "_m")).alias("_l"))
    first = held.where("size(_l) > 1").select("_l", F.posexplode("_l").alias("_at", "_x"))
    pairs = first.select("_x", F.explode(F.slice("_l", F.col("_at") + 2, F.greatest(F.size("_l") - F.col("_at") - 1, F.lit(0)))).alias("_y"))
    if "_kind" not in own.columns:
        return pairs.select(F.col("_x").alias("a"), F.col("_y").alias("b"))
    return pairs.where("_x._kind <> _y._kind").select(F.col("_x._m").alias("a"), F.col("_y._m").alias("b"))


def _pairs_of_large(own: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """The same of large groups, joined in parts; sizes: group, _parts."""
    own = own.distinct().join(sizes, group)
    kinds = "_kind" in own.columns
    left = own.select(group, F.col("_m").alias("a"), *([F.col("_kind")] if kinds else []), F.pmod(F.xxhash64("_m"), F.col("_parts")).cast("int").alias("_part"))
    right = own.select(group, F.col("_m").alias("b"), *([F.col("_kind").alias("_other")] if kinds else []), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return left.join(right, [group, "_part"]).where("a < b and _kind <> _other" if kinds else "a < b").select("a", "b")


def _coded(column: Column) -> Column:
    return F.xxhash64(column)


def _sizes(rows: DataFrame, group: str) -> tuple[DataFrame, dict[int, int]]:
    """group, _n: its rows; how many groups have how many rows: what is chosen by them is the way, not the result."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    return sizes, {r["_n"]: r["count"] for r in sizes.groupBy("_n").count().collect()}


def _mostly_shared(times: dict[int, int], members: int) -> bool:
    """Whether groups make more pairs than there are pairs of members."""
    return sum(float(k) * min(n, members) * (min(n, members) - 1) for n, k in times.items()) > 2 * members * members


def pairs_within(df: DataFrame, group: str, member: str, kind: Column | None = None) -> DataFrame:
    """a, b, n: how many groups have both members, a < b. Members of a group are taken once each.

    With `kind`, a column made of the member, only pairs of two kinds are made.
    A group is gathered as an array, and its pairs are counted. One side of a
    group of more than LARGE rows is dealt into parts instead, each with a copy
    of the other, so that it is spread over as many tasks. Members that are no
    whole numbers are counted by their hashes, of which a table is written
    first; if two members share one, by themselves. Where groups make more pairs
    than there are pairs of members, as a few groups that hold most members do,
    members are compared block by block instead.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(member).isNotNull())
    sizes, times = _sizes(rows, group)
    whole, names = rows.schema[member].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"), None
    if not whole:
        names = materialize(rows.select(F.col(member).alias("_name")).groupBy(_coded(F.col("_name")).alias("_m")).agg(F.min("_name").alias("_name"), F.max("_name").alias("_last")), "members")
        if not names.where("_name <> _last").isEmpty():
            names = None
    if kind is None:
        members = rows.agg(F.approx_count_distinct(member)).first()[0] if names is None else names.count()
        if _mostly_shared(times, members):
            return _dense_pairs(rows.select(group, member), group, member, members)
    own = rows.select(group, (F.col(member) if names is None else _coded(F.col(member))).alias("_m"), *([kind.alias("_kind")] if kind is not None else []))
    if max(times, default=0) <= LARGE:
        pairs = _pairs_of_small(own, group)
    else:
        large = materialize(sizes.where(F.col("_n") > LARGE).select(group, F.ceil(F.col("_n") / LARGE).cast("int").alias("_parts")), "large")
        pairs = _pairs_of_small(own.join(large, group, "left_anti"), group).union(_pairs_of_large(own, group, large))
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    if names is None:
        return counted
    named = counted.join(names.select(F.col("_m").alias("a"), F.col("_name").alias("_a")), "a").join(names.select(F.col("_m").alias("b"), F.col("_name").alias("_b")), "b")
    return named.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "n")


def _vectors_of(rows: pa.Table, name: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of the rows that have one, by its length."""
    lists = blocks.column(rows, name)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends, flat = np.cumsum(sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    return {n: (at := np.flatnonzero(sizes == n), flat[(ends[at] - n)[:, None] + np.arange(n)]) for n in np.unique(sizes[sizes > 0]).tolist()}


def _cosines(x: pa.Table, y: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The cosine of each row of the one block to each of the other, and whether there is one."""
    c, known = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)), bool)
    left, right = _vectors_of(x, name), _vectors_of(y, name)
    for n in left.keys() & right.keys():
        (i, v), (j, w) = left[n], right[n]
        with np.errstate(invalid="ignore", divide="ignore"):
            c[np.ix_(i, j)] = (v @ w.T) / np.sqrt((v * v).sum(axis=1)[:, None] * (w * w).sum(axis=1)[None, :])
        known[np.ix_(i, j)] = True
    return c, known


def _equal(x: pa.Table, y: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of both blocks' values that are equal where they are, nulls with nothing."""
    codes = pd.factorize(np.concatenate([blocks.column(t, name).to_numpy(zero_copy_only=False) for t in (x, y)]))[0]
    return codes[: len(x)], np.where(codes < 0, -2, codes)[len(x) :]


def jaccard_within(df: DataFrame, group: str, member: str, facts: DataFrame | None = None, cosines: tuple[str, ...] = (), gaps: tuple[str, ...] = (), same: tuple[str, ...] = ()) -> DataFrame:
    """a, b, jaccard of all pairs of members that have a group in common: groups of both by groups of either.

    With `facts`, a row for each member, also under their own names the cosine
    of both members' `cosines` (arrays without nulls; null where one is null or
    they have not one length, NaN with a zero vector), the absolute difference
    of their `gaps` (doubles) and whether their `same` are equal and not null.
    Where members mostly have groups in common, all is computed where two blocks
    of members are compared, so that pairs are not exchanged.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(member).isNotNull())
    members = rows.agg(F.approx_count_distinct(member)).first()[0]
    if facts is not None:
        facts = facts.select(member, *cosines, *gaps, *same)
    if _mostly_shared(_sizes(rows, group)[1], members):

        def values(x: pa.Table, y: pa.Table):
            sizes = [pc.list_value_length(blocks.column(t, "_g")).to_numpy(zero_copy_only=False).astype(float) for t in (x, y)]
            likes = [_cosines(x, y, c) for c in cosines]
            ends = [[pc.fill_null(blocks.column(t, c), np.nan).to_numpy(zero_copy_only=False) for t in (x, y)] for c in gaps]
            codes = [_equal(x, y, c) for c in same]

            def of(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> list:
                n = n.astype(float)
                made = [n / (sizes[0][i] + sizes[1][j] - n)]
                made += [pa.array(c[i, j], mask=~known[i, j]) for c, known in likes]
                made += [pa.array(np.abs(p[i] - q[j]), from_pandas=True) for p, q in ends]
                return made + [p[i] == q[j] for p, q in codes]

            return of

        named = [*(f"{c} double" for c in (*cosines, *gaps)), *(f"{c} boolean" for c in same)]
        return _compared(rows.select(group, member), group, member, members, ", ".join(["jaccard double", *named]), values, facts)
    shared = pairs_within(df, group, member)
    sizes = rows.groupBy(member).agg(F.countDistinct(group).alias("_size"))
    if facts is not None:
        sizes = sizes.join(facts, member, "left")
    for x in "ab":
        shared = shared.join(sizes.select(F.col(member).alias(x), *(F.col(c).alias(f"{c}_{x}") for c in sizes.columns if c != member)), x)
    jaccard = F.col("n") / (F.col("_size_a") + F.col("_size_b") - F.col("n"))
    likes = [F.when(F.size(f"{c}_a") == F.size(f"{c}_b"), cosine(f"{c}_a", f"{c}_b")).alias(c) for c in cosines]
    return shared.select("a", "b", jaccard.alias("jaccard"), *likes, *(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")).alias(c) for c in gaps), *(F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False)).alias(c) for c in same))
