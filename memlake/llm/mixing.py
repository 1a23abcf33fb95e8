"""Mixing sources to target weights: Sainte-Lague quotas of equal blocks for each shard, then seeded choice of blocks.

A source's documents, in a seeded order, are one run of words, cut into blocks
of as many words (its last may be shorter). A source's target is its share by
weight, at most `most` times its own words; what that cuts off is shared out
again. Blocks are allocated one after another to the source of the highest
quotient v / (2s + 1), where v is its target in blocks and s what it has got.
Seats in this order fill the shards, so each shard's quotas are integers near
the weights. A source's seats take its blocks in a seeded permutation, again
and again if there are more seats than blocks. What the quota's rounding and the
short last block leave to the target's whole words, mostly less than a block's
words and never many blocks, is cut from the last seats or taken by further ones.

Texts are never exchanged, only sizes. Sources can be many: the shares come
from rounds of sums over the sources, the seats' order from a distributed sort,
and places in a source's run from sums over hashed parts of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import WORD, materialize
from memlake.llm.substrings import mixed

#: Weights by the sources' order, again and again; times that a source's words may be taken; shards; seed.
WEIGHTS, MOST, SHARDS, SEED = (5, 2, 1), 3, 16, 12
#: Least words of a block; blocks in all are 2^22 at most, as larger corpora have larger blocks. Rows of a part of a source's run.
LEAST_BLOCK, BLOCKS, PART = 64, 1 << 22, 1 << 13
#: Sources that are broadcast at most; more are joined by a shuffle.
BROADCAST = 100_000
_ROUND = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(4)]


@dataclass
class Mix:
    """rows: doc_id, size, _t, _start (words before it in its source's run), sid; sources: sid, source, weight, source_size, target,
    n (blocks), quota, take (words); seats: sid, seat, shard; block: words of a block; shards: their number."""

    rows: DataFrame
    sources: DataFrame
    seats: DataFrame
    block: int
    seed: int
    shards: int


def permuted(x: np.ndarray, n: np.ndarray, seed: np.ndarray, back: bool = False) -> np.ndarray:
    """The place of each x below n in a seeded permutation of 0 to n - 1, or back; a Feistel network that walks on until it is below n."""
    x, n, seed = (np.asarray(a, np.uint64) for a in (x, n, seed))
    half = np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.copy(), np.arange(len(x))
    while len(todo):
        h, m, s = half[todo], mask[todo], seed[todo]
        a, b = out[todo] >> h, out[todo] & m
        for k in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            if back:
                a, b = b ^ (mixed(a + s + _ROUND[k]) & m), a
            else:
                a, b = b, a ^ (mixed(b + s + _ROUND[k]) & m)
        out[todo] = a << h | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _ranked(df: DataFrame, order: list, rank: str, name: str) -> DataFrame:
    """Written `df` with its rows' places, from 0, in the order: sorted by ranges, each range's first place is the sum of those before."""
    at = F.monotonically_increasing_id()
    held = materialize(df.orderBy(*order).select("*", F.shiftright(at, 33).alias("_p"), at.bitwiseAND((1 << 33) - 1).alias("_i")), name)
    # a row for each range
    firsts = held.groupBy("_p").count().withColumn("_f", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).drop("count")
    return held.join(F.broadcast(firsts), "_p").withColumn(rank, (F.col("_f") + F.col("_i")).cast("long")).drop("_p", "_i", "_f")


def _with_targets(sources: DataFrame, most: int) -> DataFrame:
    """`sources` (weight, source_size) with target: shares by weight, none above `most` times its size."""
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    left, of = total or 0, weights or 1
    wide = lambda x: F.lit(x).cast("decimal(38,0)")
    over = lambda: F.col("source_size") * wide(most * of) < F.col("weight") * wide(left)
    while of:
        size, weight = sources.where(over()).agg(F.sum("source_size"), F.sum("weight")).first()
        now = ((total or 0) - most * (size or 0), (weights or 1) - (weight or 0))
        if now == (left, of):
            break
        left, of = now
    capped = (most * F.col("source_size")).cast("double")
    return sources.withColumn("target", F.when(over(), capped).otherwise(F.col("weight") * F.lit(left / of))) if of else sources.withColumn("target", capped)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shards: int = SHARDS, seed: int = SEED) -> Mix:
    """The mixture of `docs` (doc_id, text, source); see `taken` and `spans`.

    Sources are ordered by code point, null last, which is a source of its own.
    A null or empty text has no words and is never taken; rows that repeat are
    taken each; an empty table gives an empty mixture. Only keys, sizes and the
    seed decide, so reruns agree. Other columns are not read.
    """
    sized = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("_t"))
    rows = materialize(sized, "sizes")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sources = materialize(_ranked(sizes, [F.asc_nulls_last("source")], "sid", "sources").withColumn("weight", weight.cast("long")), "sources")
    n_sources, total = sources.agg(F.count("*"), F.sum("source_size")).first()
    block = max(LEAST_BLOCK, -(-(total or 0) // BLOCKS))
    claimed = (
        _with_targets(sources, most).withColumn("n", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("_v", F.expr("if(source_size = 0, 0D, target * n / source_size)"))
    )
    claims = claimed.agg(F.sum("_v")).first()[0] or 0.0
    n_seats = round(claims)
    # no source gets more: the divisor is below its share by half a seat for each source at most
    bound = F.ceil(F.col("_v") * ((n_seats + n_sources / 2) / max(claims, 1e-300)) + 0.5).cast("long")
    quotients = claimed.where("_v > 0").select("sid", "_v", F.explode(F.sequence(F.lit(0).cast("long"), bound)).alias("seat")).withColumn("_q", F.col("_v") / (2 * F.col("seat") + 1))
    order = _ranked(quotients, [F.desc("_q"), "sid", "seat"], "_r", "quotients").where(F.col("_r") < n_seats)
    seats = materialize(order.select("sid", "seat", F.floor(F.col("_r") * shards / max(n_seats, 1)).cast("int").alias("shard")), "seats")
    quotas = seats.groupBy("sid").agg(F.count("*").alias("quota"))
    taking = (
        claimed.join(quotas, "sid", "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long")))
        .withColumn("take", F.least(F.floor(F.col("target") + 0.5), most * F.col("source_size")).cast("long"))
    )
    held = materialize(taking.select("sid", "source", "weight", "source_size", "target", "n", "quota", "take", "_rows"), "quotas")
    return Mix(_placed(rows, held, n_sources, seed), held, seats, block, seed, shards)


def _seeds(sid: np.ndarray, seed: int) -> np.ndarray:
    return mixed(sid.astype(np.uint64) + np.uint64(seed << 32))


def _placed(rows: DataFrame, sources: DataFrame, n_sources: int, seed: int) -> DataFrame:
    """The rows with sid, _start and their source's numbers; each hashed part of a source's run begins after the parts before."""
    few = sources.select(F.col("source").alias("_s"), "sid", "source_size", "target", "n", "quota", "take", "_rows")
    dealt = rows.join(F.broadcast(few) if n_sources <= BROADCAST else few, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    dealt = dealt.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "size", "_t")).withColumn("_part", F.pmod("_h", F.ceil(F.col("_rows") / PART).cast("long")))
    parts = dealt.groupBy("sid", "_part").agg(F.sum("size").alias("_n"))
    before = parts.withColumn("_before", F.sum("_n").over(Window.partitionBy("sid").orderBy("_part")) - F.col("_n")).drop("_n")
    at = F.sum("size").over(Window.partitionBy("sid", "_part").orderBy("_h", "doc_id", "size", "_t").rowsBetween(Window.unboundedPreceding, -1))
    return dealt.withColumn("_at", F.coalesce(at, F.lit(0))).join(before, ["sid", "_part"]).withColumn("_start", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before", "_h", "_rows")


def _overlaps(columns: dict[str, np.ndarray], block: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each row's blocks: the row, the block's number and place, words of the row in it, words of them that the last round takes."""
    start, size, whole, n, take, sid = (columns[c] for c in ("_start", "size", "source_size", "n", "take", "sid"))
    first = start // block
    many = np.where(size > 0, (start + size - 1) // block - first + 1, 0)
    row = np.repeat(np.arange(len(size)), many)
    number = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    seeds = _seeds(sid, seed)
    place = permuted(number, n[row], seeds[row])
    last = permuted(np.maximum(n - 1, 0), np.maximum(n, 1), seeds)[row]
    short = (n * block - whole)[row]
    left = (take % np.maximum(whole, 1))[row] - (place * block - np.where(last < place, short, 0))
    begin = np.maximum(start[row], number * block)
    end = np.minimum((start + size)[row], (number + 1) * block)
    got = np.clip(np.minimum(end, number * block + np.clip(left, 0, block)) - begin, 0, None)
    return row, number, place, end - begin, got


_USED = ("_start", "size", "source_size", "n", "take", "sid")


def taken(mixed_in: Mix) -> DataFrame:
    """doc_id, size, source_size (long), target (double, its source's), taken (long: words that the mix takes, repeats counted), quota (long:
    blocks of its source), of each row."""
    block, seed = mixed_in.block, mixed_in.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _USED}
            row, _, _, _, got = _overlaps(columns, block, seed)
            more = np.bincount(row, weights=got, minlength=batch.num_rows).astype(np.int64)
            made = columns["take"] // np.maximum(columns["source_size"], 1) * columns["size"] + more
            kept = [batch.column(c) for c in ("doc_id", "size", "source_size", "target")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(made), batch.column("quota")], names=["doc_id", "size", "source_size", "target", "taken", "quota"])

    rows = mixed_in.rows
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", *_USED, "target", "quota").mapInArrow(run, f"doc_id {kind}, size long, source_size long, target double, taken long, quota long")


def spans(mixed_in: Mix) -> DataFrame:
    """What each shard is made of: shard (int), sid, seat, doc_id, first (word of the document, from 0), words (long).

    Seats that make up for a quota's rounding go to their source's last shard,
    or to the first of all if it has none.
    """
    block, seed = mixed_in.block, mixed_in.seed

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in _USED}
            row, number, place, words, got = _overlaps(columns, block, seed)
            full = (columns["take"] // np.maximum(columns["source_size"], 1))[row]
            first = np.maximum(number * block - columns["_start"][row], 0)
            times = full + (got > 0)
            one = np.repeat(np.arange(len(row)), times)
            turn = np.arange(len(one)) - np.repeat(np.cumsum(times) - times, times)
            made = [
                batch.column("doc_id").take(pa.array(row[one])), pa.array(columns["sid"][row[one]]), pa.array(turn * columns["n"][row[one]] + place[one]),
                pa.array(first[one]), pa.array(np.where(turn < full[one], words[one], got[one])),
            ]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "sid", "seat", "first", "words"])

    rows = mixed_in.rows
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.select("doc_id", *_USED).mapInArrow(cut, f"doc_id {kind}, sid long, seat long, first long, words long")
    ends = mixed_in.seats.groupBy("sid").agg(F.max("shard").alias("_e"))
    return made.join(mixed_in.seats, ["sid", "seat"], "left").join(ends, "sid", "left").select(F.coalesce("shard", "_e", F.lit(0)).alias("shard"), "sid", "seat", "doc_id", "first", "words")
