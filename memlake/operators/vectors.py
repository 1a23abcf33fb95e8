"""Vectors as array columns: distances, nearest neighbours, sign bits, diversity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import blocks


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def sign_words(v: str | Column, dims: int) -> Column:
    """Signs of the components as bits, 32 to a long."""
    v = F.col(v) if isinstance(v, str) else v
    word = lambda at: reduce(lambda a, b: a + b, (F.when(v[at + k] > 0, 1 << k).otherwise(0).cast("long") for k in range(min(32, dims - at))))
    return F.array(*(word(at) for at in range(0, dims, 32)))


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def nearest(df: DataFrame, distance: Column, n: int, key: str, name: str = "distance") -> DataFrame:
    """The n rows of least distance, ties by key: a top-k in each task, merged."""
    return df.withColumn(name, distance).orderBy(name, key).limit(n)


def constant(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


#: Vectors that a task asks for, and those of a block that it searches at a time.
ASKED, SEARCHED = 4096, 8192
#: Distances of a block that a task holds at a time.
HELD = 1 << 20
#: Digits of distances that decide on order; what differs less is a tie, which the key breaks.
DIGITS = 9


def _written(df: DataFrame, key: str, vector: str, rows: int, name: str) -> list[str]:
    """Files of the rows whose vector is sound, of at most so many rows each."""
    sound = df.where(F.coalesce(F.expr(f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null)"), F.lit(False)) & F.col(key).isNotNull())
    # a file is of one partition: not more partitions than blocks
    return blocks.written(sound.coalesce(max(1, -(-sound.count() // rows))), rows, name)


def _of_length(rows: pa.Table, key: str, vector: str, *more: str) -> dict[int, list[np.ndarray]]:
    """Keys, vectors and more columns of a block's rows by the length of the vector, in order of keys."""
    rows = rows.take(pc.array_sort_indices(blocks.column(rows, key)))
    lists = blocks.column(rows, vector)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    ends, flat = np.cumsum(sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    own = [blocks.column(rows, c).to_numpy(zero_copy_only=False) for c in (key, *more)]
    return {n: [own[0][at := np.flatnonzero(sizes == n)], flat[(ends[at] - n)[:, None] + np.arange(n)], *(c[at] for c in own[1:])] for n in np.unique(sizes).tolist()}


def _compared(df: DataFrame, asked: DataFrame, key: str, vector: str, more: tuple[str, ...], found: Callable, schema: str) -> DataFrame:
    """What `found` makes of asked rows (keys, vectors) and of the blocks that are searched (keys, vectors, `more`), those of one length together.

    Both sides are written once, one side if they are the same, and read by the
    tasks. A task has up to ASKED rows; only where those are few are the blocks
    that it searches dealt to several.
    """
    columns = [key, vector, *more]
    files = _written(df.select(F.col(key).cast("long").alias(key), *columns[1:]), key, vector, SEARCHED, "searched")
    split = max(1, SEARCHED // ASKED) if asked is df else 1
    sides = files if asked is df else _written(asked.select(F.col(key).cast("long").alias(key), vector), key, vector, ASKED, "asked")
    many = len(sides) * split
    parts = min(max(1, len(files)), -(-4 * df.sparkSession.sparkContext.defaultParallelism // max(1, many)))

    def run(k: int) -> Iterator[pa.RecordBatch]:
        at, part = divmod(k, parts)
        rows = blocks.block(sides[at // split])
        each = -(-len(rows) // split)
        rows = rows.slice(at % split * each, each)
        if len(rows):
            yield from found(_of_length(rows, key, vector), (_of_length(blocks.block(f), key, vector, *more) for f in files[part::parts]))

    return blocks.dealt(df.sparkSession, many * parts, run, schema)


def _distances(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    if kind == "hamming":
        a, b = np.where(a > 0, 1.0, -1.0), np.where(b > 0, 1.0, -1.0)
        return np.rint((a.shape[1] - a @ b.T) / 2)
    if kind == "l2":
        return np.round(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0), DIGITS)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.round(-(a @ b.T) / (np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]), DIGITS)


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k least of each row, ties by column, NaN never: only what is not above the k-th value is sorted."""
    last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
    rows, places = np.nonzero(d <= np.where(np.isnan(last), np.inf, last)[:, None])
    order = np.lexsort((places, d[rows, places], rows))
    rows, places = rows[order], places[order]
    first = np.searchsorted(rows, np.arange(len(d)))
    kept = np.arange(len(rows)) - first[rows] < k
    return rows[kept], places[kept]


class _Side:
    """Vectors of one length, what is computed of them once, and their keys."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, kind: str):
        self.keys, self.vectors, self.kind = keys, vectors, kind
        if kind == "cosine":
            self.sizes = np.sqrt((vectors * vectors).sum(axis=1))
            with np.errstate(invalid="ignore", divide="ignore"):
                self.units = (vectors / self.sizes[:, None]).astype(np.float32)

    def nearer(self, rows: slice, other: _Side, most: np.ndarray, k: int, itself: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some rows: rows, places in `other` and distances that are at most the row's of `most`, the k least at least.

        Where each row has a bound, cosines are first taken of unit vectors in
        single precision, and in double precision only where they can be near
        enough, as the error of the first is bounded.
        """
        x, own = self.vectors[rows], self.keys[rows]
        dims = x.shape[1]
        if self.kind == "cosine" and np.isfinite(most).all():
            least = (-most - (dims + 8) * 2.0**-23 - 10.0**-DIGITS).astype(np.float32)
            found = np.flatnonzero(self.units[rows] @ other.units.T >= np.nextafter(least, np.float32(-np.inf))[:, None])
            if len(found) <= 4 * HELD // dims:
                i, j = np.divmod(found, len(other.keys))
                with np.errstate(invalid="ignore", divide="ignore"):
                    d = np.round(-np.einsum("ij,ij->i", x[i], other.vectors[j]) / (self.sizes[rows][i] * other.sizes[j]), DIGITS)
                kept = d <= most[i]
                if not itself:
                    kept &= own[i] != other.keys[j]
                return i[kept], j[kept], d[kept]
        d = _distances(x, other.vectors, self.kind)
        if not itself:
            d[own[:, None] == other.keys[None, :]] = np.nan
        d[~(d <= most[:, None])] = np.nan
        i, j = _least(d, k)
        return i, j, d[i, j]


def _kept(best: np.ndarray, keys: np.ndarray, rows: np.ndarray, d: np.ndarray, found: np.ndarray) -> None:
    """Puts what was found for some rows, in order of rows, among their best distances (NaN where there is none yet) and keys, ties by key."""
    k, own = best.shape[1], np.unique(rows)
    if not len(own):
        return
    rows, d, found = np.append(rows, np.repeat(own, k)), np.append(d, best[own]), np.append(found, keys[own])
    order = np.lexsort((found, d, rows))
    first = np.searchsorted(rows[order], own)
    taken = order[first[:, None] + np.arange(k)]
    best[own], keys[own] = d[taken], found[taken]


def search(df: DataFrame, asked: DataFrame, key: str, vector: str, k: int, kind: str = "cosine", itself: bool = True) -> DataFrame:
    """asked, key, distance, rank (1 to k): for each row of `asked` the k rows of `df` of least distance, ties by key; exact.

    kind: l2 (squared), hamming (of signs) or cosine (negated). A task goes
    through blocks and keeps k of each asked vector, so that no pairs leave it
    and no vector is exchanged. Rows without a key and vectors that are null,
    empty or hold nulls are left out, as are cosines with zero vectors and
    vectors of another length; without `itself`, a row does not find its own key.
    """

    def found(asked: dict, searched: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        sides = {n: _Side(*x, kind) for n, x in asked.items()}
        held = {n: (np.full((len(x.keys), k), np.nan), np.zeros((len(x.keys), k), np.int64)) for n, x in sides.items()}
        for block in searched:
            for n in sides.keys() & block.keys():
                x, y, (best, keys) = sides[n], _Side(*block[n], kind), held[n]
                step = max(1, HELD // len(y.keys))
                for at in range(0, len(x.keys), step):
                    part = slice(at, at + step)
                    most = np.where(np.isnan(best[part, -1]), np.inf, best[part, -1])
                    i, j, d = x.nearer(part, y, most, k, itself)
                    _kept(best[part], keys[part], i, d, y.keys[j])
        for n, (best, keys) in held.items():
            i, place = np.nonzero(~np.isnan(best))
            yield pa.RecordBatch.from_arrays([pa.array(sides[n].keys[i]), pa.array(keys[i, place]), pa.array(best[i, place])], names=["asked", key, "distance"])

    near = _compared(df, asked, key, vector, (), found, f"asked long, {key} long, distance double")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("distance", key))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def within(df: DataFrame, asked: DataFrame, key: str, vector: str, least: str) -> DataFrame:
    """asked, key, likeness: rows of `df` whose cosine to a row of `asked` is at least their own value of the column `least`; not themselves."""

    def found(asked: dict, searched: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for block in searched:
            for n in asked.keys() & block.keys():
                (own, x), (keys, y, bound) = asked[n], block[n]
                step = max(1, HELD // len(y))
                for at in range(0, len(x), step):
                    c = -_distances(x[at : at + step], y, "cosine")
                    i, j = np.nonzero((c >= bound[None, :]) & (own[at : at + step, None] != keys[None, :]))
                    for first in range(0, len(i), blocks.BATCH):
                        p, q = i[first : first + blocks.BATCH], j[first : first + blocks.BATCH]
                        yield pa.RecordBatch.from_arrays([pa.array(own[at + p]), pa.array(keys[q]), pa.array(c[p, q])], names=["asked", key, "likeness"])

    return _compared(df, asked, key, vector, (least,), found, f"asked long, {key} long, likeness double")


def neighbour_edges(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """a, b, weight: undirected edges from each row to its k nearest by cosine, with the larger weight of both ways.

    Compares every row with all rows, block by block (see `search`).
    """
    near = search(df, df, key, vector, k, itself=False)
    return near.groupBy(F.least("asked", key).alias("a"), F.greatest("asked", key).alias("b")).agg(F.max(-F.col("distance")).alias("weight"))


def diversified(df: DataFrame, scope: str, key: str, score: str, vector: str, weight: float = 0.7, top: int = 50) -> DataFrame:
    """`df` (scope, key, score, vector) with place: the `top` best of each scope reordered by relevance less likeness to those before.

    Relevance is the score by the largest; each step takes the row of the
    largest weight * relevance - (1 - weight) * cosine to the nearest taken.
    Rows with a zero vector keep their places, and so do all after `top`.
    """
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(score), key)))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        v = np.array(pdf[vector].tolist(), dtype=float)
        size = np.linalg.norm(v, axis=1)
        free = np.flatnonzero(size > 0)
        places = pdf["place"].to_numpy().copy()
        if len(free):
            unit = v[free] / size[free][:, None]
            like = unit @ unit.T
            relevance = pdf[score].to_numpy(float)[free] / max(pdf[score].max(), 1e-300)
            closest, left, taken = np.zeros(len(free)), np.ones(len(free), bool), []
            for _ in free:
                gain = np.where(left, weight * relevance - (1 - weight) * closest, -np.inf)
                best = int(np.argmax(gain))
                closest = like[best] if not taken else np.maximum(closest, like[best])
                taken.append(best)
                left[best] = False
            places[free[taken]] = np.sort(places[free])
        return pdf.assign(place=places)

    # `top` rows of each scope come together, no more
    few = ranked.where(F.col("place") <= top).groupBy(scope).applyInPandas(order, ranked.schema)
    return few.union(ranked.where(F.col("place") > top))


def least_likeness(tokens: Column) -> Column:
    """The likeness from which texts of that many tokens are duplicates: shorter ones must be closer."""
    return F.when(tokens < 50, 0.95).when(tokens <= 200, 0.90).otherwise(0.88)


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, centroid: the mean of each component."""
    parts = df.select(group, F.posexplode(vector).alias("p", "x")).groupBy(group, "p").agg(F.avg("x").alias("x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("centroid"))


#: Runs whose hashes a worker holds before it starts anew, the longest that it holds, and runs of a text that are hashed at a time; bounds on
#: memory, without effect on results.
CACHED, LONGEST, RUNS = 1 << 16, 256, 1 << 16


def hashed_bits(df: DataFrame, key: str, text: str, width: int = 4) -> DataFrame:
    """key, simhash (long), n_tokens: bits that most hashed runs of `width` tokens have; of fewer, single tokens; ties to 1.

    Tokens are lower-cased, without timestamps and stop words. A text without
    tokens has all bits.
    """
    from memlake.functions.text import plain_tokens

    known: dict[str, bytes] = {}  # runs that come again

    def digest(run: str) -> bytes:
        h = known.get(run)
        if h is None:
            h = hashlib.blake2b(run.encode(), digest_size=8).digest()
            if len(run) <= LONGEST:
                if len(known) >= CACHED:
                    known.clear()
                known[run] = h
        return h

    def of(tokens: list[str]) -> int:
        if not tokens:
            return -1
        made = (f"sh:{' '.join(tokens[k : k + width])}" for k in range(len(tokens) - width + 1)) if len(tokens) >= width else (f"tok:{t}" for t in tokens)
        counts, n = np.zeros(64, np.int64), 0
        while some := list(islice(made, RUNS)):
            counts += np.unpackbits(np.frombuffer(b"".join(map(digest, some)), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            n += len(some)
        return int.from_bytes(np.packbits(counts * 2 >= n).tobytes(), "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(of(t := x.as_py() or []), len(t)) for x in batch.column(1)]  # the tokens of one text at a time
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([m[k] for m in made], pa.int64()) for k in (0, 1))], names=[key, "simhash", "n_tokens"])

    return df.select(F.col(key).cast("long").alias(key), plain_tokens(F.col(text)).alias("t")).mapInArrow(run, f"{key} long, simhash long, n_tokens long")
