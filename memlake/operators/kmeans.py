"""K-means over all rows, and the rows nearest to each centre as a sample.

Seeds are k rows by hash. In a round every task sums the rows of each centre;
only these sums, k to a task, are exchanged, and only the centres come to the
driver. Sums are rounded, so that the order in which they are added changes no
assignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.storage import materialize

#: Rounds at most, seed, digits of centres and distances that count.
ROUNDS, SEED, DIGITS = 20, 29, 9


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centre of each row (of equal ones the first) and the squared distance to it."""
    d = np.round(np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * (x @ centres.T), 0), DIGITS)
    own = np.argmin(d, axis=1)
    return own, d[np.arange(len(x)), own]


def _stacked(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.array(batch.column(at).to_pylist(), dtype=float)


def centres_of(rows: DataFrame, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k centres, or as many as there are rows; rows: key, vec (sound, of one length). Rounds end when no centre moves; one that loses its rows stays."""
    seeds = rows.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(k).collect()
    centres = np.array([r["vec"] for r in seeds], dtype=float)
    for _ in range(rounds if len(centres) else 0):

        def sums(batches: Iterator[pa.RecordBatch], centres: np.ndarray = centres) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                if batch.num_rows:
                    x = _stacked(batch, 0)
                    own, _ = _nearest(x, centres)
                    np.add.at(total, own, x)
                    n += np.bincount(own, minlength=len(n))
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), pa.array(total[held].tolist(), pa.list_(pa.float64()))], names=["c", "n", "s"])

        parts = rows.select("vec").mapInArrow(sums, "c long, n long, s array<double>").select("c", "n", F.posexplode("s").alias("p", "x"))
        added = parts.groupBy("c", "p").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()  # k vectors
        moved = centres.copy()
        for r in added:
            moved[r["c"], r["p"]] = round(r["x"] / r["n"], DIGITS)
        if (moved == centres).all():
            break
        centres = moved
    return centres


def sampled(df: DataFrame, key: str, vector: str, k: int, each: int = 3, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """key, centre (int), distance (squared), rank (from 1): the `each` rows nearest to each of k centres, ties by key.

    Rows with a null key or vector, a null or NaN component, or another length
    than most rows have take no part; an empty table gives none.
    """
    sound = F.coalesce(F.expr(f"{key} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x))"), F.lit(False))
    rows = df.where(sound).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec"))
    rows = materialize(rows, "vectors")
    most = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vec") == (most["n"] if most else 0))
    centres = centres_of(rows, k, rounds, seed)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, d = _nearest(_stacked(batch, 1), centres)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(d)], names=["key", "centre", "distance"])

    found = rows.mapInArrow(assigned, "key long, centre int, distance double")
    rank = F.row_number().over(Window.partitionBy("centre").orderBy("distance", "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= each).withColumnRenamed("key", key)
