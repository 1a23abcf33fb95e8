"""An inverted file of vectors: lists around coarse centroids, written once; a search reads some lists, or all of them.

Centroids are fitted on a bounded sample (`SAMPLE` rows by hash); every row goes
to the list of its nearest centroid. A search compares each asked vector with
the rows of its `probes` nearest lists, exactly; with all lists the result is
exact. Lists of many rows are dealt into parts, so that no task holds more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.vectors import _distances
from memlake.storage import materialize, new_path

#: Rows that centroids are fitted on at most, rounds, most centroids, rows of a part of a list and asked vectors at a time, seed.
SAMPLE, ROUNDS, MOST, PART, ASKED, SEED = 8192, 10, 1024, 16384, 4096, 7


def fitted(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """k unit centroids of the rows by cosine: seeded spread, then rounds of means; what loses all rows keeps its place."""
    rng = np.random.default_rng(seed)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    chosen = [int(rng.integers(len(x)))]
    apart = 1 - x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        weight = np.maximum(apart, 0) ** 2
        chosen.append(int(rng.choice(len(x), p=weight / weight.sum())) if weight.sum() > 0 else int(rng.integers(len(x))))
        apart = np.minimum(apart, 1 - x @ x[chosen[-1]])
    centroids = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-12, sums / np.maximum(size, 1e-300), centroids)
    return centroids


def _lists(vectors: list, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The numbers of the `probes` nearest centroids of each vector, nearest first."""
    x = np.array(vectors, dtype=float)
    return np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]


def _sound(vector: str, dim: int):
    return F.coalesce(F.expr(f"size({vector}) = {dim} and forall({vector}, x -> x is not null and not isnan(x)) and exists({vector}, x -> x <> 0)"), F.lit(False))


class VectorIndex:
    """The sound rows of `df` (key a long, vector an array) in lists: vectors of the length that most of the sample have, without nulls and
    not all zero; others are in no list and never found."""

    def __init__(self, df: DataFrame, key: str, vector: str, lists: int | None = None):
        rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vec")).where("vec is not null")
        sample = [r["vec"] for r in rows.orderBy(F.xxhash64(F.lit(SEED), "key", "vec")).limit(SAMPLE).collect()]
        self.dim = max({len(v) for v in sample} - {0}, key=lambda n: (sum(len(v) == n for v in sample), n), default=0)
        good = [v for v in sample if len(v) == self.dim and None not in v and np.isfinite(v).all() and any(v)]
        rows = rows.where(_sound("vec", self.dim))
        n = rows.count()
        self.centroids = fitted(np.array(good), lists or min(MOST, max(1, round(n**0.5)))) if good else np.zeros((1, max(1, self.dim)))
        centroids = self.centroids

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = _lists(batch.column(1).to_pylist(), centroids, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=["key", "vec", "list"])

        listed = materialize(rows.mapInArrow(assigned, "key long, vec array<double>, list int"), "listed")
        sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        # at most MOST rows
        self.sizes = materialize(sizes, "sizes")
        dealt = listed.join(F.broadcast(self.sizes), "list").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts")
        self.path = new_path(df.sparkSession, "lists")
        dealt.hint("rebalance", "list").write.partitionBy("list").parquet(self.path)
        self.rows = df.sparkSession.read.schema(dealt.schema).parquet(self.path)

    def search(self, asked: DataFrame, key: str, vector: str, k: int, probes: int | None = None, itself: bool = True) -> DataFrame:
        """asked, key, distance (negated cosine), rank (1 to k) of each asked row's nearest among its `probes` nearest lists, or exactly among all; ties by key."""
        centroids = self.centroids
        many = len(centroids) if probes is None else min(probes, len(centroids))
        own = asked.select(F.col(key).cast("long").alias("asked"), F.col(vector).cast("array<double>").alias("vec")).where(_sound("vec", self.dim))

        def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    found = _lists(part.column(1).to_pylist(), centroids, many)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(np.repeat(np.arange(len(found)), many))) for c in part.columns), pa.array(found.reshape(-1).astype(np.int32))], names=["asked", "vec", "list"])

        groups = max(1, -(-own.count() // ASKED))
        wanted = own.mapInArrow(probed, "asked long, vec array<double>, list int").join(F.broadcast(self.sizes), "list")
        wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("g", F.pmod(F.xxhash64("asked"), F.lit(groups)).cast("int")).drop("parts")
        searched = self.rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

        def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"asked": [], "key": [], "distance": []})
            b = b.sort_values("key", kind="stable", ignore_index=True)
            d = _distances(np.stack(a["vec"]), np.stack(b["vec"]), "cosine")
            own, found = a["asked"].to_numpy(), b["key"].to_numpy()
            if not itself:
                d[own[:, None] == found[None, :]] = np.nan
            best = np.argsort(d, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(own)), best.shape[1])
            made = pd.DataFrame({"asked": own[at], "key": found[best.ravel()], "distance": d[at, best.ravel()]})
            return made[made["distance"].notna()]

        on = ["list", "part", "g"]
        found = wanted.groupBy(*on).cogroup(searched.groupBy(*on)).applyInPandas(compare, "asked long, key long, distance double")
        rank = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "key"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)
