"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt into blocks by a hash; only the blocks' row counts come to the
driver. There a matrix says how many rows each block sends to each cell, where
a shard is a row of cells of fixed sizes. Its rows are drawn one after another
from the multivariate hypergeometric law on what the cells still lack, which
is the law that a uniform permutation of all rows would give. Each block
permutes its rows and sends runs of them by the matrix (the exchange); each
cell permutes what it got. As the cells' sizes are known beforehand, a row's
slot is its cell's first slot plus its place in the cell, and no task ever
holds a shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a block or a cell should have at most, and the bounds of their number.
ROWS_PER_BLOCK, FEWEST, MOST = 1 << 18, 256, 4096


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` rows drawn from good + bad are good."""
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return sample
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, sample))
    # numpy's sampler ends there; beyond it, a ratio of uniforms (Stadlober) with a hat around the mode
    n, k, total = sample, good, good + bad
    mean = n * k / total
    var = mean * (bad / total) * (total - n) / (total - 1)
    mode = (n + 1) * (k + 1) // (total + 2)
    low, high = max(0, n - bad), min(n, k)

    def log_f(x: int) -> float:
        return -(math.lgamma(x + 1) + math.lgamma(k - x + 1) + math.lgamma(n - x + 1) + math.lgamma(bad - n + x + 1))

    top, width = log_f(mode), 2 * math.sqrt(2 / math.e) * math.sqrt(var + 0.5) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= x <= high and 2 * math.log(u) <= log_f(x) - top:
            return x


def communication_matrix(counts: list[int], cells: list[int], seed: int) -> np.ndarray:
    """Rows that each block sends to each cell; row sums are `counts`, column sums `cells`."""
    rng, left, out = np.random.default_rng(seed), list(cells), np.zeros((len(counts), len(cells)), dtype=np.int64)
    lacking = sum(left)
    for p, count in enumerate(counts):
        rest, population = count, lacking
        for j, size in enumerate(left):
            if rest == 0:
                break
            out[p, j] = got = _hypergeometric(rng, size, population - size, rest)
            population -= size
            rest -= got
            left[j] -= got
        lacking -= count
    return out


def shard_uniform(df: DataFrame, keys: list[str], shards: int = 16, seed: int = 0) -> DataFrame:
    """`df` with shard (int, 0 to shards - 1) and slot (long, from 0 without gaps in each shard).

    Shards' row counts are at most one apart and every permutation of the rows
    is equally likely. `keys` name the columns that tell rows apart; they alone
    and the seed decide, so a task that runs again places its rows as before.
    Rows equal in all keys (repeats) are placed each, in either order; nulls
    count as a value; an empty table gives an empty one. Columns of `df`
    called shard or slot are replaced.
    """
    df = df.drop("shard", "slot")
    dealt = df.withColumn("_h", F.xxhash64(F.lit(seed), *keys))
    sizes = dealt.groupBy(F.pmod("_h", F.lit(MOST)).cast("int").alias("_b")).count()
    # fine blocks are put together, so that one pass over the data gives the counts for any number of blocks
    fine = np.zeros(MOST, dtype=np.int64)
    for row in sizes.collect():  # at most MOST counts
        fine[row["_b"]] = row["count"]
    total = int(fine.sum())
    n = FEWEST
    while n < MOST and total > n * ROWS_PER_BLOCK:
        n *= 2
    counts = fine.reshape(-1, n).sum(axis=0).tolist()  # block = fine block mod n
    per = max(1, n // shards)
    size = [total // shards + (s < total % shards) for s in range(shards)]
    cells = [size[s] // per + (c < size[s] % per) for s in range(shards) for c in range(per)]
    firsts = [f for s in range(shards) for f in np.cumsum([0, *cells[s * per : (s + 1) * per]])[:-1].tolist()]
    bounds = np.cumsum(communication_matrix(counts, cells, seed), axis=1)

    spark = df.sparkSession
    plan = spark.createDataFrame(
        [(b, row) for b, row in enumerate(bounds.tolist())],
        T.StructType([T.StructField("_b", T.IntegerType()), T.StructField("_to", T.ArrayType(T.LongType()))]),
    )
    first = F.array(*[F.lit(x) for x in firsts])
    local = Window.partitionBy("_b").orderBy(F.xxhash64(F.lit(seed + 1), *keys), *keys)
    sent = (
        dealt.withColumn("_b", F.pmod("_h", F.lit(n)).cast("int"))
        .withColumn("_r", F.row_number().over(local))
        .join(plan, "_b")
        # the cell is the first whose running total reaches the row's place: a search by halves in the sorted totals
        .withColumn("_cell", _first_reaching("_to", "_r", len(cells)))
    )
    again = Window.partitionBy("_cell").orderBy(F.xxhash64(F.lit(seed + 2), *keys), *keys)
    return (
        sent.withColumn("_p", F.row_number().over(again) - 1)
        .withColumn("shard", (F.col("_cell") / per).cast("int"))
        .withColumn("slot", (F.element_at(first, F.col("_cell") + 1) + F.col("_p")).cast("long"))
        .drop("_h", "_b", "_r", "_to", "_cell", "_p")
    )


def _first_reaching(totals: str, place: str, n: int):
    """Index (int) of the first of n sorted totals that is at least `place`."""
    steps = max(1, math.ceil(math.log2(n + 1)))
    return F.expr(
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {n - 1}), (s, i) -> "
        f"if(s.lo >= s.hi, s, if({totals}[cast((s.lo + s.hi) / 2 as int)] >= {place}, "
        "named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) / 2 as int)), "
        "named_struct('lo', cast((s.lo + s.hi) / 2 as int) + 1, 'hi', s.hi))), s -> s.lo)"
    )
