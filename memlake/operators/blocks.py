"""Tables that are compared block with block: written once in the shared folder, where each task reads the blocks that it compares.

Nothing is copied for a task, so that disk grows with the tables, and memory is a block with a block whatever their sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from memlake.storage import new_path

#: Rows of a batch that a task hands on.
BATCH = 1 << 16


def written(df: DataFrame, rows: int, name: str) -> list[str]:
    """The files of `df` in the shared folder, of at most so many rows each."""
    path = new_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return sorted(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())


def block(uri: str) -> pa.Table:
    """A file of the shared folder, in a task."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return pq.ParquetFile(f).read(use_threads=False).combine_chunks()


def column(rows: pa.Table, name: str) -> pa.Array:
    found = rows[name]
    return found.chunk(0) if found.num_chunks else pa.array([], found.type)


def dealt(spark: SparkSession, n: int, run: Callable[[int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `run` makes of the numbers below n; neighbours come in one task."""
    each = 64 * spark.sparkContext.defaultParallelism

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from run(k)

    return spark.range(0, n, 1, max(1, min(n, each))).mapInArrow(task, schema)


def pairs_of(n: int, k: int) -> tuple[int, int]:
    """The k-th of the pairs (i, j), i <= j < n, by i and then j."""
    i = int(n + 0.5 - np.sqrt((n + 0.5) ** 2 - 2 * k))
    first = lambda i: i * n - i * (i - 1) // 2
    i += (first(i + 1) <= k) - (first(i) > k)
    return i, k - first(i) + i
