"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, distributed components.

Equal vectors of a label are one class. Each class gets one signature a table:
the signs of its products with random hyperplanes. The bits of a signature grow
with the logarithm of the number of classes, and the tables with them, so that
a pair right at the threshold is missed by all tables with a probability of
`MISSED` at most. Classes with an equal signature are compared by exact cosine;
a pair counts in the first table that brings it together, so that no pairs are
sent or sorted. Buckets of many classes are dealt into tiles, each with all
pairs of two parts, which together compare all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import connected_components, materialize

#: Least cosine of a link, chance of missing a pair there, classes a bucket should have and may have in one piece, seed.
COSINE, MISSED, IN_BUCKET, PART, SEED = 0.98, 1e-4, 32, 1024, 20
#: Buckets of many classes that are broadcast at most; beyond, they are joined by a shuffle.
BROADCAST = 100_000


def tables_for(n: int, cosine: float = COSINE, missed: float = MISSED) -> tuple[int, int]:
    """Bits of a signature and number of tables for n classes."""
    bits = min(30, max(4, round(math.log2(max(1, n) / IN_BUCKET))))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - together))


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs << np.arange(bits)).sum(axis=2).astype("<u4")


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1, so that products neither vanish nor overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _signed(bits: int, tables: int, with_vectors: str = ""):
    """A row for each class and table: label, cid, tab, sig and, if a type of number is given, mult, the signatures of earlier tables and the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column(3).to_pylist()
                dims = np.array([len(x) for x in lists])
                for dim in np.unique(dims):  # one in most tables
                    own = np.flatnonzero(dims == dim)
                    vectors = scaled(np.array([lists[k] for k in own], dtype=np.float64))
                    s = signatures(vectors, bits, tables)
                    repeat = lambda c: pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False)[own], tables))  # noqa: E731, B023
                    columns = [repeat(0), repeat(1), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(s.reshape(-1).astype(np.int64))]
                    if with_vectors:
                        whole_vectors = [x.tobytes() for x in vectors.astype(with_vectors)]
                        columns += [repeat(2), pa.array([x[:t].tobytes() for x in s for t in range(tables)]), pa.array([x for x in whole_vectors for _ in range(tables)])]
                    yield pa.RecordBatch.from_arrays(columns, names=["label", "cid", "tab", "sig", "mult", "sigs", "vec"][: len(columns)])

    return run


def _linked(cosine: float, number: str):
    """Of each tile's classes with links: cid, links (weighted by mult), root (the smallest cid that they connect it to)."""

    def compare(tab: int, i: int, j: int, part: np.ndarray, cid: np.ndarray, mult: np.ndarray, sigs: list[bytes], vecs: list[bytes]):
        none = (cid[:0], mult[:0], cid[:0])
        sizes = {len(v) for v in vecs}
        if len(sizes) > 1:  # vectors of different lengths never link
            found = [compare(tab, i, j, part[k], cid[k], mult[k], [sigs[x] for x in k], [vecs[x] for x in k]) for z in sizes for k in [np.array([n for n, v in enumerate(vecs) if len(v) == z])]]
            return tuple(np.concatenate(c) for c in zip(*found, strict=True))
        if len(cid) < 2:
            return none
        x = np.frombuffer(b"".join(vecs), number).reshape(len(cid), -1).astype(np.float64)
        s = np.frombuffer(b"".join(sigs), "<u4").reshape(len(cid), tab)
        left, right = (np.arange(len(cid)),) * 2 if i == j else (np.flatnonzero(part == i), np.flatnonzero(part == j))
        if not len(left) or not len(right):
            return none
        size = np.sqrt((x * x).sum(axis=1))
        close = (x[left] @ x[right].T) / (size[left][:, None] * size[right][None, :]) >= cosine
        a, b = np.nonzero(close)
        a, b = left[a], right[b]
        new = cid[a] != cid[b]
        if i == j:
            new &= a < b
        a, b = a[new], b[new]
        new = ~(s[a] == s[b]).any(axis=1)
        a, b = a[new], b[new]
        if not len(a):
            return none
        links = np.zeros(len(cid), np.int64)
        np.add.at(links, a, mult[b])
        np.add.at(links, b, mult[a])
        root, before = cid.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            least = np.minimum(root[a], root[b])
            np.minimum.at(root, a, least)
            np.minimum.at(root, b, least)
        own = links > 0
        return cid[own], links[own], root[own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        made: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def close() -> None:
            nonlocal rows
            columns = list(zip(*held, strict=True))
            made.append(compare(key[1], key[3], key[4], *(np.array(c, np.int64) for c in columns[:3]), list(columns[3]), list(columns[4])))
            rows += len(made[-1][0])

        def out() -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*made, strict=True)] if made else [np.zeros(0, np.int64)] * 3
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cid", "links", "root"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:5] != key:
                    if len(held) > 1:
                        close()
                    key, held = row[:5], []
                    if rows > 50_000:
                        yield out()
                        made, rows = [], 0
                held.append(row[5:])
        if len(held) > 1:
            close()
        yield out()

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, missed: float = MISSED) -> DataFrame:
    """vec_id, n_links, component_id (long), kept of each row of `vectors` (vec_id, embedding, label).

    Two rows link if their labels are equal and their vectors have the same
    length and a cosine of at least `cosine`. Rows whose vec_id, label or
    vector is null, or whose vector is empty, zero or has null or non-finite
    components, link with nothing and are their own component. Equal rows link
    like other equal vectors; rows that share a vec_id and differ in vector or
    label are vectors of their own. Other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    sound = F.expr(
        "vec_id is not null and label is not null and size(embedding) > 0 and exists(embedding, x -> x <> 0) "
        "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    valid = rows.where(F.coalesce(sound, F.lit(False)))
    grouped = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("mult"))
    # numbers that hold once they are written
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # floats are sent as such; scaling by a power of two changes no digit of them but of components below 2^-126 of the largest
    number = "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    bits, tables = tables_for(classes.count(), cosine, missed)
    # labels by hash, so that they may be of any type
    source = classes.select(F.xxhash64("label").alias("label"), "cid", "mult", "embedding")
    where = ["label", "tab", "sig"]
    counts = source.mapInArrow(_signed(bits, tables), "label long, cid long, tab int, sig long").groupBy(*where).count()
    many = materialize(counts.where(F.col("count") > PART).select(*where, F.ceil(F.col("count") / PART).cast("int").alias("parts")), "many")
    signed = source.mapInArrow(_signed(bits, tables, number), "label long, cid long, tab int, sig long, mult long, sigs binary, vec binary")
    dealt = signed.join(F.broadcast(many) if many.count() <= BROADCAST else many, where, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    tiles = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *where, F.least("part", "_o").alias("i"), F.greatest("part", "_o").alias("j"), F.col("part").cast("long").alias("part"), "cid", "mult", "sigs", "vec"
    )
    key = [*where, "i", "j"]
    found = tiles.repartition(*key).sortWithinPartitions(*key).mapInArrow(_linked(cosine, number), "cid long, links long, root long")
    found = materialize(found, "found")
    labels = connected_components(classes.select(F.col("cid").alias("id")), found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    labelled = classes.join(labels.withColumnRenamed("id", "cid").withColumnRenamed("component_id", "_c"), "cid")
    smallest = labelled.groupBy("_c").agg(F.min("first").alias("c"))
    of_class = (
        labelled.join(links, "cid", "left").join(smallest, "_c")
        .select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n"), "c")
    )
    # a row that is not sound has no class and finds none
    keyed = rows.withColumn("_s", F.coalesce(sound, F.lit(False)))
    joined = keyed.join(of_class, F.col("_s") & (keyed.label == F.col("_l")) & (keyed.embedding == F.col("_e")), "left")
    component = F.coalesce("c", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
