"""A text index that is written once: postings and trigrams in buckets of terms, additions and deletions as later parts.

A part holds the postings of the texts that it adds, in folders by bucket of the
term's hash and sorted by term, so that a query reads the folders of its terms
and skips what lies outside; and the keys that it deletes. A row has the keys of
a few texts that hold the term, not one, so what is exchanged and sorted is short. A text that comes
again in a later part replaces what it was. Buckets of frequent terms are split
over several files. Trigrams only say which texts can hold a string; it is then
looked for in the texts themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.functions.text import tokens

#: Folders of a part, and BM25's parameters.
BUCKETS, K1, B = 64, 1.5, 0.75
#: Bytes of the texts whose postings are made at a time; one text at least.
AT_A_TIME = 1 << 21


def _bucket(term: str, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int").alias("bucket")


#: Codes of the terms of some texts in turn, the texts' numbers, and what codes stand for.
Terms = tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]


def _words(texts: list[str]) -> Terms:
    """The tokens of lower-cased texts."""
    found = [re.findall("[a-z0-9]+", t) for t in texts]
    flat = pa.array(chain.from_iterable(found), pa.string()).dictionary_encode()
    return flat.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(found)), [len(f) for f in found]), lambda x: flat.dictionary.take(pa.array(x)).to_pylist()


def _trigrams(texts: list[str]) -> Terms:
    """The runs of three characters."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    one = np.flatnonzero(of[2:] == of[:-2])
    held = np.zeros(0x110000, bool)
    held[points] = True
    alphabet = np.flatnonzero(held)
    rank, n = (np.cumsum(held) - 1)[points], len(alphabet)
    code, own = (rank[one] * n + rank[one + 1]) * n + rank[one + 2], [chr(x) for x in alphabet.tolist()]
    name = lambda x: [own[y // (n * n)] + own[y // n % n] + own[y % n] for y in x.tolist()]
    if n**3 * len(texts) < 1 << 62:
        return code, of[one], name
    known, code = np.unique(code, return_inverse=True)
    return code, of[one], lambda x: name(known[x])


def _postings(docs: DataFrame, key: str, text: str, terms: Callable[[list[str]], Terms]) -> DataFrame:
    """term, key, tf, size: the texts of a few rows that hold a term, how often they do, and how many terms they have, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_A_TIME, side="right")))
                own = batch.slice(at, end - at)
                term, of, name = terms(own.column(1).to_pylist())
                sizes = np.bincount(of, minlength=own.num_rows)
                both = np.sort(term * own.num_rows + of)
                new = np.flatnonzero(np.diff(both, prepend=-1))
                term, of = both[new] // own.num_rows, both[new] % own.num_rows
                first = np.flatnonzero(np.diff(term, prepend=-1))
                cuts = pa.array(np.append(first, len(term)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, x) for x in (own.column(0).take(pa.array(of)), pa.array(np.diff(new, append=len(both))), pa.array(sizes[of]))]
                yield pa.RecordBatch.from_arrays([pa.array(name(term[first]), pa.string()), *lists], names=["term", "key", "tf", "size"])
                at = end

    sent = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    return sent.mapInArrow(run, f"term string, key array<{docs.schema[key].dataType.simpleString()}>, tf array<long>, size array<long>")


def add_part(docs: DataFrame, path: str, part: int, key: str, text: str, deleted: DataFrame | None = None, buckets: int = BUCKETS, kinds: tuple[str, ...] = ("postings", "trigrams")) -> None:
    """Write part number `part` of the index at `path`: the texts of `docs` (one row a key) and the keys of `deleted`. Writing it again replaces it.

    Each key should be in one row. Without one of the kinds the searches that need it find nothing.
    """

    def put(rows: DataFrame, kind: str, *order: str) -> None:
        # even files, those of frequent terms several to a bucket
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{kind}/part={part}")

    bucket = _bucket("term", buckets)
    if "postings" in kinds:
        put(_postings(docs, key, text, _words).withColumn("bucket", bucket), "postings", "term")
    if "trigrams" in kinds:
        put(_postings(docs, key, text, _trigrams).select("key", "term", bucket), "trigrams", "term")
    words = docs.select(F.col(key).alias("key"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    sizes = words.select("key", F.size("_w").cast("long").alias("size"), F.lit(False).alias("deleted"))
    gone = deleted.select(F.col(key).alias("key"), F.lit(None).cast("long").alias("size"), F.lit(True).alias("deleted")) if deleted is not None else None
    (sizes.unionByName(gone) if gone is not None else sizes).write.mode("overwrite").parquet(f"{path}/sizes/part={part}")


class TextIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        rows = spark.read.option("basePath", f"{path}/sizes").parquet(f"{path}/sizes")
        # what each key is by its last part; in a part that deletes a key and adds it, it is added
        last = rows.groupBy("key").agg(F.max_by(F.struct("size", "deleted"), F.struct("part", ~F.col("deleted"))).alias("_s"), F.max("part").alias("part"))
        self.live = last.where("not _s.deleted").select("key", "part", F.col("_s.size").alias("size"))
        self.parts = rows.select("part").distinct().count()

    def read(self, kind: str, terms: list[str], *columns: str, begins: bool = False) -> DataFrame:
        """The live entries of these terms; their buckets' folders alone are read. With `begins` of all terms that begin so, from all folders."""
        rows = self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")
        if begins:
            found = rows.where(reduce(lambda a, b: a | b, (F.col("term").startswith(t) for t in terms)))
        else:
            numbers = [r["bucket"] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket("term", self.buckets)).distinct().collect()]
            found = rows.where(F.col("bucket").isin(numbers) & F.col("term").isin(terms))
        found = found.select("term", "part", F.inline(F.arrays_zip("key", *columns)))
        # one part has no older forms of a text and deletes nothing of its own
        return (found if self.parts == 1 else found.join(self.live.select("key", "part"), ["key", "part"], "left_semi")).select("key", "term", *columns)

    def bm25(self, terms: list[str]) -> DataFrame:
        """key, score of the texts that hold one of the terms."""
        n, mean = self.live.agg(F.count("*"), F.avg("size")).first()
        found = self.read("postings", terms, "tf", "size")
        df = found.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
        return found.join(F.broadcast(df), "term").groupBy("key").agg(F.sum(idf * weight).alias("score")).where("score > 0")

    def holding(self, groups: list[list[str]], begins: bool = False) -> DataFrame:
        """key of the texts that hold a term of each group; with `begins`, a term that begins with one of the group."""
        every = sorted({t for g in groups for t in g})
        found = self.read("postings", every, begins=begins)
        fits = lambda g: reduce(lambda a, b: a | b, (F.col("term").startswith(t) for t in g)) if begins else F.col("term").isin(g)
        flags = found.groupBy("key").agg(*(F.max(fits(g)).alias(f"_{k}") for k, g in enumerate(groups)))
        return flags.where(" and ".join(f"_{k}" for k in range(len(groups)))).select("key")

    def containing(self, docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
        """The live rows of `docs` whose text holds the string, in any case: those with all of its trigrams, then looked at."""
        low = part.lower()
        grams = sorted({low[k : k + 3] for k in range(len(low) - 2)})
        rows = docs.join(self.live.select(F.col("key").alias(key)), key, "left_semi") if self.parts > 1 else docs
        if grams:
            can = self.read("trigrams", grams).groupBy("key").agg(F.count_distinct("term").alias("_n")).where(F.col("_n") == len(grams))
            rows = rows.join(can.select(F.col("key").alias(key)), key, "left_semi")
        return rows.where(F.contains(F.lower(text), F.lit(low)))
