"""Phrase collocations by PCY/DHP: hashed bucket counts and Apriori prune the n-grams before they are counted exactly.

A pass over the texts counts the n-grams of one length exactly, those only that
can be frequent: both n-grams of one word less are frequent (Apriori, by a
bitmap of the frequent ones), and so is their bucket. In the same pass the
n-grams of one word more, of which both parts can be frequent, are hashed into
buckets and the buckets counted. A task counts up to `least` in a bucket, as
more makes no difference. The bitmaps have a fixed number of bits, so what is
broadcast doesn't grow with the corpus; where all buckets fill up, fewer n-grams
are pruned and counts stay exact. Tasks count blocks of text by 64-bit hashes
and send each n-gram of a block once, as text; Spark adds them up by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import Hashes, materialize, raw, slices
from memlake.llm.substrings import mixed

#: Words of the longest phrase, least count of a phrase, rows for each language, percent of a phrase's count from which a longer one takes its place.
LONGEST, LEAST, TOP, SHARE = 3, 10, 2000, 50
#: Buckets are 2^BITS (a bitmap has 8 MB, a task's counts 64 MB), sent in chunks of 2^CHUNK; bytes of text counted at a time.
BITS, CHUNK, BLOCK = 26, 18, 1 << 23
#: Separators of pieces become ".", which no word holds; A-Z become a-z.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")
_END = np.uint64(xxhash.xxh3_64_intdigest(b"."))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROWS = "lang string, phrase string, n long, chunk int, counts binary"


def _blocks(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """The words of the texts, with "." between pieces, in blocks that end with a piece."""
    whole, at = b".".join(texts).translate(_PLAIN), 0
    while at < len(whole):
        end = whole.find(b".", at + size)
        end = len(whole) if end < 0 else end
        yield whole[at:end].replace(b".", b" . ").split()
        at = end


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), 1))


def _grown(keys: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
    """Keys of the n-grams of m words from those of m - 1 words that begin at the same places."""
    return mixed(keys[: max(0, len(ids) - m + 1)] * _STEP + ids[m - 1 :])


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = _place(keys, len(bitmap).bit_length() + 2)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class _Buckets:
    """Counts of buckets, none above `least`."""

    def __init__(self, least: int, bits: int):
        self.bits, self.least, self.kind = bits, least, np.uint8 if least < 128 else np.uint32
        self.counts: np.ndarray | None = None

    def add(self, keys: np.ndarray) -> None:
        if self.counts is None:
            self.counts = np.zeros(1 << self.bits, self.kind)
        at, n = np.unique(_place(keys, self.bits).astype(np.uint32), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + n, self.least).astype(self.kind)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for k in range(0 if self.counts is None else 1 << (self.bits - CHUNK)):
            part = self.counts[k << CHUNK : (k + 1) << CHUNK]
            if part.any():
                yield _batch([None], [None], [None], [k], [pa.compress(part.tobytes(), "zstd", asbytes=True)])


def _batch(lang: list, phrase, n, chunk: list, counts: list) -> pa.RecordBatch:
    phrase = pa.array(phrase, pa.binary()).view(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), phrase, pa.array(n, pa.int64()), pa.array(chunk, pa.int32()), pa.array(counts, pa.binary())], names=["lang", "phrase", "n", "chunk", "counts"]
    )


def _counted(m: int, last: bool, least: int, bits: int, block: int, parts: Broadcast | None, full: Broadcast | None):
    """From (lang, text): counts of the n-grams of m words that can be frequent, and bucket counts of those of m + 1 unless this is the last pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, buckets = Hashes(), _Buckets(least, bits)
        frequent, bucket = (None, None) if m == 1 else (np.frombuffer(x.value, np.uint8) for x in (parts, full))
        held: dict[str, list[bytes]] = {}
        size = 0

        def count(lang: str, words: list[bytes]) -> pa.RecordBatch:
            ids = hashes.of(words)
            keys, inside = mixed(ids + _seed(lang)), ids != _END
            for k in range(2, m + 1):
                before, keys = keys, _grown(keys, ids, k)
                inside = inside[: len(keys)] & (ids[k - 1 :] != _END)
            can = inside
            if m > 1:
                seen = _marked(frequent, before)
                can = can & seen[: len(keys)] & seen[1 : len(keys) + 1]
                own = np.flatnonzero(can)
                can[own] = _marked(bucket, keys[own])
            if not last and len(keys) > 1:
                longer = np.flatnonzero(can[:-1] & can[1:])
                buckets.add(mixed(keys[longer] * _STEP + ids[longer + m]))
            own = np.flatnonzero(can)
            _, first, n = np.unique(keys[own], return_index=True, return_counts=True)
            at = own[first].tolist()
            phrases = [words[i] for i in at] if m == 1 else [b" ".join(words[i : i + m]) for i in at]
            n = n.tolist()
            if m == 1:  # no word is empty, so that this stands for all words
                phrases.append(b"")
                n.append(len(own))
            return _batch([lang] * len(n), phrases, n, [None] * len(n), [None] * len(n))

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in held.items():
                for words in _blocks(texts, block):
                    yield count(lang, words)
            held.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                held.setdefault(lang, []).append(text)
                size += len(text)
            if size >= block:
                yield from flush()
                size = 0
        yield from flush()
        yield from buckets.rows()

    return run


def _keyed(m: int, least: int, bits: int):
    """Bucket counts that mark the given phrases of m words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, buckets = Hashes(), _Buckets(least, bits)
        for batch in batches:
            phrases = [x.split(b" ") for x in raw(batch.column(1))]
            if phrases:
                langs = batch.column(0).to_pylist()
                seeds = {x: _seed(x) for x in set(langs)}
                ids = [hashes.of([p[k] for p in phrases]) for k in range(m)]
                keys = mixed(ids[0] + np.array([seeds[x] for x in langs], np.uint64))
                for x in ids[1:]:
                    keys = mixed(keys * _STEP + x)
                buckets.add(np.repeat(keys, least))
        yield from buckets.rows()

    return run


def _bits(least: int):
    """The bits of each chunk's buckets of `least` or more; chunks come together by partition, their rows one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _Buckets(least, CHUNK).kind
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(pa.decompress(data, np.dtype(kind).itemsize << CHUNK, "zstd", asbytes=True), kind)
                sums[k] = np.minimum(sums[k] + got, least).astype(kind) if k in sums else got
        rows = [(k, np.packbits(x >= least, bitorder="little").tobytes()) for k, x in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", "bits"])

    return run


def _bitmap(counts: DataFrame, least: int, bits: int) -> Broadcast:
    """All chunks' bits, broadcast: 2^bits bits, whatever the corpus."""
    found = counts.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(_bits(least), "chunk int, bits binary")
    bitmap, step = bytearray(1 << (bits - 3)), 1 << (CHUNK - 3)
    for row in found.collect():
        bitmap[row["chunk"] * step : (row["chunk"] + 1) * step] = row["bits"]
    return counts.sparkSession.sparkContext.broadcast(bytes(bitmap))


def count_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS, block: int = BLOCK) -> list[DataFrame]:
    """For each length from 1 to `longest`, the frequent phrases: (lang, phrase, f); among those of length 1 a phrase "" with all words of a language.

    docs: lang, text. All occurrences count, overlaps included, none across
    pieces. A null text has no words, a null lang is `und`.
    """
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found: list[DataFrame] = []
    full = None
    for m in range(1, longest + 1):
        parts = _bitmap(found[-1].where("phrase <> ''").mapInArrow(_keyed(m - 1, least, bits), _ROWS), least, bits) if m > 1 else None
        made = materialize(texts.mapInArrow(_counted(m, m == longest, least, bits, block, parts, full), _ROWS), f"phrases-{m}")
        sums = made.where("chunk is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        found.append(materialize(sums.where((F.col("f") >= least) | (F.col("phrase") == "")), f"frequent-{m}"))
        for x in (parts, full):
            if x is not None:
                x.unpersist()
        full = _bitmap(made, least, bits) if m < longest else None
    return found


def _part(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("_w", first, n), " ")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = SHARE, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score (numbers long): of each lang the `top` phrases of 2 to `longest` words of the highest scores.

    docs: lang, text; other columns are not read. a counts the phrase, l and r
    the parts of its lowest-scoring cut (of equal ones, the first), n all words
    of the lang; score is floor(1000000 * a * a / (l * r)). Phrases within a
    longer frequent one of `share` percent of their count or more go. Ties go to
    the larger a, then to the phrase that is first in UTF-8. Null and empty
    texts have no words, rows that repeat count each, a null lang is `und`; an
    empty table gives none. Counts up to 10^15 are exact.
    """
    counts = count_phrases(docs, longest, least, bits, block)
    split = lambda df: df.withColumn("_w", F.split("phrase", " "))
    phrases = counts[1]
    for x in counts[2:]:
        phrases = phrases.union(x)
    # what stands within a longer phrase, with the largest count of such
    inner = [
        split(counts[m - 1]).select("lang", "f", F.explode(F.array_distinct(F.array(*(_part(i + 1, k) for k in range(2, m) for i in range(m - k + 1))))).alias("phrase"))
        for m in range(3, longest + 1)
    ]
    left = phrases
    if inner:
        held = inner[0]
        for x in inner[1:]:
            held = held.union(x)
        left = phrases.join(held.groupBy("lang", "phrase").agg(F.max("f").alias("_f")), ["lang", "phrase"], "left").where(f"_f is null or 100 * _f < {share} * f").drop("_f")
    parts = counts[0].where("phrase <> ''")
    for x in counts[1:-1]:
        parts = parts.union(x)
    cuts = split(left).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("_w") - 1))).select("lang", "phrase", F.col("f").alias("a"), "k", _part(1, F.col("k")).alias("_l"), _part(F.col("k") + 1, F.size("_w")).alias("_r"))
    of = lambda name, f: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    wide = lambda c: f"cast({c} as decimal(15, 0))"
    score = f"cast(1000000 as decimal(7, 0)) * {wide('a')} * {wide('a')} div ({wide('l')} * {wide('r')})"
    scored = cuts.join(of("_l", "l"), ["lang", "_l"]).join(of("_r", "r"), ["lang", "_r"]).withColumn("score", F.expr(score))
    best = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("_b"))
    best = best.select("lang", "phrase", "a", F.col("_b.l").alias("l"), F.col("_b.r").alias("r"), F.col("_b.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = best.withColumn("rank", rank).where(F.col("rank") <= top)
    words = counts[0].where("phrase = ''").select("lang", F.col("f").alias("n"))
    return first.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
