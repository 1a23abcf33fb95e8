"""Substring dedup: documents parsed into factors relative to every reference block.

A block is the documents that a task holds at a time. Its index names each
window of `window` words by an anchor, the least hash of `ANCHOR` words in it,
and by a fingerprint of the whole window, so that neighbours share an anchor
and cost six bytes each. A document is parsed against its own block at once:
windows that the block has before are settled, only first ones leave it. The
blocks' indexes then meet by anchor, which parses every document against all
blocks. Each window that has an earlier occurrence refers to the first one in
its own block or, where that has none, in all blocks, and a factor goes on greedily as long as the next window refers to the place after:
it is (start, words, reference document, reference start), `window` words or
more. Where the reference ends or another one is earlier, the next factor
begins; the windows over such boundaries are looked up like all others, so
that none is missed. The words of the factors are the duplicate spans.

Windows are compared by hashes (64 bits of the anchor and 48 of the window),
not by their words. Anchors that hold a large share of the windows (4096 at most) would gather in
one task. They are counted first, and their windows are dealt by their own hash.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import Hashes, raw, slices

WINDOW, ANCHOR = 20, 8
#: Words of a block; windows that a bucket should have at most; the fewest buckets.
BLOCK, PER_BUCKET, FEWEST_BUCKETS = 1 << 20, 1 << 18, 1024
#: Words that are hashed at a time.
AT_ONCE = 1 << 16
#: An anchor is heavy if it holds this share of the windows.
HEAVY = 1 / 4096

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each run of k of the hashes, from those of half as many."""
    if k == 1:
        return h
    n = len(h) - k + 1
    half = rolled(h, k // 2)
    out = half[:n] + np.uint64(pow(_BASE, k // 2, 1 << 64)) * half[k // 2 : k // 2 + n]
    return out + np.uint64(pow(_BASE, k - 1, 1 << 64)) * h[k - 1 : k - 1 + n] if k % 2 else out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slid_min(x: np.ndarray, k: int) -> np.ndarray:
    """Least of each run of k, from two shorter runs that cover it."""
    if k == 1:
        return x
    half = (k + 1) // 2
    m, n = slid_min(x, half), len(x) - k + 1
    return np.minimum(m[:n], m[k - half : k - half + n])


class Block:
    """Windows of some documents, in order of doc_id and start: text (its number, into doc and crc), start, whole (hash), anchor."""

    def __init__(self, docs: list[int], crcs: list[int], hashes: list[np.ndarray], window: int):
        order = sorted(range(len(docs)), key=docs.__getitem__)
        lengths = np.array([len(hashes[k]) for k in order])
        counts = lengths - window + 1
        ends = np.cumsum(counts)
        self.doc = np.array([docs[k] for k in order], dtype=np.int64)
        self.crc = np.array([crcs[k] for k in order], dtype=np.uint32)
        self.text = np.repeat(np.arange(len(order), dtype=np.int32), counts)
        self.start = np.empty(ends[-1], np.uint32)
        self.whole, self.anchor = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint64)
        k = min(ANCHOR, window)
        # some texts at a time, as hashing takes several times the room of what it makes
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // AT_ONCE, prepend=0))
        for a, z in itertools.pairwise(np.unique([0, *cuts, len(order)])):
            h = np.concatenate([hashes[k] for k in order[a:z]])
            n = len(h) - window + 1
            owner = np.repeat(np.arange(z - a), lengths[a:z])
            at = np.flatnonzero(owner[:n] == owner[window - 1 :])
            into = slice(ends[a] - counts[a], ends[z - 1])
            self.start[into] = at - (np.cumsum(lengths[a:z]) - lengths[a:z])[owner[at]]
            self.whole[into] = mixed(rolled(h, window)[at])
            self.anchor[into] = slid_min(mixed(rolled(h, k)), window - k + 1)[at]


def blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[Block]:
    table = Hashes()
    docs: list[int] = []
    crcs: list[int] = []
    hashes: list[np.ndarray] = []
    total = 0
    for batch in slices(batches):
        for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            h = table.of(text.split())
            if doc is not None and len(h) >= window:
                docs.append(doc)
                crcs.append(zlib.crc32(text))
                hashes.append(h)
                total += len(h)
            if total >= BLOCK:
                made = [Block(docs, crcs, hashes, window)]
                docs, crcs, hashes, total = [], [], [], 0
                yield made.pop()  # nothing of it stays here
    if docs:
        yield Block(docs, crcs, hashes, window)


def heavy_anchors(docs: DataFrame, window: int) -> tuple[list[int], int]:
    """Anchors of a large share of all windows (1 / HEAVY at most), and the number of windows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # an anchor that is heavy overall is heavy in some block
        def often(b: Block) -> pa.RecordBatch:
            anchors, times = np.unique(b.anchor, return_counts=True)
            few = times >= HEAVY * len(b.anchor)
            columns = [np.append(anchors[few].view(np.int64), 0), np.append(times[few], len(b.anchor)), np.append(np.ones(few.sum(), bool), False)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "n", "real"])

        return map(often, blocks(batches, window))

    counts = docs.mapInArrow(count, "anchor long, n long, real boolean").groupBy("anchor", "real").agg(F.sum("n").alias("n"))
    total = 0
    found = []
    for r in counts.orderBy("real", F.desc("n"), "anchor").limit(1 + int(1 / HEAVY)).collect():
        if not r["real"]:
            total = r["n"]
        elif r["n"] >= HEAVY * total:
            found.append(r["anchor"])
    return found, total


def _grouped(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted x."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)


#: Of a factor: the first window and the number of windows, and where the first window stands first.
FACTOR = np.dtype([("start", "<u4"), ("windows", "<u4"), ("of", "<i8"), ("at", "<u4")])


def _factors(doc: np.ndarray, crc: np.ndarray, start: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Windows (doc, crc, start) and their references (of, at) as factors: doc and crc of each document, and its factors as bytes."""
    order = np.lexsort((start, crc, doc))
    doc, crc, start, of, at = (x[order] for x in (doc, crc, start, of, at))
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])
    new = other.copy()
    new[1:] |= (start[1:] != start[:-1] + 1) | (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    made = np.zeros(len(begin), FACTOR)
    made["start"], made["windows"], made["of"], made["at"] = start[begin], np.diff(np.append(begin, len(doc))), of[begin], at[begin]
    first = np.flatnonzero(other[begin])
    return doc[begin[first]], crc[begin[first]], [made[a:b].tobytes() for a, b in zip(first, np.append(first, len(begin))[1:], strict=True)]


def indexed(b: Block, heavy: np.ndarray, bits: int) -> pa.RecordBatch:
    """bucket, doc_id, crc, data: factors of the windows that the block has before (doc_id is not null), and its index of the others, cut by bucket.

    heavy: sorted. The block's arrays are used up.
    """
    # against the own block: all but the first of equal windows are settled
    order = np.argsort(b.whole, kind="stable")
    begin = _grouped(b.whole[order])
    first = np.empty(len(order), np.int32)
    first[order] = np.repeat(order[begin].astype(np.int32), np.diff(np.append(begin, len(order))))
    del order, begin
    later = np.flatnonzero(first != np.arange(len(first), dtype=np.int32))
    first = first[later]
    own = (b.doc[b.text[first]] != b.doc[b.text[later]]) | (b.start[first] != b.start[later])
    later, first = later[own], first[own]
    text = b.text[later]
    settled, crcs, factors = _factors(b.doc[text], b.crc[text], b.start[later], b.doc[b.text[first]], b.start[first])
    left = np.ones(len(b.whole), bool)
    left[later] = False
    del later, first, own, text
    anchor, whole, text, start = (x[left] for x in (b.anchor, b.whole, b.text, b.start))
    b.anchor = b.whole = b.text = b.start = left = None
    if len(heavy):
        held = heavy[np.minimum(np.searchsorted(heavy, anchor), len(heavy) - 1)] == anchor
        anchor[held] = whole[held]
        del held
    # runs of neighbours with one anchor
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(anchor)))
    anchor, text, start = anchor[begin], text[begin], start[begin]
    bucket = (mixed(anchor + np.uint64(1)) >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cut = _grouped(bucket[order])
    index = []
    for r in np.split(order, cut[1:]) if len(cut) else []:
        n = length[r]
        w = whole[np.repeat(begin[r] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        index.append(
            np.array([len(r)], "<u4").tobytes() + anchor[r].tobytes() + b.doc[text[r]].tobytes() + b.crc[text[r]].astype("<u4").tobytes() + start[r].astype("<u4").tobytes()
            + n.astype("<u4").tobytes() + w.astype("<u4").tobytes() + (w >> np.uint64(32)).astype("<u2").tobytes()
        )
    to = np.concatenate([(mixed(settled.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32), bucket[order[cut]]])
    none = [None] * len(index)
    columns = [pa.array(to), pa.array([*settled.tolist(), *none], pa.int64()), pa.array([*crcs.tolist(), *none], pa.int64()), pa.array([*factors, *index], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "doc_id", "crc", "data"])


def parsed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, crc (of the text), factors (binary: see FACTOR) of the windows whose words also start earlier; several rows a document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heavy, total = heavy_anchors(docs, window)
    heavy = np.array(sorted(heavy), dtype=np.int64).view(np.uint64)
    bits = max(FEWEST_BUCKETS, total // PER_BUCKET).bit_length()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(lambda b: indexed(b, heavy, bits), blocks(batches, window))

    def match(indexes: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for x in indexes:
            n = int(np.frombuffer(x, "<u4", 1)[0])
            anchor, doc = np.frombuffer(x, "<u8", n, 4), np.frombuffer(x, "<i8", n, 4 + 8 * n)
            crc, start, length = (np.frombuffer(x, "<u4", n, 4 + 16 * n + 4 * k * n) for k in range(3))
            m = int(length.sum())
            low, high = np.frombuffer(x, "<u4", m, 4 + 28 * n), np.frombuffer(x, "<u2", m, 4 + 28 * n + 4 * m)
            inside = np.arange(m) - np.repeat(np.cumsum(length) - length, length)
            made = (np.repeat(anchor, length), low | high.astype(np.uint64) << np.uint64(32), np.repeat(doc, length), np.repeat(crc, length), np.repeat(start, length) + inside)
            for into, column in zip(parts, made, strict=True):
                into.append(column)
        anchor, print_, doc, crc, start = (np.concatenate(p) for p in parts)
        order = np.lexsort((print_, anchor))
        new = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (print_[order][1:] != print_[order][:-1])])
        group = np.cumsum(new) - 1
        many = order[np.bincount(group)[group] > 1]  # windows that come again
        group = group[np.bincount(group)[group] > 1]
        again = np.lexsort((start[many], doc[many], group))
        many, first = many[again], _grouped(group[again])
        first = np.repeat(many[first], np.diff(np.append(first, len(many))))
        earlier = (doc[first] != doc[many]) | (start[first] != start[many])
        many, first = many[earlier], first[earlier]
        return _factors(doc[many], crc[many], start[many], doc[first], start[first])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(*columns: np.ndarray | list) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "crc", "factors"])

        bucket, held = None, []
        for batch in slices(batches):
            settled: list[tuple[int, int, bytes]] = []
            for b, doc, crc, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc is not None:
                    settled.append((doc, crc, data))
                    continue
                if b != bucket and held:
                    yield rows(*match(held))
                    held = []
                bucket = b
                held.append(data)
            yield rows(*([x[k] for x in settled] for k in range(3)))
        if held:
            yield rows(*match(held))

    dealt = docs.mapInArrow(parse, "bucket int, doc_id long, crc long, data binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "doc_id long, crc long, factors binary")


def joined(pieces: np.ndarray, window: int) -> np.ndarray:
    """Factors in order, those in one where both the text and its reference go on; `windows` becomes words."""
    pieces = np.unique(pieces)
    new = np.ones(len(pieces), bool)
    end = pieces["start"] + pieces["windows"]
    new[1:] = (pieces["start"][1:] != end[:-1]) | (pieces["of"][1:] != pieces["of"][:-1]) | (pieces["at"][1:] != pieces["at"][:-1] + pieces["windows"][:-1])
    begin = np.flatnonzero(new)
    out = pieces[begin].copy()
    out["windows"] = end[np.append(begin, len(pieces))[1:] - 1] - out["start"] + window - 1 if len(out) else 0
    return out


def spans_of(factors: np.ndarray) -> list[tuple[int, int]]:
    """Word spans (end exclusive) of the factors, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for a, n in zip(factors["start"].tolist(), factors["windows"].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], a + n)
        else:
            out.append((a, a + n))
    return out


def _cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these spans of words and the white space after them."""
    at = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, last = [], 0
    for a, z in spans:
        out.append(text[last : at[a]])
        last = at[z]
    return b"".join([*out, text[last:]])


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_FACTOR = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "n_words", "of_doc", "of_start")])
MADE = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)),
    T.StructField("kept", T.StringType()), T.StructField("factors", T.ArrayType(_FACTOR)),
])


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with n_words, n_removed (long), spans (array<struct<start, end>> of words), kept (string: the kept words joined by one space), factors.

    A word goes if a window of `window` words over it also starts earlier: in
    a smaller doc_id or before in the same document. text becomes what is left
    of it, as it was spaced. factors (array<struct<start, n_words, of_doc,
    of_start>>) says where the words of the spans stand first. A null or empty text has no words. Rows that
    repeat a doc_id are positions of one document, whatever their texts: a window
    is not earlier than one of the same start. Rows without doc_id neither lose words nor cost others theirs.
    Columns of `docs` with the names above are replaced.
    """
    docs = docs.drop(*MADE.names)
    key = F.col("doc_id").cast("long")
    found = parsed(docs.select(key.alias("doc_id"), "text"), window).groupBy("doc_id", "crc").agg(F.collect_list("factors").alias("_factors"))
    found = found.withColumnsRenamed({"doc_id": "_id", "crc": "_crc"})
    place, names = docs.columns.index("text"), [*docs.columns, *MADE.names]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, removed, spans, kept, factors = [], [], [], [], []
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            for k, (text, found) in enumerate(zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                words = (text or b"").split()
                made = joined(np.frombuffer(b"".join(found or []), FACTOR), window)
                own = spans_of(made)
                left, at = [], 0
                for a, z in own:
                    left += words[at:a]
                    at = z
                left += words[at:]
                if own:
                    texts[k] = _cut_out(text, own)
                counts.append(len(words))
                removed.append(len(words) - len(left))
                spans.append([{"start": a, "end": z} for a, z in own])
                kept.append(b" ".join(left))
                factors.append([dict(zip(_FACTOR.names, f, strict=True)) for f in made.tolist()])
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            span, factor = (pa.list_(pa.struct([(c, pa.int64()) for c in t.names])) for t in (_SPAN, _FACTOR))
            columns += [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, factor)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    beside = docs.join(found, (key == F.col("_id")) & (F.crc32(F.encode("text", "UTF-8")) == F.col("_crc")), "left").select(*docs.columns, "_factors")
    return beside.mapInArrow(cut, T.StructType([*docs.schema.fields, *MADE.fields]))
