"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers that score.

Tokens are 64-bit hashes. Blocks of text send their distinct bigrams, counted,
to buckets of the first word. A bucket has all of a context, so it holds its
totals; how often a word continues different contexts is counted in a second,
smaller exchange by word. Tasks write what they have as sorted arrays into
files of the shared folder; only each bucket's place in them (a few numbers)
and the counts of counts come to the driver. Workers map the files and look up
the distinct bigrams of a block, bucket by bucket.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import Hashes, materialize, new_path, raw, slices
from memlake.llm.substrings import mixed

#: Tokens of a block in training and in scoring, tokens that a bucket should come from at most, and the fewest buckets.
TRAINED, SCORED, PER_BUCKET, FEWEST_BUCKETS = 1 << 21, 1 << 19, 1 << 20, 1024
BEGIN, END = xxhash.xxh3_64_intdigest(b"\x20<begin>"), xxhash.xxh3_64_intdigest(b"\x20<end>")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes, table: Hashes) -> np.ndarray:
    return np.append(table.of(text.lower().split()), np.uint64(END))


def _contexts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens, and the one before each."""
    w = np.concatenate(parts)
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[np.cumsum([0, *map(len, parts[:-1])])] = BEGIN
    return v, w


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(v * _STEP + w)


def _bucket(x: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(x + np.uint64(7)) >> np.uint64(64 - bits)).astype(np.int32)


def _cut(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value of sorted x begins and ends."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
    return first, np.append(first, len(x))[1:]


def _of_counts(x: np.ndarray) -> list[int]:
    """How many of the counts are 1, 2, 3, 4, and 3 or more."""
    return [*(int((x == k).sum()) for k in (1, 2, 3, 4)), int((x >= 3).sum())]


class _File:
    """Arrays one after another in a new file of the shared folder."""

    def __init__(self, folder: str):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        self.name, self.at = uuid.uuid4().hex, 0
        self.out = store.open_output_stream(f"{path}/{self.name}")

    def add(self, *arrays: np.ndarray) -> int:
        at = self.at
        for a in arrays:
            data = a.tobytes() + b"\0" * (-a.nbytes % 8)
            self.out.write(data)
            self.at += len(data)
        return at


_mapped: dict[str, np.ndarray] = {}


def _bytes_of(folder: str, name: str) -> np.ndarray:
    """A file of the shared folder, memory-mapped; from a store that cannot be mapped it is copied to this machine once."""
    uri = f"{folder}/{name}"
    if uri not in _mapped:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        if not isinstance(store, fs.LocalFileSystem):
            local = f"{tempfile.gettempdir()}/model-{name}"
            if not os.path.exists(local):
                fs.copy_files(path, f"{local}-{os.getpid()}", source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
                os.replace(f"{local}-{os.getpid()}", local)
            path = local
        _mapped[uri] = np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    return _mapped[uri]


def discounts(n: list[int]) -> list[float]:
    """What is taken off counts of 1, 2, and 3 or more; n: how many counts are 1, 2, 3 and 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    made = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else (k + 1) / 2 for k in range(3)]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(made)]


@dataclass
class Model:
    """Places of the buckets' arrays in the files, and what holds for the corpus."""

    folder: str
    bits: int
    names: list[str]
    #: for each bucket: file, offset, and lengths of its arrays; file -1 if it has none
    pairs: np.ndarray
    words: np.ndarray
    n_tokens: int
    n_words: int
    n_pairs: int
    pair_discounts: list[float]
    word_discounts: list[float]
    unknown: float

    def _segments(self, places: np.ndarray, x: np.ndarray, dtypes: list[tuple[str, int]]) -> Iterator[tuple[slice, list[np.ndarray]]]:
        """Slices of x (sorted by bucket) with their buckets' arrays; dtypes: kind of each array and which length it has."""
        first, last = _cut(_bucket(x, self.bits))
        for a, z in zip(first.tolist(), last.tolist(), strict=True):
            file, at, *lengths = places[int(_bucket(x[a : a + 1], self.bits)[0])].tolist()
            arrays = []
            for kind, k in dtypes:
                size = np.dtype(kind).itemsize * lengths[k]
                data = _bytes_of(self.folder, self.names[file])[at : at + size] if file >= 0 else np.zeros(0, np.uint8)
                arrays.append(data.view(kind))
                at += size + -size % 8
            yield slice(a, z), arrays

    def probabilities(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each bigram: the word's probability after the context, and the word's count."""
        d = np.array([0, *self.word_discounts])
        words, of_word = np.unique(w, return_inverse=True)
        order = np.argsort(_bucket(words, self.bits), kind="stable")
        count, low = np.zeros(len(words), np.int64), np.full(len(words), self.unknown)
        for part, (keys, seen, times) in self._segments(self.words, words[order], [("<u8", 0), ("<u4", 0), ("<u8", 0)]):
            at, hit = _find(keys, words[order[part]])
            count[order[part][hit]] = times[at[hit]]
            n = seen[at[hit]].astype(np.int64)
            low[order[part][hit]] += (n - d[np.minimum(n, 3)]) / self.n_pairs
        d = np.array([0, *self.pair_discounts])
        keys_, first, of_pair = np.unique(_pair(v, w), return_index=True, return_inverse=True)
        pv, pw = v[first], of_word[first]
        order = np.lexsort((keys_, _bucket(pv, self.bits)))
        p = low[pw]
        arrays = [("<u8", 0), ("u1", 0), ("<u4", 1), ("<u8", 1), ("<u8", 2), ("<u8", 2), ("<u4", 2), ("<u4", 2), ("<u4", 2)]
        for part, (keys, small, far, large, contexts, total, n1, n2, n3) in self._segments(self.pairs, pv[order], arrays):
            own = order[part]
            at, hit = _find(contexts, pv[own])
            own, at = own[hit], at[hit]
            t = total[at].astype(float)
            left = (d[1] * n1[at] + d[2] * n2[at] + d[3] * n3[at]) / t
            k, hit = _find(keys, keys_[own])
            c = np.where(hit, small[k] if len(small) else 0, 0).astype(np.int64)
            big = np.flatnonzero(c == 255)
            if len(big):
                c[big] = large[np.searchsorted(far, k[big])]
            p[own] = (c - d[np.minimum(c, 3)]) / t + left * low[pw[own]]
        return p[of_pair], count[of_word]


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, x)
    at = np.minimum(at, max(0, len(keys) - 1))
    return at, keys[at] == x if len(keys) else np.zeros(len(x), bool)


def train(docs: DataFrame) -> Model:
    """The model of all `docs`; null and empty texts count as an end. Without rows, every token is unknown."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = (max(FEWEST_BUCKETS, size // 6 // PER_BUCKET) - 1).bit_length()
    folder = new_path(docs.sparkSession, "model")
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = Hashes(), [], 0

        def out() -> pa.RecordBatch:
            v, w = _contexts(held)
            _, first, times = np.unique(_pair(v, w), return_index=True, return_counts=True)
            v, w = v[first], w[first]
            to = _bucket(v, bits)
            order = np.lexsort((v, to))
            v, w, times, to = v[order], w[order], times[order].astype("<u4"), to[order]
            blobs = []
            first, last = _cut(to)
            for a, z in zip(first.tolist(), last.tolist(), strict=True):
                begin, end = _cut(v[a:z])
                own = times[a:z]
                far = np.flatnonzero(own >= 255).astype("<u4")
                head = np.array([len(begin), z - a, len(far)], "<u4")
                parts = (head, v[a:z][begin], (end - begin).astype("<u4"), w[a:z], np.minimum(own, 255).astype("u1"), far, own[far])
                blobs.append(b"".join(x.tobytes() for x in parts))
            return pa.RecordBatch.from_arrays([pa.array(to[first], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "data"])

        for batch in slices(batches):
            for text in raw(batch.column(0)):
                held.append(tokens(text, table))
                n += len(held[-1])
                if n >= TRAINED:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def add_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket its arrays' place and counts of counts; then words with the contexts they continue, by bucket of the word."""
        file = None
        continued: list[tuple[np.ndarray, np.ndarray]] = []

        def out(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
            nonlocal file
            vs, ws, cs = [], [], []
            for x in blobs:
                r, m, f = np.frombuffer(x, "<u4", 3).tolist()
                at = 12
                vs.append(np.repeat(np.frombuffer(x, "<u8", r, at), np.frombuffer(x, "<u4", r, at + 8 * r)))
                at += 12 * r
                ws.append(np.frombuffer(x, "<u8", m, at))
                c = np.frombuffer(x, "u1", m, at + 8 * m).astype(np.int64)
                c[np.frombuffer(x, "<u4", f, at + 9 * m)] = np.frombuffer(x, "<u4", f, at + 9 * m + 4 * f)
                cs.append(c)
            v, w, c = np.concatenate(vs), np.concatenate(ws), np.concatenate(cs)
            keys = _pair(v, w)
            order = np.argsort(keys, kind="stable")
            first, _ = _cut(keys[order])
            c = np.add.reduceat(c[order], first)
            v, w, keys = v[order][first], w[order][first], keys[order][first]
            by = np.argsort(v, kind="stable")
            begin, _ = _cut(v[by])
            sums = lambda x: np.add.reduceat(x[by], begin)
            far = np.flatnonzero(c >= 255)
            file = file or _File(folder)
            at = file.add(
                keys.astype("<u8"), np.minimum(c, 255).astype("u1"), far.astype("<u4"), c[far].astype("<u8"), v[by][begin].astype("<u8"),
                sums(c).astype("<u8"), *(sums(x.astype(np.int64)).astype("<u4") for x in (c == 1, c == 2, c >= 3)),
            )
            continued.append((w, c))
            place = [at, len(keys), len(far), len(begin), *_of_counts(c), int(c.sum())]
            return rows("pairs", [bucket], [place], [None])

        def rows(kind: str, buckets: list[int], places: list, data: list) -> pa.RecordBatch:
            n = len(buckets)
            columns = [pa.array([kind] * n), pa.array(buckets, pa.int32()), pa.array([file.name if file else None] * n, pa.string())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.list_(pa.int64())), pa.array(data, pa.binary())], names=["kind", "bucket", "file", "place", "data"])

        def words() -> pa.RecordBatch:
            w, c = (np.concatenate(x) for x in zip(*continued, strict=True))
            continued.clear()
            order = np.argsort(w, kind="stable")
            first, last = _cut(w[order])
            c = np.add.reduceat(c[order], first)
            w, n = w[order][first], last - first
            to = _bucket(w, bits)
            order = np.argsort(to, kind="stable")
            w, n, c, to = w[order], n[order], c[order], to[order]
            first, last = _cut(to)
            blobs = [w[a:z].tobytes() + n[a:z].astype("<u4").tobytes() + c[a:z].astype("<u4" if c[a:z].max() < 1 << 32 else "<u8").tobytes() for a, z in zip(first, last, strict=True)]
            return rows("words", to[first].tolist(), [[int(z - a)] for a, z in zip(first, last, strict=True)], blobs)

        bucket, held = None, []
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and held:
                    yield out(bucket, held)
                    held = []
                    if sum(len(w) for w, _ in continued) >= TRAINED:
                        yield words()
                bucket = b
                held.append(data)
        if held:
            yield out(bucket, held)
        if continued:
            yield words()
        if file:
            file.out.close()

    def add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None

        def out(bucket: int, blobs: list[tuple[int, bytes]]) -> pa.RecordBatch:
            nonlocal file
            parts = []
            for n, x in blobs:
                kind = "<u4" if len(x) == 16 * n else "<u8"
                parts.append((np.frombuffer(x, "<u8", n), np.frombuffer(x, "<u4", n, 8 * n).astype(np.int64), np.frombuffer(x, kind, n, 12 * n).astype(np.int64)))
            w, n, c = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(w, kind="stable")
            first, _ = _cut(w[order])
            w, n, c = w[order][first], np.add.reduceat(n[order], first), np.add.reduceat(c[order], first)
            file = file or _File(folder)
            place = [file.add(w.astype("<u8"), n.astype("<u4"), c.astype("<u8")), len(w), 0, 0, *_of_counts(n), int(c.sum())]
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([file.name]), pa.array([place], pa.list_(pa.int64()))], names=["bucket", "file", "place"])

        bucket, held = None, []
        for batch in batches:
            for b, place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and held:
                    yield out(bucket, held)
                    held = []
                bucket = b
                held.append((place[0], data))
        if held:
            yield out(bucket, held)
        if file:
            file.out.close()

    sent = docs.select("text").mapInArrow(count, "bucket int, data binary").repartition("bucket").sortWithinPartitions("bucket")
    made = materialize(sent.mapInArrow(add_pairs, "kind string, bucket int, file string, place array<bigint>, data binary"), "pairs")
    of_words = made.where("kind = 'words'").select("bucket", "place", "data").repartition("bucket").sortWithinPartitions("bucket")
    of_words = materialize(of_words.mapInArrow(add_words, "bucket int, file string, place array<bigint>"), "words")
    names: list[str] = []
    tables, counts = [], []
    # a row for each bucket
    for rows in (made.where("kind = 'pairs'").select("bucket", "file", "place").collect(), of_words.collect()):
        table = np.full((1 << bits, 5), -1, dtype=np.int64)
        table[:, 1:] = 0
        total = [0] * 7
        for r in rows:
            if r["file"] not in names[-1:]:
                names.append(r["file"])
            table[r["bucket"]] = [len(names) - 1, *r["place"][:4]]
            total = [x + y for x, y in zip(total, [r["place"][1], *r["place"][4:]], strict=True)]
        tables.append(table)
        counts.append(total)
    (n_pairs, *pair_counts, n_tokens), (n_words, *word_counts, _) = counts
    d = discounts(word_counts[:4])
    left = (d[0] * word_counts[0] + d[1] * word_counts[1] + d[2] * word_counts[4]) / n_pairs if n_pairs else 1.0
    return Model(folder, bits, names, *tables, n_tokens, n_words, n_pairs, discounts(pair_counts[:4]), d, left / (n_words + 1))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens (long), base_score, score (double: log10 probability of the text).

    A null or empty text is its end alone. Repeated rows are scored each; other
    columns of `docs` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Hashes()
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            first = np.cumsum([0, *map(len, held[:-1])])
            p, count = model.probabilities(*_contexts(held))
            base = np.log10((count + 1) / (model.n_tokens + 1 * (model.n_words + 1)))
            columns = [
                pa.array(ids, pa.int64()), pa.array([len(x) for x in held], pa.int64()), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)),
                pa.array([model.n_tokens] * len(ids), pa.int64()), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(np.log10(p), first)),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                ids.append(doc)
                held.append(tokens(text, table))
                n += len(held[-1])
                if n >= SCORED:
                    yield out()
                    ids, held, n = [], [], 0
        if held:
            yield out()

    kinds = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kinds)


def with_perplexity(scored: DataFrame) -> DataFrame:
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
