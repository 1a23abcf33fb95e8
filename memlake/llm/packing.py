"""Best-fit packing: patterns of few documents, repeated as non-negative least squares say, and best fit for the rest.

Texts are cut into pieces of at most `size` tokens. Only the histogram of the
pieces' lengths (`size` numbers) comes to the driver. There the packing is
planned by length alone: lengths are put in bins, all patterns of up to three
bins that fill a sequence are listed, and non-negative least squares fit the
patterns' repeat counts to the histogram. Rounded down and cut to what is
there, each pattern takes exact lengths out of its bins; what is left goes, by
length, into the fullest sequence that still has room. The plan says which
ranks of a length go where, so that a piece finds its place from its length and
its rank among the pieces of that length: no sequence is gathered anywhere.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.bpe import byte_chars
from memlake.llm.common import CACHED, materialize, raw, slices

SIZE = 2048
#: Widths of bins, in bins to a sequence.
BINS = 256
#: Pieces that one block of a length should have at most, and the fewest blocks.
ROWS_PER_BLOCK, FEWEST_BLOCKS = 200_000, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Words that only the whole tokenizer takes apart: with an apostrophe, a special token's start, or a character that is not
#: plain Latin text. The others are lower-cased and cut into runs of letters, digits and runs of other characters.
_HARD = re.compile("['\\x00-\\x1f\\x7f-\\xa0\u00b2\u00b3\u00b9\u00bc-\u00be\u0130\u0250-\U0010ffff]|<\\|")
_PARTS = re.compile(r"[^\W\d_]+|\d|(?:\W|_)+")


class _Ids(dict):
    """Ids of each word as bytes (little-endian, 32 bits), kept for the words that come again.

    The tokenizer drops white space and no token crosses it, so a text's ids
    are those of its words one after another.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.char = byte_chars()
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else "".join(self.char[b] for b in part.encode())
            self.parts[part] = found = _bytes([t.id for t in self.model.tokenize(shown)])
        return found

    def learn(self, words: list[bytes]) -> None:
        if len(self) >= CACHED:
            self.clear()
        if len(self.parts) >= CACHED:
            self.parts.clear()
        hard = []
        for w in set(words):
            if w not in self:
                text = w.decode()
                if _HARD.search(text):
                    hard.append(w)
                else:
                    self[w] = b"".join(map(self._part, _PARTS.findall(text.lower())))
        for w, e in zip(hard, self.tokenizer.encode_batch_fast([w.decode() for w in hard], add_special_tokens=False), strict=True):
            self[w] = _bytes(e.ids)


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_held: dict[str, _Ids] = {}


def pieces(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Tokens of each text with a closing 0, cut into pieces: PIECES, and ids (binary, little-endian 32 bits) if asked for.

    A null or empty text is one piece of the closing 0. Repeated rows give
    their pieces each; other columns of `docs` are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _held.get(path) or _held.setdefault(path, _Ids(path))
        for batch in slices(batches):
            rows: list[tuple] = []
            split = [text.split() for text in raw(batch.column(1))]
            ids.learn([w for words in split for w in words])
            for doc, words in zip(batch.column(0).to_pylist(), split, strict=True):
                all_ids = b"".join([*map(ids.__getitem__, words), b"\0\0\0\0"])
                for k, at in enumerate(range(0, len(all_ids), 4 * size)):
                    part = all_ids[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def patterns(bins: int) -> list[tuple[int, ...]]:
    """All descending ways to fill `bins` with one to three whole numbers."""
    three = [(a, b, bins - a - b) for a in range((bins + 2) // 3, bins - 1) for b in range((bins - a + 1) // 2, min(a, bins - a - 1) + 1)]
    return [(bins,), *((a, bins - a) for a in range((bins + 1) // 2, bins)), *three]


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 with the least |a x - b|: columns enter one by one where the error falls most, and leave at zero."""
    n = a.shape[1]
    x, inside = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[inside] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        inside[best] = True
        while True:
            own = np.flatnonzero(inside)
            s = np.linalg.lstsq(a[:, own].T @ a[:, own], a[:, own].T @ b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[own] = s
                break
            # go towards s until the first of x is zero; that one leaves
            bad = s <= 0
            step = np.min(x[own][bad] / np.maximum(x[own][bad] - s[bad], 1e-300))
            x[own] += step * (s - x[own])
            out = own[bad & (x[own] <= 1e-15)]
            out = out if len(out) else own[bad][:1]
            x[out] = 0
            inside[out] = False
            if not inside.any():
                break
    return x


def plan(histogram: dict[int, int], size: int = SIZE, bins: int = BINS) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each kind of sequence: count sequences have pieces of these lengths; all of the histogram is placed."""
    width = -(-size // bins)
    bins = -(-size // width)
    kinds: list[tuple[int, tuple[int, ...]]] = []
    stacks: list[list[list[int]]] = [[] for _ in range(bins + 1)]
    for length in sorted(histogram):
        if histogram[length]:
            stacks[-(-length // width)].append([length, histogram[length]])
    total = np.array([sum(c for _, c in s) for s in stacks[1:]], dtype=float)
    if total.sum():
        ways = patterns(bins)
        a = np.zeros((bins, len(ways)))
        for j, way in enumerate(ways):
            for part in way:
                a[part - 1, j] += 1
        fitted = nnls(a, total / total.max()) * total.max()
        for j in np.argsort(-fitted, kind="stable"):
            left = int(fitted[j] + 1e-6)
            way = ways[j]
            while left > 0 and all(sum(c for _, c in stacks[b]) >= way.count(b) for b in set(way)):
                many = min([left, *(stacks[b][-1][1] // way.count(b) for b in set(way))]) or 1
                lengths = []
                for b in way:
                    lengths.append(stacks[b][-1][0])
                    stacks[b][-1][1] -= many
                    if not stacks[b][-1][1]:
                        stacks[b].pop()
                kinds.append((many, tuple(lengths)))
                left -= many
    # the rest by best fit; open sequences by the room they have
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for many, lengths in kinds:
        room.setdefault(size - sum(lengths), []).append((many, lengths))
    rooms = sorted(room)

    def put(gap: int, kind: tuple[int, tuple[int, ...]]) -> None:
        if gap not in room:
            rooms.insert(bisect_left(rooms, gap), gap)
        room.setdefault(gap, []).append(kind)

    for length, count in sorted(((x, c) for s in stacks for x, c in s), reverse=True):
        while count:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                fit = size // length
                if count >= fit:
                    put(size - fit * length, (count // fit, (length,) * fit))
                if rest := count % fit:
                    put(size - rest * length, (1, (length,) * rest))
                break
            gap = rooms[at]
            many, lengths = room[gap].pop()
            if not room[gap]:
                del room[gap], rooms[at]
            placed = min(many, count)
            if many > placed:
                put(gap, (many - placed, lengths))
            put(gap - length, (placed, (*lengths, length)))
            count -= placed
    return [kind for gap in rooms for kind in room[gap]]


def pack(cut: DataFrame, size: int = SIZE, bins: int = BINS) -> DataFrame:
    """`cut` (doc_id, piece, length, ...) with sequence_id and offset (long).

    Every piece gets a place, also repeats; an empty table gives an empty one.
    `cut` is read twice and should be a written table.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    # for each length, which of its ranks go to which sequences and where in them
    at: list[tuple[int, int, int, int]] = []
    first, rank = 0, dict.fromkeys(histogram, 0)
    for many, lengths in plan(histogram, size, bins):
        offset = 0
        for length in lengths:
            at.append((length << 44 | rank[length], rank[length], first, offset))
            rank[length] += many
            offset += length
        first += many
    at.sort()
    keys, starts, firsts, offsets = (np.array(c, dtype=np.int64) for c in zip(*at, strict=True)) if at else [np.zeros(0, np.int64)] * 4

    blocks = FEWEST_BLOCKS
    while blocks * ROWS_PER_BLOCK < sum(histogram.values()):
        blocks *= 2
    dealt = cut.drop("sequence_id", "offset").withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    # ranks within a length without gathering a length: those of the blocks before, then the place in the block
    counts = dealt.groupBy("length", "_block").count()
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_block").orderBy("doc_id", "piece")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(keys, length.to_numpy() << 44 | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": firsts[k] + rank.to_numpy() - starts[k], "offset": offsets[k]})

    ranked = dealt.withColumn("_in", F.row_number().over(own) - 1).join(counts, ["length", "_block"])
    return (
        ranked.withColumn("_at", place("length", (F.col("_in") + F.col("_before")).cast("long")))
        .select(*(c for c in cut.columns if c not in ("sequence_id", "offset")), "_at.sequence_id", "_at.offset")
    )


def packed(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Pieces of all `docs` with their places; see `pieces` and `pack`."""
    return pack(materialize(pieces(docs, path, size), "pieces"), size)
