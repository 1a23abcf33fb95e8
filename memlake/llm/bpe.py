"""Byte-level BPE: encoding by the tokenizers library over Arrow batches, decoding by the reversed byte table.

A rank file says which token comes first, a list of merges which pair. They
differ only where two different pairs of one token overlap. Units with such
places are merged by rank here.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import os
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from memlake.llm.common import CACHED, slices

#: Units longer than this many characters are encoded each time they come.
LONGEST_KEPT = 64


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where it prints, else one from U+0100 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in prints)
    shown = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [shown[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """A rank file as a tokenizer of the tokenizers library, with tables of ids for what comes again."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        char = byte_chars()
        shown = lambda token: "".join(char[b] for b in token)
        # every way to make a token of two others is a merge; those of the lowest rank go first
        merges = [
            (shown(t[:k]), shown(t[k:])) for t in sorted(ranks, key=ranks.__getitem__) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        ]
        self.tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ranks, self.pattern, self.overlaps = ranks, regex.compile(pattern), overlaps(ranks)
        byte = {c: b for b, c in enumerate(char)}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.tokens[i] = bytes(byte[c] for c in token)
        self.kept: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """The text in parts that end where white space begins: no match of the pattern reaches over such an end.

        A space starts a unit unless white space comes before it.
        """
        if _AFTER_BLANK.search(text):
            return _STARTS.split(text)
        parts = text.split(" ")
        return [parts[0], *[" " + x for x in parts[1:]]]

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """Ids of each unit as bytes, little-endian, 32 bits each."""
        if len(self.kept) >= CACHED:
            self.kept.clear()
        new = [u for u in set(units) if u not in self.kept]
        once = {}
        for u, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            ids = self.by_rank(u) if self.ambiguous(u) else e.ids
            (self.kept if len(u) <= LONGEST_KEPT else once)[u] = struct.pack(f"<{len(ids)}I", *ids)
        return once

    def ambiguous(self, unit: str) -> bool:
        """Whether two different pairs of one token overlap somewhere in the unit."""
        return next(self.overlaps.iter(unit.encode().decode("latin-1")), None) is not None if self.overlaps else False

    def by_rank(self, unit: str) -> list[int]:
        """Ids of a unit: in each match of the pattern the pair that makes the token of the lowest rank is merged first, the leftmost of equal ones."""
        return [i for match in self.pattern.findall(unit) for i in merged(match.encode(), self.ranks)]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # where the part that begins here ends; the one before it
    live = [True] * n

    def pair(k: int) -> tuple[int, int, int] | None:
        end = after[k]
        rank = ranks.get(piece[k : after[end]]) if end < n else None
        return None if rank is None else (rank, k, after[end])

    heap = [p for p in map(pair, range(n)) if p]
    heapq.heapify(heap)
    while heap:
        _, k, end = heapq.heappop(heap)
        if not live[k] or after[k] >= n or after[after[k]] != end:
            continue  # a part of it has been merged since
        live[after[k]] = False
        after[k] = end
        if end < n:
            before[end] = k
        for x in (k, before[k]):
            if x >= 0 and (p := pair(x)):
                heapq.heappush(heap, p)
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : after[k]]])
        k = after[k]
    return out


def overlaps(ranks: dict[bytes, int]) -> ahocorasick.Automaton | None:
    """Finds the texts l m r in which the pairs (l, m) and (m, r) make the same token; bytes stand as characters."""
    found = ahocorasick.Automaton()
    for t in ranks:
        for n in range(1, len(t)):
            left, middle, right = t[:-n], t[:n], t[n:]
            if t.endswith(middle) and left != middle and left in ranks and middle in ranks and right in ranks:
                found.add_word((t + right).decode("latin-1"), 1)
    if not len(found):
        return None
    found.make_automaton()
    return found


#: A space after white space, and the places where a space follows something else.
_AFTER_BLANK, _STARTS = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")

_held: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    return _held.get((path, pattern)) or _held.setdefault((path, pattern), Codec(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str, starts: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian, 32 bits each) and, if asked for, starts (likewise): the byte where each token begins.

    A null or empty text has no ids. Repeated rows give theirs each; other
    columns of `docs` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        lengths = np.array([len(t) for t in codec.tokens], dtype=np.int64)
        for batch in slices(batches):
            split = [codec.units(text or "") for text in batch.column(1).to_pylist()]
            once = codec.learn([u for units in split for u in units])
            kept = codec.kept
            ids = [b"".join([kept.get(u) or once.get(u, b"") for u in units] if once else map(kept.__getitem__, units)) for units in split]
            columns = [batch.column(0).cast(pa.int64()), pa.array(ids, pa.binary())]
            if starts:
                ends = [np.cumsum(lengths[np.frombuffer(x, "<u4")]) for x in ids]
                columns.append(pa.array([(np.concatenate([[0], e[:-1]]) if len(e) else e).astype("<u4").tobytes() for e in ends], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", *["starts"] * starts])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary" + ", starts binary" * starts)


def decode(encoded: DataFrame, path: str, pattern: str, parts: bool = False) -> DataFrame:
    """`encoded` (doc_id, ids) with decoded (binary) and, if asked for, parts: array<string>.

    decoded joins the tokens' bytes. parts has one string for each token: a
    character that several tokens share stands at the one that ends it, and
    bytes that are no character at the text's end become U+FFFD. Ids that the
    file lacks fail; null ids give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _codec(path, pattern).tokens
        for batch in slices(batches):
            found = [[tokens[i] for i in np.frombuffer(x or b"", "<u4").tolist()] for x in batch.column(1).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array([b"".join(x) for x in found], pa.binary())]
            if parts:
                columns.append(pa.array([shown(x) for x in found], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded", *["parts"] * parts])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary" + ", parts array<string>" * parts)


def shown(tokens: list[bytes]) -> list[str]:
    """The text that each token adds; see `decode`."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    return [decoder.decode(t, final=k == len(tokens) - 1) for k, t in enumerate(tokens)]
