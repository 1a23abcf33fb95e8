"""N-gram Jaccard join: token-combination prefixes over word shingles, then exact verification.

Texts with equal shingle sets are one class, and classes are what is joined.
In the order of tokens rare ones come first, by hash, and frequent ones last.
With a prefix extended to `COMBINED` - 1 tokens more than the plain one, two
sets that are similar enough share `COMBINED` tokens of their prefixes: either
a rare one, which is indexed alone, or only frequent ones, of which all
combinations of `COMBINED` are indexed. Sets of more than `LONG` tokens, whose
combinations would be too many, index their frequent tokens alone; sets little
shorter do both, so that any two similar ones meet. Which tokens are frequent
changes candidates, never results.

An index entry names the set's size and a sketch: how many tokens fall into each
of a few cells. Each token of the symmetric difference moves one cell by one, so
sets whose sketches are further apart than the threshold allows cannot be
similar: that and the sizes prune without loss. Then

1. in each group every class is paired with the first that it could be similar
   to, in one of a few orders, so copies make stars and not all pairs; the pairs
   are verified on the whole texts, and components are labelled;
2. in each group every label's nearest class of another label is verified too,
   and labels are made anew;
3. what could still be similar and is not connected is verified pair by pair,
   each pair in the one group that is the first that both are in. Members are
   named for that only now, as most that had a partner before have its label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import Hashes, connected_components, materialize, raw, slices
from memlake.llm.substrings import mixed, rolled

#: Words in a shingle, and the similarity in percent from which two documents link.
SHINGLE, PERCENT = 3, 90
COMBINED = 2
#: Frequent tokens at most, the count that makes a token frequent, its least count in a block of BLOCK tokens, and the size from
#: which on sets index no combinations.
FREQUENT, OFTEN, IN_BLOCK, BLOCK, LONG = 1 << 17, 1024, 4, 1 << 20, 500
#: Orders in which groups choose the centres of their stars.
ORDERS = 4
#: Fewest buckets of index entries and entries that one should have at most; members of a group compared at a time; parts of the
#: pairs of one first class; texts to verify whose ids are broadcast at most (a row has 40 bytes), beyond which they are joined by a shuffle.
BUCKETS, PER_BUCKET, AT_A_TIME, LEAVES, BROADCAST = 256, 1 << 20, 1024, 256, 500_000


def shingles(text: bytes, table: Hashes, k: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; of fewer than k words, of the whole sequence."""
    h = table.of(text.lower().split())
    if not len(h):
        return h
    return np.unique(mixed(rolled(h, min(k, len(h))) + np.uint64(max(0, k - len(h)))))


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def most_apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of similar sets of sizes a and b; negative if there are none."""
    least = -(-(percent * (a + b)) // (100 + percent))
    return np.where(least > np.minimum(a, b), -1, a + b - 2 * least)


def _sets(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[tuple[int | None, np.ndarray]]:
    table = Hashes()
    for batch in slices(batches):
        for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
            yield doc, shingles(text, table, k)


def parity(s: np.ndarray, percent: int) -> bytes:
    """Bits that each token flips one of: eight for each token of the largest symmetric difference of similar sets of that size, 64 at least.

    Sets whose bits differ in more places than they may have tokens apart are not similar.
    """
    m = 64
    while m < 8 * most_apart(np.array(len(s)), np.array(len(s)), percent):
        m *= 2
    flips = np.bincount((mixed(s + np.uint64(1)) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(flips.astype(bool), bitorder="little").tobytes()


class _Parities:
    """Parity bits of members, by length."""

    def __init__(self, bits: list[bytes]):
        self.words = np.array([len(b) // 8 for b in bits])
        self.row = np.zeros(len(bits), dtype=np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.words[self.words > 0]).tolist():
            own = np.flatnonzero(self.words == w)
            self.row[own] = np.arange(len(own))
            self.of[w] = np.frombuffer(b"".join([bits[k] for k in own]), "<u8").reshape(-1, w)

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Least symmetric difference, pair by pair; longer bits are folded to the shorter; 0 where bits are missing."""
        out = np.zeros(len(x), dtype=np.int64)
        kind = self.words[x] * 1_000_000 + self.words[y]
        for pair in np.unique(kind).tolist():
            m, n = divmod(pair, 1_000_000)
            every = np.flatnonzero(kind == pair) if m and n else []
            step = max(1, (1 << 20) // max(m, n, 1))
            for at in range(0, len(every), step):
                own = every[at : at + step]
                a, b = self.of[m][self.row[x[own]]], self.of[n][self.row[y[own]]]
                while a.shape[1] != b.shape[1]:
                    if a.shape[1] < b.shape[1]:
                        a, b = b, a
                    a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
                out[own] = np.bitwise_count(a ^ b).sum(axis=1)
        return out


def counted(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, class (long; null for an empty set), bits (see `parity`) of each row; and rows of token and n (class null, doc_id null): counts by block.

    In a block each class counts once. Row 0 of the tokens is their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n, seen = Hashes(), [], 0, set()

        def tokens() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            few = times >= IN_BLOCK
            none = pa.nulls(few.sum() + 1, pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, none, pa.nulls(len(none), pa.binary()), pa.array(np.append(found[few].view(np.int64), 0)), pa.array(np.append(times[few], n)), pa.array(np.append(np.ones(few.sum(), bool), False))], names=names,
            )

        for batch in slices(batches):
            made = [shingles(text, table, k) for text in raw(batch.column(1))]
            own = [class_of(s) if len(s) else None for s in made]
            none, bits = pa.nulls(len(made), pa.int64()), pa.array([parity(s, percent) if len(s) else None for s in made], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in made], pa.int64()), pa.array(own, pa.int64()), bits, none, none, pa.nulls(len(made), pa.bool_())], names=names)
            for c, s in zip(own, made, strict=True):
                if c is not None and c not in seen:
                    seen.add(c)
                    held.append(s)
                    n += len(s)
            if n >= BLOCK:
                yield tokens()
                held, n, seen = [], 0, set()
        yield tokens()

    names = ["doc_id", "n_shingles", "class", "bits", "token", "n", "real"]
    return docs.mapInArrow(run, "doc_id long, n_shingles long, class long, bits binary, token long, n long, real boolean")


def frequent_tokens(found: DataFrame) -> tuple[np.ndarray, int]:
    """Of what `counted` returns: the most frequent tokens (FREQUENT of 8 bytes at most), sorted, and the number of all."""
    counts = found.where("real is not null").groupBy("token", "real").agg(F.sum("n").alias("n"))
    total = counts.where("not real").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    often = counts.where("real").where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    return np.sort(np.array([r["token"] for r in often], dtype=np.int64).view(np.uint64)), total


def prefix(s: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the extended prefix: rare ones and frequent ones."""
    where = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
    often = frequent[where] == s if len(frequent) else np.zeros(len(s), bool)
    n = min(len(s), len(s) - -(-percent * len(s) // 100) + COMBINED)
    rare = s[~often][:n]
    return rare, s[often][: n - len(rare)]


def combined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Index tokens of combinations of two tokens, the smaller first."""
    return mixed(mixed(first) + second)


def alone(size: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether sets of that size index frequent tokens alone; any set that a set of more than LONG tokens is similar to does."""
    return size >= percent * LONG // 100


def entries(s: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """Index tokens of a set."""
    rare, common = prefix(s, frequent, percent)
    made = [rare]
    if alone(len(s), percent):
        made.append(common)
    if len(s) <= LONG:
        i, j = np.triu_indices(len(common), 1)
        made.append(combined(common[i], common[j]))
    return np.concatenate(made)


def cells(size: np.ndarray | int) -> np.ndarray:
    """Cells of the sketch of a set of that size: enough to tell sets apart that have nothing in common."""
    return np.select([np.asarray(size) <= 400, np.asarray(size) <= 1000, np.asarray(size) <= 5000], [8, 16, 64], 256)


def sketch(s: np.ndarray) -> np.ndarray:
    """How many tokens fall into each cell, modulo 256."""
    return np.bincount((mixed(s) % np.uint64(cells(len(s)))).astype(np.int64), minlength=int(cells(len(s)))).astype(np.uint8)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least symmetric difference of the sets, row by row; the longer sketches are folded to the shorter."""
    for _ in range(2):
        if a.shape[-1] > b.shape[-1]:
            a = a.reshape(*a.shape[:-1], -1, b.shape[-1]).sum(axis=-2, dtype=np.uint8)
        a, b = b, a
    d = a - b
    return np.minimum(d, 0 - d).sum(axis=-1, dtype=np.int64)


class _Members:
    """Classes with their sizes and sketches, as a blob and back."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes):
        self.ids, self.sizes, self.data = ids, sizes.astype(np.int64), np.frombuffer(data, np.uint8)
        self.cells = cells(self.sizes)
        self.at = np.cumsum(self.cells) - self.cells

    def rows(self, k: np.ndarray, n: int) -> np.ndarray:
        return self.data[self.at[k][:, None] + np.arange(n)]

    def apart(self, k: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
        """Least symmetric difference of members k and other, pair by pair; -1 where it is too large for similar sets."""
        most = most_apart(self.sizes[k], self.sizes[other], percent)
        out = np.where(most >= 0, 0, -1)
        kind = self.cells[k] * 1000 + self.cells[other]
        for pair in np.unique(kind[out == 0]).tolist():
            m, n = divmod(pair, 1000)
            every = np.flatnonzero((most >= 0) & (kind == pair))
            step = (1 << 22) // max(m, n)
            for at in range(0, len(every), step):
                own = every[at : at + step]
                d = apart(self.rows(k[own], m), self.rows(other[own], n))
                out[own] = np.where(d <= most[own], d, -1)
        return out

    def near(self, k: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
        """Whether members k and other could be similar, pair by pair; True where nothing speaks against it."""
        return self.apart(k, other, percent) >= 0


def _packed(member: np.ndarray, ids: np.ndarray, sizes: np.ndarray, sketches: list[bytes], tokens: np.ndarray) -> bytes:
    own, at = np.unique(member, return_inverse=True)
    data = b"".join([sketches[k] for k in own])
    head = np.array([len(own), len(tokens), len(data)], "<u4")
    return b"".join([head.tobytes(), ids[own].astype("<i8").tobytes(), sizes[own].astype("<u4").tobytes(), tokens.astype("<u8").tobytes(), at.astype("<u4").tobytes(), data])


def _unpacked(blobs: list[bytes]) -> tuple[_Members, np.ndarray, np.ndarray]:
    """Members, and for each entry its token and the member's place."""
    ids, sizes, data, tokens, at, n = [], [], [], [], [], 0
    for x in blobs:
        m, e, z = np.frombuffer(x, "<u4", 3).tolist()
        ids.append(np.frombuffer(x, "<i8", m, 12))
        sizes.append(np.frombuffer(x, "<u4", m, 12 + 8 * m))
        tokens.append(np.frombuffer(x, "<u8", e, 12 + 12 * m))
        at.append(np.frombuffer(x, "<u4", e, 12 + 12 * m + 8 * e).astype(np.int64) + n)
        data.append(x[len(x) - z :])
        n += m
    return _Members(np.concatenate(ids), np.concatenate(sizes), b"".join(data)), np.concatenate(tokens), np.concatenate(at)


def _chains(members: _Members, tokens: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (token, member's place) in groups of one token whose sizes leave no gap, and where the groups begin; single ones go."""
    if not len(tokens):
        return tokens, at, at
    order = np.lexsort((members.ids[at], members.sizes[at], tokens))
    tokens, at = tokens[order], at[order]
    same = np.concatenate([[False], (tokens[1:] == tokens[:-1]) & (members.ids[at[1:]] == members.ids[at[:-1]])])
    tokens, at = tokens[~same], at[~same]  # a class may come from several tasks
    sizes = members.sizes[at]
    joins = np.concatenate([[False], (tokens[1:] == tokens[:-1]) & (most_apart(sizes[1:], sizes[:-1], percent) >= 0)])
    keep = joins | np.append(joins[1:], False)
    return tokens[keep], at[keep], np.flatnonzero(~joins[keep])


def _within(first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places within each of these groups, many groups at a time."""
    size = last - first
    for n in np.unique(size).tolist():
        i, j = np.triu_indices(n, 1)
        step = max(1, (1 << 20) // len(i))
        every = first[size == n]
        for at in range(0, len(every), step):
            own = every[at : at + step, None]
            yield (own + i).ravel(), (own + j).ravel()


def _distinct(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distinct pairs, sorted, as rows."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = _begins(x, y)
    return np.stack([x[new], y[new]], axis=1)


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where the keys differ from those before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _stars(members: _Members, rest: np.ndarray, percent: int) -> np.ndarray:
    """Each of these members with the first that it could be similar to, among those that have none themselves."""
    pairs = [np.zeros((2, 0), np.int64)]
    while len(rest) > 1:
        near = members.near(np.repeat(rest[:1], len(rest) - 1), rest[1:], percent)
        pairs.append(np.stack([np.repeat(members.ids[rest[:1]], near.sum()), members.ids[rest[1:][near]]]))
        rest = rest[1:][~near]
    return np.sort(np.concatenate(pairs, axis=1), axis=0).T


def groups(docs: DataFrame, frequent: np.ndarray, k: int, percent: int, buckets: int = BUCKETS) -> DataFrame:
    """bucket, members (binary), pairs (binary: stars): the groups of classes with an index entry in common that could hold similar ones."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sizes: list[int] = []
        sketches: list[bytes] = []
        held: list[np.ndarray] = []
        n, seen = 0, set()

        def out() -> pa.RecordBatch:
            tokens = np.concatenate(held) if held else np.zeros(0, np.uint64)
            member = np.repeat(np.arange(len(held)), [len(h) for h in held])
            to = (mixed(tokens) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            tokens, member, to = tokens[order], member[order], to[order]
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, int)
            own = np.array(ids, np.int64), np.array(sizes, np.int64)
            blobs = [_packed(member[a:z], *own, sketches, tokens[a:z]) for a, z in zip(cut, np.append(cut, len(to))[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(to[cut], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

        for _, s in _sets(batches, k):
            c = class_of(s)
            if not len(s) or c in seen:
                continue
            seen.add(c)
            tokens, size = entries(s, frequent, percent), len(s)
            ids.append(c)
            sizes.append(size)
            sketches.append(sketch(s).tobytes())
            held.append(tokens)
            n += len(tokens)
            if n >= BLOCK // 2:
                yield out()
                ids, sizes, sketches, held, n, seen = [], [], [], [], 0, set()
        yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
            members, tokens, at = _unpacked(blobs)
            tokens, at, first = _chains(members, tokens, at, percent)
            last = np.append(first, len(at))[1:]
            keep = np.zeros(len(at), bool)
            stars = [np.zeros((0, 2), np.int64)]
            turn = mixed(members.ids[at].view(np.uint64) ^ tokens % np.uint64(ORDERS))
            few = last - first <= AT_A_TIME
            for i, j in _within(first[few], last[few]):
                near = members.near(at[i], at[j], percent)
                i, j = i[near], j[near]
                group = np.searchsorted(first, i, side="right") - 1
                # each member with the first in the group's order that it could be similar to
                s, t = turn[i], turn[j]
                near, far, s, t = np.where(s < t, at[i], at[j]), np.where(s < t, at[j], at[i]), np.minimum(s, t), np.maximum(s, t)
                order = np.lexsort((s, t, group))
                new = _begins(group[order], t[order])
                stars.append(_distinct(*np.sort([members.ids[near[order][new]], members.ids[far[order][new]]], axis=0)))
                for c in np.unique(group).tolist():
                    keep[first[c] : last[c]] = True
            for a, z in zip(first[~few].tolist(), last[~few].tolist(), strict=True):
                found = _stars(members, at[a:z][np.argsort(turn[a:z], kind="stable")], percent)
                keep[a:z] = len(found) > 0
                stars.append(found)
            if not keep.any():
                return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["bucket", "members", "pairs"])
            every = _distinct(*np.concatenate(stars).T)
            own, back = np.unique(at[keep], return_inverse=True)
            data = b"".join(members.rows(own[k : k + 1], int(members.cells[own[k]])).tobytes() for k in range(len(own)))
            sketches = [data[x : x + y] for x, y in zip((np.cumsum(members.cells[own]) - members.cells[own]).tolist(), members.cells[own].tolist(), strict=True)]
            blob = _packed(back, members.ids[own], members.sizes[own], sketches, tokens[keep])
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob]), pa.array([every.astype("<i8").tobytes()])], names=["bucket", "members", "pairs"])

        bucket, held = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != bucket and held:
                    yield out(bucket, held)
                    held = []
                bucket = b
                held.append(blob)
        if held:
            yield out(bucket, held)

    dealt = docs.mapInArrow(index, "bucket int, entries binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "bucket int, members binary, pairs binary")


def _pairs(found: DataFrame) -> DataFrame:
    """a, b of each star, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, 2)
            p = _distinct(p[:, 0], p[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return found.select("pairs").mapInArrow(run, "a long, b long").distinct()


def _beside(found: DataFrame, rows: DataFrame, run: Callable[..., pa.RecordBatch | None], schema: str) -> DataFrame:
    """`run` of each bucket's members and its own of the rows (bucket, id, label, bits, tokens), for the buckets that have such."""
    columns = ["bucket", "id", "label", "bits", "tokens", "members"]
    both = rows.withColumn("members", F.lit(None).cast("binary")).select(*columns).union(
        found.select("bucket", *(F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("label", "long"), ("bits", "binary"), ("tokens", "binary"))), "members")
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bucket = None
        for batch in batches:
            own, members = batch.column(0).to_pylist(), batch.column(5)
            at = 0
            for k in [*np.flatnonzero(members.is_valid().to_numpy(zero_copy_only=False)).tolist(), batch.num_rows]:
                if k > at:
                    if own[at] != bucket:
                        held, bucket = [], own[at]
                    held.append(batch.slice(at, k - at))
                if k < batch.num_rows and own[k] == bucket and held:
                    made = run(bucket, members[k].as_py(), pa.Table.from_batches(held).combine_chunks())
                    if made is not None:
                        yield made
                at = k + 1

    # the rows of a bucket come before its members
    return both.repartition("bucket").sortWithinPartitions("bucket", F.col("members").isNotNull()).mapInArrow(each, schema)


def _unlike(first: np.ndarray, last: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of different labels within the groups, each once."""
    if not len(first):
        return
    mixed_up = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
    few = mixed_up & (last - first <= 64)
    for i, j in _within(first[few], last[few]):
        other = label[i] != label[j]
        yield i[other], j[other]
    many = mixed_up & ~few
    for a, z in zip(first[many].tolist(), last[many].tolist(), strict=True):
        kinds, back, times = np.unique(label[a:z], return_inverse=True, return_counts=True)
        fewer = a + np.flatnonzero(back != times.argmax())  # each against those of the most frequent label, and those after it
        most = a + np.flatnonzero(back == times.argmax())
        step = max(1, (1 << 20) // (z - a))
        for at in range(0, len(fewer), step):
            i = fewer[at : at + step]
            yield np.repeat(i, len(most)), np.tile(most, len(i))
            x, y = np.nonzero(np.arange(len(fewer))[None, :] > np.arange(at, at + len(i))[:, None])
            other = label[i[x]] != label[fewer[y]]
            yield i[x[other]], fewer[y[other]]


def _labels_of(ids: np.ndarray, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """For each member the row that has its id, and its label; -1 and its id where there is none."""
    known, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    order = np.argsort(known, kind="stable")
    where = np.minimum(np.searchsorted(known[order], ids), len(known) - 1)
    hit = known[order][where] == ids
    return np.where(hit, order[where], -1), np.where(hit, labels[order][where], ids)


def _possible_unlike(found: DataFrame, labels: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """bucket, a, b: for each label of a group its nearest pair with another label; or, unless `nearest`, bucket, a with null b: members that have such a partner.

    labels: id, component_id, bits of the classes. The bits prune pairs that sizes and cells could not.
    """

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _unpacked([x])[0].ids
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(ids), pa.int32()), pa.array(ids)], names=["bucket", "id"])

    wanted = found.select("bucket", "members").mapInArrow(names, "bucket int, id long").join(labels, "id")
    rows = wanted.select("bucket", "id", F.col("component_id").alias("label"), "bits", F.lit(None).cast("binary").alias("tokens"))

    def run(bucket: int, blob: bytes, rows: pa.Table) -> pa.RecordBatch:
        members, tokens, at = _unpacked([blob])
        row, label = _labels_of(members.ids, rows)
        parities = _Parities(rows.column("bits").to_pylist())
        tokens, at, first = _chains(members, tokens, at, percent)
        last = np.append(first, len(at))[1:]
        turn = mixed(members.ids[at].view(np.uint64) ^ tokens)
        open_, made = np.zeros(len(members.ids), bool), [np.zeros((0, 2), np.int64)]
        for i, j in _unlike(first, last, label[at]):
            near = members.near(at[i], at[j], percent)
            i, j = i[near], j[near]
            d = parities.apart(row[at[i]], row[at[j]])
            near = d <= most_apart(members.sizes[at[i]], members.sizes[at[j]], percent)
            i, j, d = i[near], j[near], d[near]
            if not nearest:
                open_[at[i]] = open_[at[j]] = True
                continue
            group = np.tile(np.searchsorted(first, i, side="right") - 1, 2)
            x, y, d = np.append(i, j), np.append(j, i), np.tile(d, 2)
            order = np.lexsort((turn[x] ^ turn[y], d, label[at[x]], group))
            best = order[_begins(group[order], label[at[x[order]]])]
            made.append(_distinct(*np.sort([members.ids[at[x[best]]], members.ids[at[y[best]]]], axis=0)))
        p = _distinct(*np.concatenate(made).T)
        a, b = np.append(p[:, 0], members.ids[open_]), np.append(p[:, 1], np.zeros(open_.sum(), np.int64))
        return pa.RecordBatch.from_arrays([pa.array([bucket] * len(a), pa.int32()), pa.array(a), pa.array(b, mask=np.arange(len(a)) >= len(p))], names=["bucket", "a", "b"])

    return _beside(found, rows, run, "bucket int, a long, b long")


class _Prefixes:
    """Prefixes of members, in classes of length, as ranks: rare tokens before frequent ones."""

    def __init__(self, blobs: list[bytes]):
        parts = [np.frombuffer(x, "<u8") for x in blobs]  # the number of rare tokens, then all
        rare = [x[1 : 1 + int(x[0])] for x in parts]
        often = [x[1 + int(x[0]) :] for x in parts]
        none = [np.zeros(0, np.uint64)]
        self.rare, back = np.unique(np.concatenate(none + rare), return_inverse=True)
        self.often, more = np.unique(np.concatenate(none + often), return_inverse=True)
        cut = lambda flat, of: np.split(flat, np.cumsum([len(x) for x in of])[:-1]) if of else []
        ranks = [np.append(a, b + len(self.rare)) for a, b in zip(cut(back, rare), cut(more, often), strict=True)]
        self.width = np.array([1 << int(len(r) - 1).bit_length() if len(r) else 1 for r in ranks], dtype=np.int64)
        self.row = np.zeros(len(ranks), np.int64)
        self.of: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.row[own] = np.arange(len(own))
            self.of[w] = np.full((len(own), w), -1, np.int64)
            for k, o in enumerate(own.tolist()):
                self.of[w][k, : len(ranks[o])] = ranks[o]

    def owner(self, x: np.ndarray, y: np.ndarray, single: np.ndarray) -> np.ndarray:
        """The first index token that members x and y have in common; `single`: frequent tokens are indexed alone by both."""
        out = np.zeros(len(x), np.uint64)
        kind = self.width[x] * (1 << 32) + self.width[y]
        for pair in np.unique(kind).tolist():
            m, n = pair >> 32, pair & 0xFFFFFFFF
            every = np.flatnonzero(kind == pair)
            step = max(1, (1 << 21) // (m + n))
            for at in range(0, len(every), step):
                own = every[at : at + step]
                both = np.sort(np.concatenate([self.of[m][self.row[x[own]]], self.of[n][self.row[y[own]]]], axis=1), axis=1)
                twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] >= 0)
                rows = np.arange(len(own))
                i = twice.argmax(axis=1)
                one = both[rows, i]
                twice[rows, i] = False
                two = both[rows, twice.argmax(axis=1)]
                n_rare = len(self.rare)
                rare, often = np.append(self.rare, np.uint64(0)), np.append(self.often, np.uint64(0))
                a, b = often[np.maximum(one - n_rare, 0)], often[np.maximum(two - n_rare, 0)]
                out[own] = np.where(one < n_rare, rare[np.minimum(np.maximum(one, 0), n_rare)], np.where(single[own], a, combined(a, b)))
        return out


def _unconnected(found: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """a, b: members of one group that could be similar and have different labels, once each.

    rows: bucket, id, label, bits (see `parity`), tokens (the prefix) of the
    members to compare. A pair comes out in the group of the first index token that both have.
    """

    def run(bucket: int, blob: bytes, rows: pa.Table) -> pa.RecordBatch:
        members, tokens, at = _unpacked([blob])
        row, label = _labels_of(members.ids, rows)
        open_ = row[at] >= 0
        tokens, at, first = _chains(members, tokens[open_], at[open_], percent)
        last = np.append(first, len(at))[1:]
        parities, prefixes = _Parities(rows.column("bits").to_pylist()), _Prefixes(rows.column("tokens").to_pylist())
        made = [np.zeros((0, 2), np.int64)]
        for i, j in _unlike(first, last, label[at]):
            near = members.near(at[i], at[j], percent)
            i, j = i[near], j[near]
            x, y = at[i], at[j]
            near = parities.apart(row[x], row[y]) <= most_apart(members.sizes[x], members.sizes[y], percent)
            i, x, y = i[near], x[near], y[near]
            own = prefixes.owner(row[x], row[y], alone(np.minimum(members.sizes[x], members.sizes[y]), percent)) == tokens[i]
            made.append(_distinct(*np.sort([members.ids[x[own]], members.ids[y[own]]], axis=0)))
        p = np.concatenate(made)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], names=["a", "b"])

    return _beside(found, rows, run, "a long, b long")


def _prefixes(docs: DataFrame, reps: DataFrame, frequent: np.ndarray, k: int, percent: int) -> DataFrame:
    """id, bits, tokens: parity bits and prefix of these classes, from the texts of their first documents (reps: class, doc_id, n, bits)."""
    few = F.broadcast(reps) if reps.count() <= BROADCAST else reps
    sent = docs.join(few.select(F.col("doc_id").alias("of"), "class", "bits"), F.col("doc_id") == F.col("of")).select("class", "text", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made: list[bytes | None] = []
            for c, s in _sets([batch], k):
                rare, common = prefix(s, frequent, percent)
                own = class_of(s) == c  # not another text under the same doc_id
                made.append(np.concatenate([np.array([len(rare)], "<u8"), rare, common]).astype("<u8").tobytes() if own else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["id", "bits", "tokens"])

    return sent.mapInArrow(run, "id long, bits binary, tokens binary").where("tokens is not null").dropDuplicates(["id"])


def verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of classes (a, b) that are similar, judged on the whole texts of the classes' first documents (reps: class, doc_id, n, bits).

    Pairs whose parity bits are too far apart need no texts.
    """
    a, b = (reps.select(F.col("class").alias(x), F.col("doc_id").alias(f"of_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    named = pairs.join(a, "a").join(b, "b").select("a", "of_a", "n_a", "bits_a", "b", "of_b", "n_b", "bits_b")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(6).to_numpy()
            own = np.arange(len(n_a))
            parities = _Parities(batch.column(3).to_pylist() + batch.column(7).to_pylist())
            near = parities.apart(own, own + len(own)) <= most_apart(n_a, n_b, percent)
            yield batch.filter(pa.array(near)).select(["a", "of_a", "b", "of_b"])

    # many pairs with one first class are dealt out, each part with a copy of its text
    named = named.mapInArrow(possible, "a long, of_a long, b long, of_b long").withColumn("part", F.pmod(F.xxhash64("b"), F.lit(LEAVES)).cast("int"))
    second = named.select(F.col("of_b").alias("of"), "a", "part", F.col("b").alias("b"))
    first = named.select(F.col("of_a").alias("of"), "a", "part", F.lit(None).cast("long").alias("b")).distinct()
    wanted = first.union(second)
    wanted = materialize(wanted, "wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    sent = docs.join(few, docs.doc_id == few.of).select("a", "part", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, key, own = Hashes(), None, np.zeros(0, np.uint64)
        for batch in slices(batches):
            made: list[tuple[int, int]] = []
            for x, part, y, text in zip(*(batch.column(j).to_pylist() for j in range(3)), raw(batch.column(3)), strict=True):
                s = shingles(text, table, k)
                if class_of(s) != (x if y is None else y):
                    continue  # another text under the same doc_id
                if y is None:
                    key, own = (x, part), s
                elif key == (x, part):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        made.append((x, y))
            columns = [[m[0] for m in made], [m[1] for m in made]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    # the first class's text comes first in its part
    return sent.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (long): the smallest doc_id that links lead to.

    Two rows link if their sets of distinct k-word shingles have a Jaccard
    similarity of at least `percent` / 100. A text of fewer than k words is one
    shingle; a null or empty one has none and links with nothing. Repeated rows
    link with each other (unless empty). Rows without doc_id keep a null
    component and link with nothing. Other columns of `docs` are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    seen = materialize(counted(docs, k, percent), "classes")
    of = seen.where("real is null").select("doc_id", "n_shingles", "class")
    named = seen.where("class is not null and doc_id is not null")
    reps = materialize(named.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("bits").alias("bits")), "firsts")
    frequent, total = frequent_tokens(seen)
    buckets = BUCKETS
    while buckets * PER_BUCKET < total * (100 - percent) // 100:
        buckets *= 2
    found = materialize(groups(known, frequent, k, percent, buckets), "groups")
    nodes = reps.select(F.col("class").alias("id"))
    links = materialize(verify(known, reps, _pairs(found), k, percent), "links")
    labels = connected_components(nodes, links)
    # nearest of other labels
    bits = reps.select(F.col("class").alias("id"), "bits")
    near = _possible_unlike(found, labels.join(bits, "id"), percent, True).select("a", "b").distinct()
    more = materialize(verify(known, reps, near, k, percent), "links")
    if not more.isEmpty():
        links = links.union(more)
        labels = connected_components(nodes, links)
    # what is left
    left = materialize(_possible_unlike(found, labels.join(bits, "id"), percent, False).select("bucket", F.col("a").alias("id")), "left")
    about = materialize(_prefixes(known, reps.join(left.select(F.col("id").alias("class")).distinct(), "class"), frequent, k, percent), "prefixes")
    rows = left.join(labels, "id").join(about, "id").select("bucket", "id", F.col("component_id").alias("label"), "bits", "tokens")
    more = materialize(verify(known, reps, _unconnected(found, rows, percent), k, percent), "links")
    if not more.isEmpty():
        labels = connected_components(nodes, links.union(more))
    labels = labels.withColumnRenamed("id", "class").withColumnRenamed("component_id", "_c")
    smallest = reps.join(labels, "class").groupBy("_c").agg(F.min("doc_id").alias("component_id"))
    out = of.join(labels.join(smallest, "_c").select("class", "component_id"), "class", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
