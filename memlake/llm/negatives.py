"""Hard-negative mining by vantage-point trees over norm-augmented vectors.

A row y gets one more component, sqrt(M^2 - |y|^2) with M the largest norm; an
anchor q, scaled by f to the norm M as the rows now have it, gets 0. Then
|fq - y|^2 = 2 M^2 - 2f q.y: the highest inner product is the least distance, and
a window of scores is an annulus of distances.

A vantage-point tree is fitted on a bounded sample; every row goes down it to a
block, and blocks are dealt into trees of a bounded number of rows, each with a
vantage-point tree of its own, written once. Anchors are sent only to trees
that can hold rows inside their annulus, first to one, and then, with the k-th
best score that was found there, to those others that can do better. In a tree
nodes and rows are taken nearest first, from the annulus's inner radius
outwards, until k rows have come. Scores are whole numbers and exact; distances
only decide where to look, with a margin for rounding.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import materialize

#: Positives of an anchor, negatives of each, and their least and largest scores in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows that the upper tree is fitted on at most and its most leaves; rows of a tree and of a leaf; anchors that meet a tree at a time; seed.
SAMPLE, BLOCKS, PART, LEAF, ASKED, SEED = 4096, 1024, 16384, 512, 4096, 11
#: Share of M^2 + |q|^2 that rounding may shift a score's bound by.
MARGIN = 1e-9
_FAR = np.iinfo(np.int64)


def _floats(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1).astype(float)


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]])


def _to(points: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances from each of x to each point."""
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * (x @ points.T), 0))


@dataclass
class Tree:
    """Nodes from 0, the root: first and last row (exclusive), children (-1: a leaf), and for each child the least and largest distance
    of its rows from the node's vantage point."""

    first: list[int]
    last: list[int]
    near: list[int]
    far: list[int]
    points: list[np.ndarray]
    ranges: list[tuple[float, float, float, float]]


def grow(x: np.ndarray, leaf: int, deepest: int = 64) -> tuple[Tree, np.ndarray]:
    """A vantage-point tree over x and the order of its rows; each node's vantage point is the row farthest from the first, halves are at the median distance."""
    order, tree = np.arange(len(x)), Tree([], [], [], [], [], [])

    def add(a: int, z: int, depth: int) -> int:
        node = len(tree.first)
        for held, value in zip((tree.first, tree.last, tree.near, tree.far, tree.points, tree.ranges), (a, z, -1, -1, x[order[a]] if z > a else np.zeros(x.shape[1]), (0.0,) * 4), strict=True):
            held.append(value)
        if z - a > leaf and depth < deepest:
            own = order[a:z]
            point = x[own[np.argmax(_to(x[own[:1]], x[own])[:, 0])]]
            d = _to(point[None, :], x[own])[:, 0]
            by = np.argsort(d, kind="stable")
            if d[by[-1]] > d[by[0]]:
                order[a:z], d = own[by], d[by]
                m = len(own) // 2
                tree.points[node], tree.ranges[node] = point, (d[0], d[m - 1], d[m], d[-1])
                tree.near[node] = add(a, a + m, depth + 1)
                tree.far[node] = add(a + m, z, depth + 1)
        return node

    add(0, len(x), 0)
    return tree, order


def _scaled(q: np.ndarray, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Anchors scaled to the rows' norm with a component 0 more, and what each was scaled by; zero vectors stay."""
    q2 = (q * q).sum(axis=1)
    f = np.sqrt(np.divide(top, q2, out=np.ones(len(q)), where=(q2 > 0) & (top > 0)))
    return np.hstack([q * f[:, None], np.zeros((len(q), 1))]), f


def _scores(d_least, d_most, q2, f, top: float) -> tuple:
    """Least and largest scores of rows at such distances from scaled anchors of the squared norm q2."""
    slack = MARGIN * (q2 + top) / f + 1
    return (q2 + top - d_most * d_most) / (2 * f) - slack, (q2 + top - d_least * d_least) / (2 * f) + slack


class Searcher:
    """A tree's rows with its nodes; `window` is the incremental traversal."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: list[bytes], top: float):
        self.top = top
        x = _floats(rows)
        self.tree, order = grow(_augmented(x, top), LEAF)
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.points = np.array(self.tree.points)
        self.most = float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
        self.whole = [rows[k] for k in order]

    def ask(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the asked vectors the squared norms when scaled, what they are scaled by, and their distances to the vantage points."""
        x, f = _scaled(q, self.top)
        return (x * x).sum(axis=1), f, _to(self.points, x)

    def score(self, a: int, z: int, q: np.ndarray, whole: bytes, plain: bool) -> np.ndarray:
        """Exact inner products: by floating point where it is exact for whole numbers (`plain`), else by Python's; beyond a long they are its largest or least."""
        if plain:
            return self.x[a:z] @ q
        own = np.frombuffer(whole, "<i8").tolist()
        return np.array([max(_FAR.min, min(_FAR.max, sum(map(int.__mul__, np.frombuffer(r, "<i8").tolist(), own)))) for r in self.whole[a:z]], np.int64)

    def window(self, q: np.ndarray, whole: bytes, q2: float, f: float, d: np.ndarray, own: int, label: int, same: bool, low: int, high: int, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), or all, of rows of the same or of another label with scores from low to high; never the anchor's own id."""
        tree, found, best = self.tree, [], []
        plain = self.most * float(np.abs(q).max(initial=0)) < 2**53
        heap: list[tuple] = [(-high, 0, 0)]
        while heap and len(found) < k:
            key, row, at = heapq.heappop(heap)
            if row:
                found.append((-key, at))
            elif tree.near[at] >= 0:
                near, near_most, far, far_most = tree.ranges[at]
                for child, a, z in ((tree.near[at], near, near_most), (tree.far[at], far, far_most)):
                    least = max(0.0, d[at] - z, a - d[at])
                    lower, upper = _scores(least, d[at] + z, q2, f, self.top)
                    if upper >= low and lower <= high and (len(best) < k or upper >= best[0]):
                        heapq.heappush(heap, (max(key, -min(upper, high)), 0, child))
            else:
                a, z = tree.first[at], tree.last[at]
                s = self.score(a, z, q, whole, plain)
                here = np.flatnonzero((s >= max(low, best[0] if len(best) == k else low)) & (s <= high))
                here = here[((self.labels[a:z][here] == label) == same) & (self.ids[a:z][here] != own)]
                if len(here) > k:
                    here = here[np.lexsort((self.ids[a:z][here], -s[here]))[:k]]
                for score, i in zip(map(int, s[here].tolist()), self.ids[a:z][here].tolist(), strict=True):
                    heapq.heappush(heap, (-score, 1, i))
                    heapq.heappush(best, score)
                    if len(best) > k:
                        heapq.heappop(best)
        return found


def _trees(upper: dict[int, Tree], top: float):
    """One row for a group (dim, block, part): its rows and how far they are from the vantage points on the way to its block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, block, part = (int(pdf[c].iloc[0]) for c in ("dim", "block", "part"))
        pdf = pdf.sort_values(["vec_id", "label"], kind="stable")
        rows = pdf["vec"].tolist()
        path: list[int] = []
        tree = upper.get(dim)
        if tree:
            path = _paths(tree)[block]
        d = _to(np.array([tree.points[p] for p in path]), _augmented(_floats(rows), top)) if path else np.zeros((1, 0))
        return pd.DataFrame({
            "dim": [dim], "block": [block], "part": [part], "n": [len(pdf)], "path": [path], "least": [d.min(axis=0).tolist()], "most": [d.max(axis=0).tolist()],
            "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "labels": [pdf["label"].to_numpy("<i8").tobytes()], "vecs": [b"".join(rows)],
        })

    return run


def _paths(tree: Tree) -> dict[int, list[int]]:
    """For each leaf the nodes above it."""
    found, todo = {}, [(0, [])]
    while todo:
        node, above = todo.pop()
        if tree.near[node] < 0:
            found[node] = above
        else:
            todo += [(tree.near[node], [*above, node]), (tree.far[node], [*above, node])]
    return found


def _down(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf that each of x comes to."""
    at = np.zeros(len(x), np.int64)
    d = _to(np.array(tree.points), x)
    near, far = np.array(tree.near), np.array(tree.far)
    split = np.array([(r[1] + r[2]) / 2 for r in tree.ranges])
    while (inner := near[at] >= 0).any():
        own = np.flatnonzero(inner)
        here = at[own]
        at[own] = np.where(d[own, here] <= split[here], near[here], far[here])
    return at


def _routed(upper: dict[int, Tree], top: float):
    """vec_id, label, vec of rows with dim and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                rows = batch.column("vec").to_pylist()
                dims = np.array([len(r) // 8 for r in rows])
                block = np.zeros(len(rows), np.int64)
                for dim in set(dims.tolist()) & set(upper):
                    own = np.flatnonzero(dims == dim)
                    block[own] = _down(upper[dim], _augmented(_floats([rows[k] for k in own]), top))
                columns = [batch.column("vec_id"), batch.column("label"), batch.column("vec"), pa.array(dims.astype(np.int32)), pa.array(block.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "vec", "dim", "block"])

    return run


_ASKED = "aid long, own long, label long, vec binary, slot long, low long, high long"


def _admitted(trees: list[dict], upper: dict[int, Tree], top: float, probe: bool):
    """Each asked row with `tree`: with `probe` the one whose scores reach highest in its window, without it all others that can hold rows
    of its window than the one it has."""
    by_dim: dict[int, list[dict]] = {}
    for t in trees:
        by_dim.setdefault(t["dim"], []).append(t)
    step = max(16, min(1024, (1 << 22) // max(1, len(trees))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rows = batch.column("vec").to_pylist()
                dims = np.array([len(r) // 8 for r in rows])
                low, high = (batch.column(c).to_numpy().astype(float) for c in ("low", "high"))
                for dim in set(dims.tolist()) & set(by_dim):
                    own = np.flatnonzero(dims == dim)
                    q = _floats([rows[k] for k in own])
                    x, f = _scaled(q, top)
                    q2 = (x * x).sum(axis=1)
                    d = _to(np.array(upper[dim].points), x) if dim in upper else None
                    numbers, bounds = np.array([t["tree"] for t in by_dim[dim]]), []
                    for t in by_dim[dim]:
                        least, most = np.zeros(len(own)), np.full(len(own), 1e300 ** 0.5)
                        for p, a, z in zip(t["path"], t["least"], t["most"], strict=True):
                            least = np.maximum(least, np.maximum(d[:, p] - z, a - d[:, p]))
                            most = np.minimum(most, d[:, p] + z)
                        bounds.append(_scores(least, most, q2, f, top))
                    lower, best = (np.array(x) for x in zip(*bounds, strict=True))
                    if probe:
                        t, k = np.lexsort((-lower, -np.minimum(best, high[own])), axis=0)[0], np.arange(len(own))
                    else:
                        had = batch.column("tree").to_numpy()[own]
                        t, k = np.nonzero((best >= low[own]) & (lower <= high[own]) & (numbers[:, None] != had[None, :]))
                    out = batch.select([x for x in batch.schema.names if x != "tree"]).take(pa.array(own[k]))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(numbers[t])], names=[*out.schema.names, "tree"])

    return run


class Index:
    """The rows in written trees, and the searches in them."""

    def __init__(self, rows: DataFrame):
        """rows: vec_id, label, vec (longs as bytes)."""
        self.spark = rows.sparkSession
        norms = rows.mapInArrow(_norms, "norm double").agg(F.max("norm"), F.count("*")).first()
        self.top, n = norms[0] or 0.0, norms[1]
        sample = rows.orderBy(F.xxhash64(F.lit(SEED), "vec_id", "vec"), "vec_id").limit(SAMPLE).select("vec").collect()
        by_dim: dict[int, list[bytes]] = {}
        for r in sample:
            by_dim.setdefault(len(r["vec"]) // 8, []).append(bytes(r["vec"]))
        leaves = min(BLOCKS, -(-n // PART))
        # vectors of a length that few of the sample have stay in one block
        self.upper = {dim: grow(_augmented(_floats(x), self.top), max(8, len(sample) // max(1, leaves)))[0] for dim, x in by_dim.items() if dim and len(x) > 8}
        routed = rows.mapInArrow(_routed(self.upper, self.top), "vec_id long, label long, vec binary, dim int, block int")
        routed = materialize(routed.withColumn("_k", F.monotonically_increasing_id()), "routed")
        sizes = routed.groupBy("dim", "block").agg(F.ceil(F.count("*") / PART).cast("int").alias("_n"))
        dealt = routed.join(sizes, ["dim", "block"]).withColumn("part", F.pmod(F.xxhash64("_k"), F.col("_n")).cast("int")).drop("_n", "_k")
        made = dealt.groupBy("dim", "block", "part").applyInPandas(
            _trees(self.upper, self.top), "dim int, block int, part int, n long, path array<int>, least array<double>, most array<double>, ids binary, labels binary, vecs binary"
        )
        self.trees = materialize(made.withColumn("tree", F.monotonically_increasing_id()), "trees")
        # of each tree a few numbers: a row for PART rows of the table
        self.about = [r.asDict() for r in self.trees.select("tree", "dim", "path", "least", "most").collect()]

    def _found(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """aid, slot, vec_id, score of each asked row's k best in its tree."""
        top = self.top

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            t = right.iloc[0]
            vecs, n = t["vecs"], int(t["n"])
            step = len(vecs) // n
            tree = Searcher(np.frombuffer(t["ids"], "<i8"), np.frombuffer(t["labels"], "<i8"), [vecs[i * step : (i + 1) * step] for i in range(n)], top)
            q = _floats(left["vec"].tolist())
            q2, f, d = tree.ask(q)
            out = []
            for i, r in enumerate(left.itertuples(index=False)):
                out += [(r.aid, r.slot, v, s) for s, v in tree.window(q[i], r.vec, float(q2[i]), float(f[i]), d[i], r.own, r.label, same, r.low, r.high, k)]
            return pd.DataFrame(out, columns=["aid", "slot", "vec_id", "score"]).astype("int64")

        many = asked.groupBy("tree").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("_n"))
        dealt = asked.join(many, "tree").withColumn("_g", F.pmod(F.xxhash64("aid"), F.col("_n")).cast("int")).drop("_n")
        own = self.trees.select("tree", "n", "ids", "labels", "vecs").join(many, "tree").withColumn("_g", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        return dealt.groupBy("tree", "_g").cogroup(own.groupBy("tree", "_g")).applyInPandas(_both(run), "aid long, slot long, vec_id long, score long")

    def best(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """aid, slot, vec_id, score, rank (from 1): the k best rows, or all, in each asked window; asked as `_ASKED`."""
        names = [x.split()[0] for x in _ASKED.split(", ")]
        schema = f"{_ASKED}, tree long"
        asked = materialize(asked.select(*names).mapInArrow(_admitted(self.about, self.upper, self.top, True), schema), "windows")
        first = materialize(self._found(asked, k, same), "found")
        floors = first.groupBy("aid", "slot").agg(F.count("*").alias("_n"), F.min("score").alias("_s")).where(F.col("_n") >= k)
        rest = asked.join(floors, ["aid", "slot"], "left").withColumn("low", F.greatest("low", "_s")).select(*names, "tree")
        others = materialize(rest.mapInArrow(_admitted(self.about, self.upper, self.top, False), schema), "others")
        both = first.union(self._found(others, k, same))
        rank = F.row_number().over(Window.partitionBy("aid", "slot").orderBy(F.desc("score"), "vec_id"))
        return both.withColumn("rank", rank).where(F.col("rank") <= k)


def _both(run):
    def guarded(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return run(left, right) if len(left) and len(right) else pd.DataFrame(columns=["aid", "slot", "vec_id", "score"]).astype("int64")

    return guarded


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The squared norm of each vector."""
    for batch in batches:
        norms = [float((x * x).sum()) for x in (np.frombuffer(r, "<i8").astype(float) for r in batch.column("vec").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(norms, pa.float64())], names=["norm"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of longs as bytes."""
    for batch in batches:
        values, ends = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<i8"), np.cumsum([0, *pc.list_value_length(batch.column(2)).to_pylist()]).tolist()
        vecs = [values[a:z].tobytes() for a, z in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vecs, pa.binary()), batch.column(3)], names=["vec_id", "label", "vec", "anchor"])


def hard_negatives(
    vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score (long).

    vectors: vec_id, label (any type), vec (array of longs), anchor (boolean).
    The score of two rows is their inner product; highest first, ties by
    smaller vec_id. An anchor's positives are its first `positives` rows of the
    same label and another vec_id; each one's negatives are the first rows of
    another label whose scores are from `low` to `high` percent of its own, so
    a positive of a score below 0 has none. Rows with a null vec_id, label,
    vector or component take no part; rows meet only rows of as many
    components. Rows that repeat are rows of their own, anchors too. Scores
    beyond a long count as its largest or least. An empty table gives none.
    Other columns are not read.
    """
    sound = F.expr("vec_id is not null and label is not null and vec is not null and forall(vec, x -> x is not null)")
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("label").alias("label"), "vec", F.coalesce("anchor", F.lit(False)).alias("anchor"))
    rows = materialize(rows.mapInArrow(_packed, "vec_id long, label long, vec binary, anchor boolean"), "vectors")
    index = Index(rows.select("vec_id", "label", "vec"))
    # numbers that hold once they are written
    anchors = materialize(rows.where("anchor").select(F.monotonically_increasing_id().alias("aid"), F.col("vec_id").alias("own"), "label", "vec"), "anchors")
    whole = anchors.withColumns({"slot": F.lit(0).cast("long"), "low": F.lit(_FAR.min), "high": F.lit(_FAR.max)})
    best = materialize(index.best(whole, positives, True).select("aid", F.col("vec_id").alias("positive_id"), F.col("score").alias("slot")), "positives")
    share = lambda percent, more: f"cast((cast({percent} as decimal(4, 0)) * cast(slot as decimal(19, 0)) + {more}) div 100 as bigint)"
    windows = best.where("slot >= 0").select("aid", "slot").distinct().join(anchors, "aid").withColumns({"low": F.expr(share(low, 99)), "high": F.expr(share(high, 0))})
    found = index.best(windows.where("low <= high"), negatives, False)
    return (
        found.join(best, ["aid", "slot"]).join(anchors.select("aid", F.col("own").alias("anchor_id")), "aid")
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("slot").alias("positive_score"), F.col("score").alias("negative_score"))
    )
