"""Jaccard join, substring dedup and embedding near-dedup against brute force."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from conftest_llm import given

from memlake.llm import embeddings, jaccard, substrings


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard(docs, k, percent):
    sets = {}
    for i, t in given(docs):
        w = t.encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(ids, links) | {None: None}
    got = jaccard.jaccard_components(docs, k, percent).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in given(docs))
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["component_id"] == want[r["doc_id"]] for r in got)
    assert len(links) > 10


def test_jaccard_with_frequent_tokens_only(docs, monkeypatch):
    """Combinations of frequent tokens find what single ones do."""
    known = docs.where("doc_id is not null").select("doc_id", "text")
    every = np.unique(np.concatenate([jaccard.shingles(t.encode(), jaccard.Hashes(), 3) for _, t in given(known) if t.split()]))
    plain = jaccard._pairs(jaccard.groups(known, np.zeros(0, np.uint64), 3, 90)).collect()
    combined = jaccard._pairs(jaccard.groups(known, every, 3, 90)).collect()
    both = [{tuple(r) for r in p} for p in (plain, combined)]
    assert both[0] and {x for p in both[0] for x in p} == {x for p in both[1] for x in p}


@pytest.mark.parametrize("long", [12, 40, 500])
def test_jaccard_groups_of_near_copies(spark, monkeypatch, long):
    """Many near copies of few texts, whose tokens are all frequent: combinations, single tokens and both, all three rounds."""
    for name, value in (("OFTEN", 3), ("IN_BLOCK", 1), ("LONG", long), ("ORDERS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(5)
    rows = []
    for base in range(4):
        words = [f"b{base}w{k}" for k in range(30 + 15 * base)]
        for _ in range(60):
            w = list(words)
            for at in rng.choice(len(w), rng.integers(0, 4), replace=False):
                w[at] = f"x{rng.integers(0, 6)}"
            rows.append((len(rows), " ".join(w)))
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in rows for w in [t.split()]}
    root = {k: k for k in sets}

    def of(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and of(a) != of(b):
                root[max(of(a), of(b))] = min(of(a), of(b))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == {k: of(k) for k in sets}


def test_jaccard_last_round_names_unconnected_members_only(spark, monkeypatch):
    """Members of a group that the second round has given one label do not come to the third."""
    for name, value in (("OFTEN", 3), ("IN_BLOCK", 1), ("ORDERS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    rng, rows, named = np.random.default_rng(5), [], []
    for base in range(4):
        words = [f"b{base}w{k}" for k in range(30 + 15 * base)]
        for _ in range(60):
            w = list(words)
            for at in rng.choice(len(w), rng.integers(0, 4), replace=False):
                w[at] = f"x{rng.integers(0, 6)}"
            rows.append((len(rows), " ".join(w)))
    last = jaccard._unconnected
    monkeypatch.setattr(jaccard, "_unconnected", lambda found, rows, percent: named.append(rows) or last(found, rows, percent))
    jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).count()
    labels = defaultdict(set)
    for r in named[0].collect():
        labels[r["bucket"]].add(r["label"])
    assert labels and all(len(x) > 1 for x in labels.values())


def test_jaccard_entries_of_long_texts():
    """Sets whose tokens are all frequent have as many entries as their prefix is long; those of up to LONG tokens have combinations."""
    s = np.sort(np.random.default_rng(1).integers(0, 1 << 62, 100_000).astype(np.uint64))
    assert len(jaccard.entries(s, s, 90)) == 10_002
    assert len(jaccard.entries(s[:100], s, 90)) == 12 * 11 // 2 and len(jaccard.entries(s[:480], s, 90)) == 50 + 50 * 49 // 2


def test_jaccard_empty(empty):
    assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("window", [20, 5])
def test_substrings(docs, window):
    seen, covered, split = set(), {}, {}
    for i, t in sorted({x for x in given(docs) if x[0] is not None}):
        w = split[i] = t.encode().split()
        own = [False] * len(w)
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                own[a : a + window] = [True] * window
            seen.add(key)
        covered[i] = own
    assert sum(map(sum, covered.values())) > 300
    got = substrings.dedup_substrings(docs, window).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in given(docs))
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
            continue
        kept = [w for w, c in zip(split[r["doc_id"]], covered[r["doc_id"]], strict=True) if not c]
        assert r["n_words"] == len(split[r["doc_id"]]) and r["n_removed"] == sum(covered[r["doc_id"]])
        assert r["kept"].encode().split() == kept and (r["text"] or "").encode().split() == kept
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert r["shard"] == "c"


def test_heavy_anchors_change_nothing(docs, monkeypatch):
    want = {(r["doc_id"], r["kept"]) for r in substrings.dedup_substrings(docs, 8).collect()}
    real = substrings.heavy_anchors
    monkeypatch.setattr(substrings, "heavy_anchors", lambda d, w: (_all_anchors(d, w), real(d, w)[1]))
    assert {(r["doc_id"], r["kept"]) for r in substrings.dedup_substrings(docs, 8).collect()} == want


def _all_anchors(docs, window):
    rows = [(i, t.encode()) for i, t in given(docs) if i is not None and len(t.split()) >= window]
    table = substrings.Hashes()
    b = substrings.Block([i for i, _ in rows], [0] * len(rows), [table.of(t.split()) for _, t in rows], window)
    return np.unique(b.anchor).view(np.int64).tolist()[::2]


def test_substrings_empty(empty):
    assert substrings.dedup_substrings(empty).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for c in range(30):
        center = rng.standard_normal(16)
        for _ in range(1 + c % 6):
            rows.append((center + rng.standard_normal(16) * rng.choice([0, 0.02, 0.06, 0.2])).astype(np.float32).tolist())
    out = [(k, v, k % 2) for k, v in enumerate(rows)]
    n = len(out)
    out += [(n, rows[0], 0), (n + 1, rows[0], 0), (n + 2, [2 * x for x in rows[0]], 0), (n + 3, rows[0], None), (n + 4, None, 0), (n + 5, [0.0] * 16, 0), (n + 6, [math.nan] * 16, 0)]
    out += [(n + 7, [None] + rows[0][1:], 0), (n + 8, rows[0][:8], 0), (n + 9, rows[0][:8], 0), (n + 10, [], 0), (n + 11, [math.inf] + rows[0][1:], 0), (None, rows[0], 0)]
    return out


@pytest.mark.parametrize("part", [1024, 3])
def test_embeddings(spark, monkeypatch, part):
    monkeypatch.setattr(embeddings, "PART", part)
    rows = vectors()
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    sound = [(i, np.array(v, float), x) for i, v, x in rows if i is not None and x is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = defaultdict(set)
    for i, v, x in sound:
        for k, w, y in sound:
            if i != k and x == y and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i].add(k)
    want = components([i for i, _, _ in rows if i is not None], [(a, b) for a in links for b in links[a]])
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows) and sum(map(len, links.values())) > 40
    assert got[None]["component_id"] is None and got[None]["n_links"] == 0
    assert {i: got[i]["component_id"] for i in want} == want
    assert {i: got[i]["n_links"] for i in want} == {i: len(links[i]) for i in want}
    assert all(got[i]["kept"] == (want[i] == i) for i in want)


def test_substring_factors(spark):
    """Factors name where their words stand first; rows that share a doc_id and differ in text lose words of their own only."""
    a, b = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(50)]
    texts = [(1, a), (2, b), (3, ["x", *a[10:45], "y", *b[:30], "z"]), (4, a[:25] + b[5:40]), (5, a[3:30]), (5, ["short"]), (5, ["p", *b[20:45], "q"]), (6, a[20:50] * 2)]
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in texts], "doc_id long, text string").coalesce(1)  # one block
    got = {(r["doc_id"], r["text"]): r for r in substrings.dedup_substrings(df.withColumn("old", F.col("text"))).collect()}
    got = {(r["doc_id"], r["old"]): [tuple(f) for f in r["factors"]] for r in got.values()}
    want = [[], [], [(1, 35, 1, 10), (37, 30, 2, 0)], [(0, 25, 1, 0), (25, 35, 2, 5)], [(0, 27, 1, 3)], [], [(1, 25, 2, 20)]]
    for (k, w), factors in zip(texts, want, strict=False):
        assert got[k, " ".join(w)] == factors, k
    own = got[6, " ".join(texts[-1][1])]
    assert own[0] == (0, 30, 1, 20) and own[-1] == (30, 30, 1, 20)  # windows over the seam stand first here


def test_embeddings_repeated_ids_and_sizes(spark):
    """Rows that share a vec_id are vectors of their own; very small and very large components link like others."""
    small, large = [1e-200, 2e-200, 0.0], [1e200, 2e200, 1e198]
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [0.0, 1.0, 0.001], 0), (3, small, 1), (4, large, 1), (5, [1.0, 2.0, 0.0], 1), (6, [1e-310, 2e-310, 0.0], 1)]
    got = sorted(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 3, 3, True), (4, 3, 3, False), (5, 3, 3, False), (6, 3, 3, False)]


def test_embeddings_recall():
    """Of pairs right at the threshold hardly any is missed by all tables."""
    rng = np.random.default_rng(1)
    for n in (1000, 100_000):
        bits, tables = embeddings.tables_for(n)
        a = rng.standard_normal((2000, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        other = rng.standard_normal((2000, 64))
        other -= (other * a).sum(axis=1, keepdims=True) * a
        other /= np.linalg.norm(other, axis=1, keepdims=True)
        b = 0.98 * a + math.sqrt(1 - 0.98**2) * other
        met = (embeddings.signatures(a, bits, tables) == embeddings.signatures(b, bits, tables)).any(axis=1)
        assert met.mean() >= 0.995


def test_embeddings_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_windows_of_a_block_take_little_memory():
    rng = np.random.default_rng(5)
    text = " ".join(f"w{k}" for k in rng.integers(0, 5000, 1 << 14))
    batches = [pa.record_batch({"doc_id": pa.array(range(65)), "text": pa.array([text] * 65)})]
    tracemalloc.start()
    try:
        block = next(substrings.blocks(iter(batches), 20))
        made = tracemalloc.get_traced_memory()[1]
        n = len(block.whole)
        tracemalloc.reset_peak()
        index = substrings.indexed(block, np.zeros(0, np.uint64), 11)
        found = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # hashes of the words and what the block keeps of each window (24 bytes) are 33 MB; here all windows but one text's are settled
    assert n == 64 * ((1 << 14) - 19) and made < 60e6 and found < 120e6
    assert sum(k is not None for k in index.column("doc_id").to_pylist()) == 63
