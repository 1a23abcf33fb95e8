"""Operators 11 to 13 against brute force, and on odd tables."""

import heapq
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from memlake.llm import mixing, negatives, phrases, secrets

VECTORS = "vec_id long, label int, vec array<long>, anchor boolean, rank string, score string"


def mined(rows, positives=5, k=10):
    sound = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for a in (r for r in sound if r[3]):
        seen = sorted(((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in sound if b[0] != a[0] and len(b[2]) == len(a[2])))
        for s, i, _ in [x for x in seen if x[2] == a[1]][:positives]:
            fit = [x for x in seen if x[2] != a[1] and 30 * -s <= 100 * -x[0] <= 90 * -s]
            out += [(a[0], i, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit[:k])]
    return sorted(out)


@pytest.fixture(params=[(3, 10), (5, 400)])
def vectors(request):
    """Few different vectors, so that scores tie; one holds a third of the rows; odd rows."""
    dim, spread = request.param
    rng = random.Random(dim)
    rows = [(k, rng.randrange(3), [rng.randint(-spread, spread) for _ in range(dim)], k % 20 == 0, "a", "b") for k in range(400)]
    rows += [(400 + k, k % 3, [spread] * dim, k % 50 == 0, None, None) for k in range(200)]
    rows += [(None, 1, [1] * dim, True, None, None), (900, None, [1] * dim, True, None, None), (901, 1, None, True, None, None), (902, 1, [None] * dim, True, None, None)]
    rows += [(903, 1, [2, 3], True, None, None), (904, 1, [4, 5], None, None, None), (905, 2, [2, 3], False, None, None), (906, 1, [], True, None, None), (5, 2, [spread] * dim, False, None, None)]
    return rows


@pytest.mark.parametrize("part", [negatives.PART, 64])
def test_hard_negatives(spark, vectors, part, monkeypatch):
    monkeypatch.setattr(negatives, "PART", part)
    monkeypatch.setattr(negatives, "LEAF", 8)
    got = negatives.hard_negatives(spark.createDataFrame(vectors, VECTORS).repartition(3))
    assert sorted(map(tuple, got.collect())) == mined(vectors)


def test_extreme_scores_are_exact(spark):
    rows = [(0, 0, [2**40, 1], True), (1, 0, [2**22, 5], False), (2, 1, [2**21, 2**20], False), (3, 1, [2**21, 2**20 + 1], False), (4, 1, [2**63 - 1] * 2, False)]
    got = negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, vec array<long>, anchor boolean")).collect()
    assert [(r["negative_id"], r["negative_score"]) for r in got] == [(3, 2**61 + 2**20 + 1), (2, 2**61 + 2**20)]


def test_no_vectors(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0


def test_tree_visits_only_the_annulus():
    """In two dimensions the traversal leaves most leaves alone, and finds what a full scan finds."""
    rng = np.random.default_rng(3)
    x = rng.integers(-1000, 1000, (80_000, 2))
    tree = negatives.Searcher(np.arange(len(x)), np.zeros(len(x), np.int64), [r.tobytes() for r in x.astype("<i8")], float((x * x).sum(axis=1).max()))
    leaves, score = [], tree.score
    tree.score = lambda a, z, *rest: leaves.append(a) or score(a, z, *rest)
    q = np.array([[300, -400]])
    q2, f, d = tree.ask(q.astype(float))
    got = tree.window(q[0].astype(float), q[0].astype("<i8").tobytes(), q2[0], f[0], d[0], -1, 1, False, -50_000, 200_000, 10)
    s = x @ q[0]
    want = sorted((-int(s[i]), int(i)) for i in np.flatnonzero((s >= -50_000) & (s <= 200_000)))[:10]
    assert got == [(-a, i) for a, i in want]
    assert len(leaves) < 0.25 * sum(n < 0 for n in tree.tree.near)


DOCS = "doc_id long, text string, source string, size string, taken string"


def mixed_rows():
    rng = random.Random(5)
    rows = [(k, " ".join("w" * rng.randint(1, 3) for _ in range(int(rng.paretovariate(0.5)) % 3000)), ("hot", "hot", "b", "c", None, "é", "tiny")[k % 7], "x", "y") for k in range(300)]
    rows += [(1000, "one", "single", None, None), (1001, None, "none", None, None), (1002, " \t ", "none", None, None), (None, "no id here", "b", None, None), rows[3], (1003, "w " * 40_000, "b", None, None)]
    return rows


def targets(sizes):
    """By rounds: shares by weight, what exceeds three times a source's words is cut and shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, of = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        want = {s: Fraction(3 * sizes[s]) if s in capped else Fraction(left * weight[s], of) for s in order}
        over = {s for s in order if want[s] > 3 * sizes[s]}
        if not over:
            return want
        capped |= over


def test_mixing(spark):
    rows = mixed_rows()
    size = lambda t: len((t or "").split())
    made = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(4))
    got = mixing.taken(made).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((d is None, d or 0, size(t)) for d, t, *_ in rows)
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    sources = {r["source"]: r for r in made.sources.collect()}
    assert all(abs(sources[s]["target"] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert all(abs(sources[s]["take"] - want[s]) <= 0.5 for s in sizes)
    assert sum(r["taken"] for r in got) == sum(r["take"] for r in sources.values())
    # seats: the highest quotients, one after another
    claims = {r["sid"]: r["target"] * r["n"] / r["source_size"] for r in sources.values() if r["source_size"] and r["target"]}
    heap, seats = [(-v, sid, 0) for sid, v in claims.items()], []
    heapq.heapify(heap)
    for _ in range(round(sum(claims.values()))):
        _, sid, k = heapq.heappop(heap)
        seats.append((sid, k))
        heapq.heappush(heap, (-claims[sid] / (2 * k + 3), sid, k + 1))
    assert {(r["sid"], r["seat"]): r["shard"] for r in made.seats.collect()} == {x: i * 16 // len(seats) for i, x in enumerate(seats)}
    # what the shards are made of
    spans = mixing.spans(made).collect()
    words = Counter()
    for r in spans:
        words[r["doc_id"]] += r["words"]
    by_id = Counter()
    for r in got:
        by_id[r["doc_id"]] += r["taken"]
    assert +words == +by_id
    again = sorted(map(repr, mixing.taken(mixing.mix(spark.createDataFrame(rows[::-1], DOCS).repartition(2))).collect()))
    assert again == sorted(map(repr, got))


def test_permuted_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000):
        x = np.arange(n)
        p = mixing.permuted(x, np.full(n, n), np.full(n, 7, np.uint64))
        assert sorted(p.tolist()) == x.tolist()
        assert mixing.permuted(p, np.full(n, n), np.full(n, 7, np.uint64), back=True).tolist() == x.tolist()


def test_mixing_takes_targets_to_the_word(spark):
    """Here rounding and the short last block leave 95 words, more than a block has."""
    sizes = {"a": 583, "b": 90}
    made = mixing.mix(spark.createDataFrame([(k, "w " * n, s, None, None) for k, (s, n) in enumerate(sizes.items())], DOCS))
    want = targets(sizes)
    assert {r["source"]: r["take"] for r in made.sources.collect()} == {s: int(want[s] + Fraction(1, 2)) for s in sizes}
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken(made).collect()}
    words = Counter()
    for r in mixing.spans(made).collect():
        words[r["doc_id"]] += r["words"]
    assert taken == words == {k: int(want[s] + Fraction(1, 2)) for k, s in enumerate(sizes)}


def test_no_documents_to_mix(spark):
    made = mixing.mix(spark.createDataFrame([], DOCS))
    assert mixing.taken(made).count() == mixing.spans(made).count() == 0
    assert [r["taken"] for r in mixing.taken(mixing.mix(spark.createDataFrame([(1, None, "a", "", "")], DOCS))).collect()] == [0]


TEXTS = "doc_id long, text string, lang string, rank string, n string, score string"


def collocated(rows, longest, least, top, share):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = {}
    for _, text, lang, *_ in rows:
        of = counts.setdefault(lang or "und", Counter())
        for c in ".,;:!?\n\v\f\r":
            text = (text or "").replace(c, ".")
        for piece in text.translate(lower).split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            of.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        n, found = sum(c for p, c in f.items() if len(p) == 1), []
        frequent = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], c)
        for p, a in frequent.items():
            if 100 * inside[p] < share * a or p not in inside:
                score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


@pytest.mark.parametrize("longest,least,top,share,block", [(3, 10, 2000, 50, 1 << 23), (2, 3, 20, 50, 500), (4, 2, 2000, 60, 2000), (3, 200, 50, 50, 1 << 23)])
def test_collocations(spark, longest, least, top, share, block):
    rng = random.Random(2)
    vocabulary = ["The", "the", "of", "new", "YORK", "york", "É", "é", "a b", "x" * 100, "-", "中", "c\x00d"]
    text = lambda n: "".join(rng.choice(vocabulary[: 3 + int(rng.paretovariate(1)) % 11]) + rng.choice([" "] * 9 + [" \t", ". ", ",", "\n", ";x:", "!?", "\r\n"]) for _ in range(n))
    rows = [(k, text(rng.randint(0, 60)), ("en", "de", None, "und")[k % 4], "a", "b", "c") for k in range(120)]
    rows += [rows[0], rows[0], (None, text(50), "en", None, None, None), (500, None, "en", None, None, None), (501, "", None, None, None, None), (502, text(5000), "en", None, None, None)]
    got = phrases.collocations(spark.createDataFrame(rows, TEXTS).repartition(3), longest, least, top, share, 19, block)
    assert dict(got.dtypes)["rank"] == "bigint"
    assert sorted(map(tuple, got.collect())) == collocated(rows, longest, least, top, share)


def test_no_texts(spark):
    assert phrases.collocations(spark.createDataFrame([], TEXTS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", "", "")], TEXTS)).count() == 0


def test_many_secrets_in_one_text(spark):
    """Time in proportion to the matches, and the same places and text as one by one."""
    n = 50_000
    unit = "é password=abcdef1 "
    df = spark.createDataFrame([(1, unit * n), (2, unit * 300 + "end"), (3, None), (4, "")], "doc_id long, text string")
    out = secrets.with_secrets(df)
    spans = {r["doc_id"]: (r["n"], r["first"], r["last"]) for r in out.selectExpr("doc_id", "size(base) as n", "base[0].start as first", "try_element_at(base, -1).end as last").where("n > 0").collect()}
    assert spans == {1: (n, 2, n * len(unit) - 1), 2: (300, 2, 300 * len(unit) - 1)}
    masked = {r["doc_id"]: r["text"] for r in secrets.redacted(out).collect()}
    assert masked == {1: "é [SECRET] " * n, 2: "é [SECRET] " * 300 + "end", 3: None, 4: ""}
