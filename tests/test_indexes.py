"""Indexes that are written once, and names in texts, against plain Python."""

import random
import re

import numpy as np
import pytest

from memlake.operators import textindex
from memlake.operators.spans import name_spans, name_table
from memlake.operators.textindex import TextIndex, add_part
from memlake.operators.vectorindex import VectorIndex


def test_text_index_reads_what_is_asked(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta one two été".split()) for _ in range(rng.randint(0, 12)))
    old = {k: text() for k in range(60)}
    new = {k: text() for k in range(40, 80)} | {80: "Alphabet alpha", 81: None, 82: ""}
    table = lambda rows: spark.createDataFrame(sorted(rows.items()), "k long, t string").repartition(3)
    add_part(table(old), str(tmp_path / "x"), 0, "k", "t")
    add_part(table(new), str(tmp_path / "x"), 1, "k", "t", table(dict.fromkeys(range(5), "")))
    add_part(table(new), str(tmp_path / "x"), 1, "k", "t", table(dict.fromkeys(range(5), "")))  # again, to no effect
    live = {k: t or "" for k, t in (old | new).items() if k >= 5}
    index = TextIndex(spark, str(tmp_path / "x"))
    words = {k: re.findall("[a-z0-9]+", t.lower()) for k, t in live.items()}
    got = lambda df: sorted(r[0] for r in df.collect())
    assert got(index.holding([["alpha"], ["one", "two"]]).select("key")) == [k for k, w in sorted(words.items()) if "alpha" in w and {"one", "two"} & set(w)]
    assert got(index.holding([["alph"]], begins=True)) == [k for k, w in sorted(words.items()) if any(x.startswith("alph") for x in w)]
    whole = table({k: new.get(k, old.get(k)) for k in range(83)})
    for part in ("TA al", "é", "été", "nothing here", "a"):
        assert got(index.containing(whole, "k", "t", part).select("k")) == [k for k, t in sorted(live.items()) if part.lower() in t.lower()]
    scores = {r["key"]: r["score"] for r in index.bm25(["beta", "two"]).collect()}
    mean = np.mean([len(w) for w in words.values()])
    want = {}
    for term in ("beta", "two"):
        df = sum(term in w for w in words.values())
        for k, w in words.items():
            if tf := w.count(term):
                want[k] = want.get(k, 0) + np.log((len(words) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / mean))
    assert scores == pytest.approx({k: s for k, s in want.items() if s > 0})
    # of the folders of 64 buckets only that of the asked term is read
    plan = index.read("postings", ["beta"], "tf")._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan)[1]
    assert re.search(r"bucket#\d+ (IN \(\d+\)|= \d+)", filters)


def test_text_index_rows_hold_many_texts(spark, tmp_path, monkeypatch):
    """Counts and sizes by term as in plain Python, for slices of any size; a term has a row for each slice, not for each text."""
    rng = random.Random(4)
    texts = {k: " ".join(rng.choice(["alpha", "Beta", "été", "x1", "日本語", "🙂b"]) for _ in range(rng.randint(0, 9))) for k in range(200)} | {200: None, 201: "ab", 202: "z" * 500}
    docs = spark.createDataFrame(sorted(texts.items()), "k long, t string").coalesce(1)
    runs = lambda t: [t[i : i + 3] for i in range(len(t) - 2)]
    for size in (1, 300, 1 << 21):
        monkeypatch.setattr(textindex, "AT_A_TIME", size)
        for kind, split in ((textindex._words, lambda t: re.findall("[a-z0-9]+", t)), (textindex._trigrams, runs)):
            got = textindex._postings(docs, "k", "t", kind).collect()
            flat = [(r["term"], *x) for r in got for x in zip(r["key"], r["tf"], r["size"], strict=True)]
            want = [(w, k, words.count(w), len(words)) for k, t in texts.items() for words in [split((t or "").lower())] for w in set(words)]
            assert sorted(flat) == sorted(want)
        assert size < 1 << 21 or len(got) == len({r["term"] for r in got})
    add_part(docs, str(tmp_path / "x"), 0, "k", "t")
    for kind in ("postings", "trigrams"):
        rows = spark.read.parquet(str(tmp_path / "x" / kind))
        assert rows.count() == rows.select("term").distinct().count()


def test_vector_lists(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([centres[rng.integers(12, size=1500)] + 0.4 * rng.standard_normal((1500, 16)), np.tile(centres[:1], (500, 1))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [1.0, 2.0]), (5003, [None] + [1.0] * 15)]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    index = VectorIndex(df, "k", "v", 24)
    asked = df.where("k % 25 = 0")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    own = np.arange(0, 2000, 25)
    d = np.round(-(unit[own] @ unit.T), 9)
    d[np.arange(len(own)), own] = np.inf
    want = {(int(own[i]), int(j)) for i in range(len(own)) for j in np.argsort(d[i], kind="stable")[:10]}
    of = lambda probes: {(r["asked"], r["key"]) for r in index.search(asked, "k", "v", 10, probes, itself=False).collect()}
    assert of(None) == want
    assert len(of(6) & want) >= 0.9 * len(want)
    assert VectorIndex(df.where("k < 0"), "k", "v").search(asked, "k", "v", 10).count() == 0


def chosen(text, names, once):
    words, out, seen, at = re.findall(r"[\w'-]+", text.lower()), [], set(), 0
    while at < len(words):
        for n in range(4, 0, -1):
            ids = [i for i in names.get(" ".join(words[at : at + n]), []) if not (once and i in seen)] if at + n <= len(words) else []
            if ids:
                out.append((at, n, ids[0]))
                seen.add(ids[0])
                at += n
                break
        else:
            at += 1
    return out


@pytest.mark.parametrize("once", [False, True])
def test_name_spans(spark, once):
    rng = random.Random(4)
    vocabulary = ["new", "York", "times", "the", "a", "square", "É", "o'hare"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    names = [(k, some(rng.randint(1, 4)), "x") for k in range(40)] + [(100, "New  YORK", "x"), (101, "the", "tag"), (102, None, "x"), (103, " ! ", "x"), (104, "the", None)]
    texts = [(k, some(rng.randint(0, 60)), "c") for k in range(50)] + [(900, None, "c"), (901, "", "c"), (902, some(5000), "c")]
    by = {}
    for i, name, kind in names:
        w = re.findall(r"[\w'-]+", (name or "").lower())
        if w and not (len(w) == 1 and kind == "tag"):
            by.setdefault(" ".join(w), []).append(i)
    table = name_table(spark.createDataFrame(names, "id long, name string, kind string"), "id", "name", "kind", ("tag",))
    got = {}
    for r in name_spans(spark.createDataFrame(texts, "d long, t string, at string").repartition(3), "d", "t", table, once).collect():
        got.setdefault(r["owner"], []).append((r["at"], r["n"], r["id"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, t, _ in texts if (v := chosen(t or "", {p: sorted(i) for p, i in by.items()}, once))}


def test_name_spans_of_a_long_text(spark):
    """Each place once held all words of its text."""
    names = name_table(spark.createDataFrame([(1, "red fox"), (2, "red fox den")], "id long, name string"), "id", "name")
    texts = spark.createDataFrame([(1, "red fox " * 30_000), (2, "red fox den"), (None, "a red fox")], "d long, t string")
    got = name_spans(texts, "d", "t", names).groupBy("owner", "id").count().collect()
    assert {tuple(r) for r in got} == {(1, 1, 30_000), (2, 2, 1), (None, 1, 1)}


@pytest.mark.parametrize("longs", [1, 4, 1 << 20])
def test_name_spans_exchange_only_what_can_be_a_name(spark, longs, monkeypatch):
    """With more first words than once were broadcast no place is exchanged by its first word, and a full bitmap changes no result."""
    from memlake.operators import spans

    monkeypatch.setattr(spans, "LONGS", longs)
    names = name_table(spark.range(50_001).selectExpr("id", "concat('w', id, ' x', id % 7) as name"), "id", "name")
    texts = spark.createDataFrame([(k, " ".join(f"w{j} x{j % (7 if j % 3 else 5)}" for j in range(k, k + 300))) for k in range(20)], "d long, t string")
    found = name_spans(texts, "d", "t", names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(first" not in plan and "_bits" in plan
    want = {(k, 2 * (j - k), j) for k in range(20) for j in range(k, k + 300) if j % 3 or j % 5 == j % 7}
    assert {(r["owner"], r["at"], r["id"]) for r in found.collect()} == want
    none = name_spans(texts, "d", "t", name_table(spark.range(0).selectExpr("id", "'a' as name"), "id", "name"))
    assert none.count() == 0
