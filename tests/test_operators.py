"""Operators on small tables: sources, changes, streams, ranking, history."""

import hashlib
import json
import math
import re
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake import schema
from memlake.functions import scores, text
from memlake.operators import dedup, evaluation, filters, graph, joins, search, sinks, temporal, vectors
from memlake.sources import logs
from memlake.streaming import ingest


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()), key=repr)


def test_jsonl_and_messages(spark, tmp_path):
    lines = [
        {"type": "user", "sessionId": "s1", "message": {"content": "hello"}, "timestamp": "2024-01-01T00:00:00Z"},
        {"type": "assistant", "sessionId": "s1", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool", "text": "x"}, {"type": "text", "text": "b"}]}},
        {"type": "progress", "sessionId": "s1"},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = logs.session_messages(spark.read.text(str(tmp_path / "log.jsonl")).withColumnRenamed("value", "raw"))
    assert rows(got, "sender", "content") == [("assistant", "a\nb"), ("user", "hello")]
    read = logs.read_jsonl(spark, str(tmp_path / "log.jsonl"), schema.T.StructType([schema.T.StructField("type", schema.T.StringType())])).cache()
    assert read.where("_bad is not null").count() == 1 and read.count() == 4


def test_notes_qrels_and_queue(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Title\n\ntext")
    assert rows(logs.read_notes(spark, str(tmp_path / "docs" / "*.md")), "kind", "title") == [("docs", "Title")]
    (tmp_path / "q.json").write_text(json.dumps({"q1": {"d1": 3, "d2": 0}}))
    assert rows(logs.read_qrels(spark, str(tmp_path / "q.json")), "query", "doc", "grade") == [("q1", "d1", 3), ("q1", "d2", 0)]
    files = spark.createDataFrame([("b", "enrichment"), ("a", "enrichment"), ("c", "store")], "name string, kind string")
    assert rows(logs.queue_files(files, 1), "name") == ["c"] and rows(logs.queue_files(files.where("name <> 'c'"), 1), "name") == ["a"]
    manifests = spark.createDataFrame([("p", '{"dependencies": {"x": "1"}, "devDependencies": {"x": "0", "y": "2"}}')], "project string, json string")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    assert rows(logs.dependencies(manifests), "package", "version") == [("x", "1"), ("y", "2")]


def test_carried_and_continuations(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, None)], "s int, o int, v string")
    assert rows(logs.carried(df, "s", "o", "v"), "s", "o", "v") == [(1, 1, "a"), (1, 2, "a"), (2, 1, None)]
    m = spark.createDataFrame([("s", datetime(2024, 1, 1), "f1"), ("s", datetime(2024, 1, 2), "f2"), ("t", None, "f1")], "session string, at timestamp, file string")
    assert rows(logs.continuations(m), "session") == ["s"]


def test_changes(spark):
    now = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "id string, v int, o int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, o int")
    merged = sinks.upsert(old, new, "id", "o")
    assert rows(merged, "id", "v") == [("a", 1), ("b", 4), ("c", 5)]
    assert rows(sinks.upsert(merged, new, "id", "o"), "id", "v") == rows(merged, "id", "v")
    assert rows(sinks.updated(old, spark.createDataFrame([("a", None), ("b", 9)], "id string, v int"), "id"), "id", "v") == [("a", 1), ("b", 9)]
    t = spark.createDataFrame([("a", None, None), ("b", None, "z")], "id string, archived_at timestamp, superseded_by string")
    assert rows(sinks.archived(t, t.where("id = 'a'"), "id", now).where("archived_at is not null"), "id") == ["a"]
    pairs = spark.createDataFrame([("a", "b"), ("b", "nowhere")], "old string, new string")
    assert rows(sinks.superseded(t, pairs, "id"), "id", "superseded_by") == [("a", "b"), ("b", "z")]
    c = spark.createDataFrame([("x", 50.0), (" ", 1.0), (None, None)], "content string, importance double").withColumn("content_class", F.lit(None).cast("string")).withColumn("created_at", F.lit(None).cast("timestamp"))
    assert rows(sinks.canonical(c, now), "importance", "content_class") == [(10.0, "knowledge")]
    assert sinks.unseen(c.where("content = 'x'").union(c), c.where("content = 'x'"), "content").where("content = 'x'").count() == 0
    edges = spark.createDataFrame([("a", "b", None), ("a", "c", None)], "s string, t string, valid_until timestamp")
    assert rows(sinks.expired(edges, edges.where("t = 'b'"), ["s", "t"], now).where("valid_until is not null"), "t") == ["c"]
    assert json.loads(sinks.as_json(old.where("id = 'a'")).first()["value"]) == {"id": "a", "v": 1, "o": 0}


def test_conform(spark):
    got = schema.conform(spark.createDataFrame([("a", "3")], "chunk_id string, importance string"), schema.CHUNK)
    assert got.schema.names == schema.CHUNK.names and got.first()["importance"] == 3.0
    tags = spark.createDataFrame([('["a","b"]',), ("bad",), (None,)], "t string").select(schema.parsed_tags("t").alias("t"))
    assert sorted(r["t"] for r in tags.collect()) == [[], [], ["a", "b"]]


def test_stream_equals_batch_and_runs_again(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.jsonl").write_text('{"id": 1, "v": "a"}\nbroken\n{"id": 2, "v": "b"}\n')
    kind = schema.T.StructType([schema.T.StructField("id", schema.T.LongType()), schema.T.StructField("v", schema.T.StringType())])
    at = [str(tmp_path / x) for x in ("out", "bad", "check")]
    for _ in range(2):  # nothing is read twice
        stream = ingest.jsonl_stream(spark, str(source), kind)
        ingest.write_batches(stream, at[0], at[1], F.col("id").isNull(), at[2])
    assert rows(spark.read.parquet(at[0]), "id") == [1, 2] and rows(spark.read.parquet(at[1]), "_raw") == ["broken"]
    (source / "2.jsonl").write_text('{"id": 3, "v": "c"}\n')
    ingest.write_batches(ingest.jsonl_stream(spark, str(source), kind), at[0], at[1], F.col("id").isNull(), at[2])
    assert rows(spark.read.parquet(at[0]), "id") == [1, 2, 3]


def test_unread(spark):
    messages = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "seq int, tag string")
    acks, subs = spark.createDataFrame([("x", 1)], "agent string, seq int"), spark.createDataFrame([("x", "a"), ("y", "b"), ("y", "a")], "agent string, tag string")
    assert rows(ingest.unread(messages, acks, subs), "agent", "seq") == [("x", 2), ("y", 1), ("y", 2), ("y", 3)]


def test_scores(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.cast("double").alias("x")).first()["x"]
    for days, half, n, pinned in ((0, 30, 0, False), (400, 30, 2, False), (1e6, 7, 0, False), (1e6, 7, 0, True)):
        want = 1.0 if pinned else max(0.05, 1 / (1 + days / (9 * half * (1 + 0.3 * math.log1p(n)))))
        assert math.isclose(value(scores.decay(F.lit(days), F.lit(half), F.lit(n), F.lit(pinned))), want)
    assert [value(scores.half_life(F.lit(x).cast("double"))) for x in (None, 0, 1, 5, 10, 20)] == [30, 7, 7, 30, 90, 90]
    assert math.isclose(value(scores.fused(F.lit(0), F.lit(None).cast("int"))), 0.25 / 60)
    assert value(scores.damped(F.lit(1000.0), 1.0)) == 100 and value(scores.damped(F.lit(3.0), 0.5)) == 2


@pytest.mark.parametrize(("said", "label", "score"), [
    ("this is broken", "frustration", -0.6), ("thanks", "neutral", 0.25), ("amazing, thanks", "positive", 1.0), ("broken, thanks", "frustration", -0.1), ("a table", "neutral", 0.0), (None, "neutral", 0.0),
])
def test_feeling(spark, said, label, score):
    got = spark.createDataFrame([(said,)], "t string").select(text.feeling(F.col("t")).alias("f")).first()["f"]
    assert got["label"] == label and math.isclose(got["score"], score, abs_tol=1e-9)


def test_texts(spark):
    df = spark.createDataFrame([("The cat sat on the mat",), ("cat, SAT mat!",), ("a@b.com and c@d.org, a@b.com xa@b.com",), ("x\n\n" + "y" * 25 + "\n\nz",)], "t string")
    hashes = [r[0] for r in df.select(text.content_hash(F.col("t"))).collect()]
    assert hashes[0] == hashes[1] != hashes[2]
    assert [r[0] for r in df.select(text.numbered(F.col("t"), text.EMAIL, "EMAIL")).collect()][2] == "[EMAIL_1] and [EMAIL_2], [EMAIL_1] [EMAIL_3]"
    assert [r[0] for r in df.select(text.paragraphs(F.col("t"), 10)).collect()][3] == ["x", "y" * 10, "y" * 10, "yyyyy\n\nz"]
    at = spark.createDataFrame([("1700000000",), ("1700000000000",), ("1700000000000000000",), ("2023-11-14T22:13:20Z",), ("2023-11-14T22:13:20",), ("bad",)], "v string")
    assert [r[0] for r in at.select(text.instant(F.col("v"))).collect()] == [1.7e9] * 5 + [None]


def test_traverse_without_cycles_keeps_no_paths(spark, monkeypatch):
    def walked(edges, starts, depth):
        paths, out = [[s] for s in starts], set()
        for n in range(1, depth + 1):
            paths = [[*p, b] for p in paths for a, b in edges if a is not None and a == p[-1] and b is not None and b not in p]
            out |= {(p[0], p[-1], n) for p in paths}
        return sorted(out)

    written, real = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: written.append(df.columns) or real(df, name))
    tree = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("a", "b"), (None, "a"), ("e", None), ("d", "f")]
    for edges, depth, paths in ((tree, 3, False), (tree, 2, True), ([*tree, ("d", "a")], 3, True), ([*tree, ("b", "b")], 4, True), ([], 3, False)):
        written.clear()
        df = spark.createDataFrame(edges, "source_id string, target_id string").withColumn("relation_type", F.lit("x"))
        got = graph.traverse(df, spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string"), depth)
        assert rows(got, "start", "id", "depth") == walked(edges, ["a", "b"], depth)
        assert any("path" in c for c in written) == paths


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "a", "x"), ("b", "d", "y")], "source_id string, target_id string, relation_type string")
    start = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.traverse(edges, start, 3), "id", "depth") == [("b", 1), ("c", 2), ("d", 2)]
    assert rows(graph.traverse(edges, start, 3, ["x"]), "id", "depth") == [("b", 1), ("c", 2)]
    state = spark.createDataFrame([("a", "b", "x", 0.5, 1.0, None, 1), ("a", "b", "x", 0.7, None, None, 2)], "source_id string, target_id string, relation_type string, confidence double, importance double, valid_from string, o int")
    assert rows(graph.merged_edges(state, "o"), "confidence", "importance") == [(0.7, 1.0)]


def test_diversity(spark):
    df = spark.createDataFrame([(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.99, [1.0, 0.0]), (0, 3, 0.8, [0.0, 1.0]), (0, 4, 0.5, [0.0, 0.0])], "g int, id int, s double, v array<double>")
    got = {r["id"]: r["place"] for r in vectors.diversified(df, "g", "id", "s", "v").collect()}
    assert got == {1: 1, 3: 2, 2: 3, 4: 4}


def test_near_bits(spark):
    df = spark.createDataFrame([(1, 0, "e"), (2, 7, "e"), (3, 15, "e"), (4, -1, "e"), (5, -1, "f"), (6, 1 << 62, "e")], "id long, b long, l string")
    assert rows(dedup.near_pairs(df, "id", "b", ["l"]), "a", "b") == [(1, 2), (1, 6), (2, 3)]
    same = vectors.hashed_bits(spark.createDataFrame([(1, "one two three four five"), (2, "ONE two, three four five"), (3, ""), (4, None)], "id long, t string"), "id", "t")
    got = {r["id"]: r["simhash"] for r in same.collect()}
    assert got[1] == got[2] and got[3] == got[4] == -1


def near_by_hand(rows):
    """Class of each (key, text, scope, week): by all pairs, with bits and numbers made anew."""
    def tokens(t, plain):
        t = t.lower()
        if plain:
            t = re.sub(r"\b\d{4}-\d{2}-\d{2}[t ][0-2]\d:[0-5]\d:[0-5]\d(?:\.\d+)?(?:z|[+-][0-2]\d:?[0-5]\d)?\b", " ", t)
        return [w for w in re.findall("[a-z0-9]+", t) if w not in text.STOP_WORDS]

    def bits(words):
        runs = ["sh:" + " ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ["tok:" + w for w in words]
        hashes = [int.from_bytes(hashlib.blake2b(r.encode(), digest_size=8).digest(), "big") for r in runs]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) >= len(hashes))

    facts = {}
    for key, t, scope, week in rows:
        if t is not None:
            facts[key] = (scope, " ".join(tokens(t, False)), week, set(re.findall("[0-9]+", t)), bits(tokens(t, True)), len(tokens(t, True)))
    root = {r[0]: r[0] for r in rows}

    def of(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, x in facts.items():
        for b, y in facts.items():
            same = x[1] == y[1] or (x[2] == y[2] and x[3] == y[3] and min(x[5], y[5]) >= 8 and (x[4] ^ y[4]).bit_count() <= 3)
            if a < b and x[0] == y[0] and same and of(a) != of(b):
                root[max(of(a), of(b))] = min(of(a), of(b))
    return {k: of(k) for k in root}


def test_near_classes(spark):
    long = "some rather long sentence about ducks and geese that swim across every wide lake near our old town house"
    texts = [
        (1, long, "p", "w1"), (2, long.upper() + "!", "p", "w1"), (3, long + " 7", "p", "w1"), (4, long, "q", "w1"), (5, long.replace("old", "odd"), "p", "w1"), (6, long, "p", "w2"),
        (7, "short text", "p", None), (8, "the short text", "p", None), (9, None, "p", None), (10, "", None, None), (11, "", None, "w1"), (12, long + " 2024-01-02T03:04:05Z", "p", "w1"),
        (13, long.replace("old", "odd"), "p", None), (14, "of the", None, "w1"),
    ] + [(20 + k, long + " tail" * k, "r", "w1") for k in range(12)]
    df = spark.createDataFrame([(*t, -t[0]) for t in texts], "id long, t string, p string, w string, o long")
    got = dedup.near_classes(df, "id", "t", ["p"], F.col("w"), F.col("o")).collect()
    assert {r["id"]: r["class_id"] for r in got} == near_by_hand(texts)
    kept = {r["class_id"]: r["id"] for r in got if r["kept"]}
    assert kept[1] == max(r["id"] for r in got if r["class_id"] == 1) and len(kept) == len({r["class_id"] for r in got})
    assert dedup.near_classes(df.where("false"), "id", "t", ["p"]).count() == 0


def test_near_classes_of_a_whole_table(spark):
    from memlake import registry

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r["doc_id"]: r["class_id"] for r in registry.QUERIES["simhash_near_dups"](spark, folder).collect()}
    assert got == near_by_hand([(r["doc_id"], r["text"], r["lang"], None) for r in docs])


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ASKED", 3)
    monkeypatch.setattr(vectors, "SEARCHED", 7)
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(30, 4)), 1)
    v[10:14] = v[3]
    v[20] = 0
    rows_ = [(k, [float(x) for x in r]) for k, r in enumerate(v)] + [(40, None), (41, []), (42, [1.0, None, 0.0, 0.0]), (43, [1.0])]
    df = spark.createDataFrame(rows_, "id long, v array<double>")
    asked = df.where("id % 4 = 0")
    by = {"l2": lambda a, b: ((a - b) ** 2).sum(), "hamming": lambda a, b: float(((a > 0) != (b > 0)).sum()), "cosine": lambda a, b: -(a @ b) / np.sqrt((a @ a) * (b @ b)) if a.any() and b.any() else None}
    for kind, f in by.items():
        got = defaultdict(list)
        for r in vectors.search(df, asked, "id", "v", 5, kind, itself=False).orderBy("rank").collect():
            got[r["asked"]].append(r["id"])
        for a in range(0, 30, 4):
            d = sorted((round(x, 9), b) for b in range(30) if b != a and (x := f(v[a], v[b])) is not None)
            assert got.pop(a, []) == [b for _, b in d[:5]], (kind, a)
        assert not got
    near = vectors.within(df.withColumn("least", F.lit(0.9)), asked, "id", "v", "least")
    want = {(a, b) for a in range(0, 30, 4) for b in range(30) if a != b and (x := by["cosine"](v[a], v[b])) is not None and -x >= 0.9}
    assert {(r["asked"], r["id"]) for r in near.collect()} == want
    assert vectors.search(df.where("false"), asked, "id", "v", 5).count() == vectors.search(df, asked.where("false"), "id", "v", 5).count() == 0


def test_history(spark):
    changes = spark.createDataFrame([("k", 1, 1), ("k", 5, 2), ("m", 3, 3)], "key string, at int, id int")
    h = temporal.versions(changes, "key", "at", "id")
    assert rows(temporal.as_of(h, F.lit(4)), "id") == [1, 3] and rows(temporal.as_of(h, F.lit(5)), "id") == [2, 3]
    closed = temporal.closed(h, changes.where("key = 'k'"), "key", F.lit(9))
    assert rows(closed, "id", "period_end") == [(1, 5), (2, 9), (3, None)]


def test_evaluation(spark):
    run = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "c", 1.0)], "query string, doc string, score double")
    qrels = spark.createDataFrame([("q", "b", 2), ("q", "c", 1), ("q", "z", 0), ("r", "a", 1)], "query string, doc string, grade int")
    got = {r["query"]: r for r in evaluation.metrics(run, qrels, 2).collect()}
    assert math.isclose(got["q"]["ndcg"], (2 / math.log2(3)) / (2 + 1 / math.log2(3)))
    assert (got["q"]["recall"], got["q"]["precision"], got["q"]["ap"], got["q"]["rr"]) == (0.5, 0.5, 0.25, 0.5)
    assert got["r"]["ndcg"] == got["r"]["rr"] == 0


def test_search_and_filters(spark):
    df = spark.createDataFrame([(1, "the red fox"), (2, "the red red dog"), (3, "a blue fox")], "id int, t string")
    assert rows(search.matching(df, "id", "t", ["red", "fox"]), "id") == [1] and rows(search.matching(df, "id", "t", ["red", "fox"], "or"), "id") == [1, 2, 3]
    got = {r["id"]: r["score"] for r in search.bm25(df, "id", "t", ["blue"]).collect()}
    assert list(got) == [3] and math.isclose(got[3], math.log(2.5 / 1.5) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 3 / (10 / 3))))
    assert rows(df.where(filters.glob("t", "the r?d*")), "id") == [1, 2]
    assert rows(df.where(filters.after_key([("t", False), ("id", True)], ["the red fox", 1])), "id") == [2]
    alias = spark.createDataFrame([(1, 3)], "old_id int, new_id int")
    assert rows(joins.resolve_aliases(df, alias, "id"), "id", "found") == [(1, 3), (2, 2), (3, 3)]


def test_clusters(spark):
    from memlake.operators import clusters

    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (7, 8, 1.0)], "a long, b long, weight double")
    got = {r["id"]: r["label"] for r in clusters.label_propagation(edges).collect()}
    assert got[1] == got[2] == got[3] and got[7] in (7, 8) and got[1] not in (7, 8)
    events = spark.createDataFrame([("k", 0), ("k", 1), ("k", 2), ("k", 2_000_000), ("j", 5)], "key string, us long")
    assert rows(clusters.paced(events, "key", "us", 1.0, 2), "key", "us", "allowed") == [("j", 5, True), ("k", 0, True), ("k", 1, True), ("k", 2, False), ("k", 2_000_000, True)]
    log = spark.createDataFrame([("f", 10), ("f", 30), ("g", 99)], "source string, at int")
    assert rows(clusters.rewound(log, spark.createDataFrame([("f", 20)], "source string, end int"), "source", "at"), "source", "at") == [("f", 10), ("g", 99)]


def test_words_of_correction_end_at_letters_of_ascii(spark):
    from memlake.functions.text import provenance

    rows = [(1, "\u00a0" * 80 + "yes"), (2, "noté"), (3, "no"), (4, "yes"), (5, "nothing here noted")]
    got = spark.createDataFrame(rows, "k int, said string").withColumn("before", F.lit("noté nothing here noted"))
    got = {r[0]: r[1] for r in got.select("k", provenance(F.lit(None).cast("string"), F.lit("user"), F.col("said"), F.col("before"))).collect()}
    assert got == {1: "endorsement", 2: "direct", 3: "direct", 4: "endorsement", 5: "endorsement"}


def test_last_seen_without_trailing_zeros(spark, tmp_path):
    from memlake import registry

    ts = ["2024-01-01 00:00:00.250000", "2024-01-01 00:00:01", "2024-01-01 00:00:02.000001"]
    rows = [(k, t, k, "view", 1.0, f'{{"k": {10 * k}}}') for k, t in enumerate(ts)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    e.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in registry.QUERIES["project_activity"](spark, str(tmp_path)).collect()]
    assert got == [("p2", ts[2]), ("p1", ts[1]), ("p0", "2024-01-01 00:00:00.25")]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pairs_of_members_that_share_most_groups(spark, kind, monkeypatch):
    """As counted by hand, and no join by group."""
    rng = np.random.default_rng(4)
    rows = {(int(g), int(m)) for g, m in zip(rng.integers(0, 9, 900), rng.integers(0, 50, 900), strict=True)}
    df = spark.createDataFrame([*rows, *list(rows)[:50], (None, 3), (4, None)], "g long, m long").selectExpr(f"cast(g as {kind}) g", f"cast(m as {kind}) m")
    monkeypatch.setattr(joins, "BLOCK", 16)
    monkeypatch.setattr(joins, "COLUMNS", 4)
    got = {(r["a"], r["b"]): r["n"] for r in joins.pairs_within(df, "g", "m").collect()}
    of = defaultdict(set)
    for g, m in rows:
        of[m if kind == "long" else str(m)].add(g)
    assert got == {(a, b): len(of[a] & of[b]) for a in of for b in of if a < b and of[a] & of[b]}
    plan = joins.pairs_within(spark.range(500).selectExpr("id % 100 as m", "id div 100 as g"), "g", "m")._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Join" not in plan


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("kind", [False, True])
def test_pairs_are_counted_by_hashes_of_members(spark, kind, collide, monkeypatch):
    """As counted by hand: small groups and large ones, rows that repeat, nulls, hashes that two members share; what is exchanged for a pair has no texts."""
    rng = np.random.default_rng(8)
    rows = [(int(g), f"{'ab'[m % 2]}:{m}") for g, m in zip(rng.integers(0, 300, 1500), rng.integers(0, 400, 1500), strict=True)] + [(7, f"a:{m}") for m in range(60)]
    df = spark.createDataFrame([*rows, *rows[:50], (None, "a:2"), (4, None)], "g long, m string")
    monkeypatch.setattr(joins, "LARGE", 20)
    if collide:
        monkeypatch.setattr(joins, "_coded", lambda c: F.length(c).cast("long"))
    found = joins.pairs_within(df, "g", "m", kind=F.substring("m", 1, 1) if kind else None)
    of = defaultdict(set)
    for g, m in rows:
        of[m].add(g)
    assert {(r["a"], r["b"]): r["n"] for r in found.collect()} == {(a, b): len(of[a] & of[b]) for a in of for b in of if a < b and of[a] & of[b] and not (kind and a[0] == b[0])}
    keys = {f.dataType.typeName() for f in spark.createDataFrame([], found.schema).schema if f.name in "ab"}
    assert keys == {"string"} and ("xxhash64(m" in found._jdf.queryExecution().optimizedPlan().toString()) != collide


def test_hashed_bits_of_runs_in_parts(spark, monkeypatch):
    """As of whole lists of runs, whatever is held and however many are hashed at a time."""
    rng = np.random.default_rng(3)
    texts = {k: " ".join(f"w{x}" for x in rng.integers(0, 30, n)) for k, n in enumerate([0, 1, 3, 4, 5, 40, 90])} | {7: None, 8: "v" * 400 + " x y z", 9: "the"}
    df = spark.createDataFrame(sorted(texts.items()), "k long, t string").coalesce(1)

    def bits(words):
        runs = [f"sh:{' '.join(words[i : i + 4])}" for i in range(len(words) - 3)] or [f"tok:{w}" for w in words]
        rows = [np.unpackbits(np.frombuffer(hashlib.blake2b(r.encode(), digest_size=8).digest(), np.uint8)) for r in runs]
        return int.from_bytes(np.packbits(np.sum(rows, axis=0, dtype=int) * 2 >= len(runs)).tobytes(), "big", signed=True) if runs else -1

    words = {k: [w for w in (t or "").split() if w not in text.STOP_WORDS] for k, t in texts.items()}
    for name, value in (("CACHED", 3), ("LONGEST", 12), ("RUNS", 5)):
        monkeypatch.setattr(vectors, name, value)
    got = {r["k"]: (r["simhash"], r["n_tokens"]) for r in vectors.hashed_bits(df, "k", "t").collect()}
    assert got == {k: (bits(w), len(w)) for k, w in words.items()}


@pytest.mark.parametrize("itself", [False, True])
def test_search_holds_few_distances(spark, itself, monkeypatch):
    """A block is compared in parts of few rows, with the same results."""
    rng = np.random.default_rng(9)
    x = rng.integers(-2, 3, (70, 6)).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>").coalesce(1)
    asked = df.where("k % 3 = 0").withColumn("least", F.lit(0.7))
    search = lambda: sorted(tuple(r) for r in vectors.search(df, asked, "k", "v", 5, itself=itself).select("asked", "k", "rank").collect())
    within = lambda: sorted((r["asked"], r["k"]) for r in vectors.within(df.withColumn("least", F.lit(0.7)), asked, "k", "v", "least").collect())
    whole = search(), within()
    monkeypatch.setattr(vectors, "HELD", 200)
    assert (search(), within()) == whole and whole[0] and whole[1]


@pytest.mark.parametrize("k", [1, 3, 7, 9])
def test_least_of_each_row_by_place(k):
    """As a stable sort of whole rows, with ties, NaN and infinite values."""
    rng = np.random.default_rng(6)
    d = rng.integers(0, 4, (200, 7)).astype(float)
    d[rng.random(d.shape) < 0.2], d[rng.random(d.shape) < 0.1], d[0] = np.nan, np.inf, np.nan
    want = [(r, c) for r in range(len(d)) for c in np.argsort(d[r], kind="stable")[:k].tolist() if not np.isnan(d[r, c])]
    assert list(zip(*(x.tolist() for x in vectors._least(d, k)), strict=True)) == want


def test_relations_are_grouped_in_parts_by_rows(spark, monkeypatch):
    """Rows are dealt to tasks by their number before they are grouped, without a change of results."""
    from memlake.sources import tables

    folder = "/root/testdata/sf0.001"
    whole = sorted(map(str, tables.relations(spark, folder).collect()))
    monkeypatch.setattr(tables, "EACH", 500)
    rows = tables.relations(spark, folder)
    parts = tables.table(spark, folder, "lineitem").count() // 500
    assert parts > 8 and "hashpartitioning(l_partkey#" in (plan := rows._jdf.queryExecution().executedPlan().toString()) and f", {parts}), REPARTITION_BY_NUM" in plan
    assert sorted(map(str, rows.collect())) == whole


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_likeness_of_members_exchanges_no_pairs(spark, dense, kind, monkeypatch):
    """Jaccard, cosine, gap and equality as by hand, in blocks that are written and by group; blocks leave nothing to exchange or join."""
    rng = np.random.default_rng(5)
    rows = {(int(g), int(m)) for g, m in zip(rng.integers(0, 9 if dense else 300, 500), rng.integers(0, 50, 500), strict=True)}
    name = (lambda m: m) if kind == "long" else str
    df = spark.createDataFrame([*rows, *list(rows)[:50], (None, 3), (4, None), (None, 77)], "g long, m long").selectExpr("g", f"cast(m as {kind}) m")
    v = {m: [float(x) for x in rng.integers(-2, 3, 2 if m % 7 == 0 else 3)] for m in range(50) if m % 5}
    v |= {11: [1.0, 0.0, 0.0]} | ({12: [0.0, 0.0, 0.0]} if dense else {m: [1.0, *x[1:]] for m, x in v.items()})
    h = {m: float(rng.integers(0, 100)) for m in range(50) if m % 9}
    p = {m: f"p{m % 3}" for m in range(50) if m % 4}
    facts = spark.createDataFrame([(m, v.get(m), h.get(m), p.get(m)) for m in range(50)], "m long, v array<double>, h double, p string").withColumn("m", F.col("m").cast(kind))
    monkeypatch.setattr(joins, "BLOCK", 16)
    monkeypatch.setattr(joins, "COLUMNS", 4)
    monkeypatch.setattr(joins, "WRITTEN", 1)
    found = joins.jaccard_within(df, "g", "m", facts, ("v",), ("h",), ("p",))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan or "Aggregate" in plan) != dense
    of = defaultdict(set)
    for g, m in rows:
        of[m].add(g)

    def cosine(a, b):
        if a not in v or b not in v or len(v[a]) != len(v[b]):
            return None
        x, y = np.array(v[a]), np.array(v[b])
        return round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 9) if x.any() and y.any() else "nan"

    want = {}
    for a in of:
        for b in of:
            if name(a) < name(b) and (n := len(of[a] & of[b])):
                want[name(a), name(b)] = (n / len(of[a] | of[b]), cosine(a, b), abs(h[a] - h[b]) if a in h and b in h else None, a in p and p[a] == p.get(b))
    got = found.collect()
    assert {(r["a"], r["b"]): (r["jaccard"], r["v"] if r["v"] is None else "nan" if np.isnan(r["v"]) else round(r["v"], 9), r["h"], r["p"]) for r in got} == want and len(got) == len(want)
    bare = {(r["a"], r["b"]): r["jaccard"] for r in joins.jaccard_within(df, "g", "m").collect()}
    counted = {(r["a"], r["b"]) for r in joins.pairs_within(df, "g", "m").collect()}
    assert bare == {k: x[0] for k, x in want.items()} and counted == set(want)


def test_rounded_as_round(spark):
    x = [0.0000005, 0.1234565, 1.0000005, -0.0000005, -2.5e-6, 2.5e-6, 1e300, float("nan"), None, *(k / 320 for k in range(-400, 400)), *np.random.default_rng(1).normal(size=500).tolist()]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for digits in (2, 6):
        assert df.where(~F.round("x", digits).eqNullSafe(scores.rounded(F.col("x"), digits))).count() == 0


@pytest.mark.parametrize("kind", ["cosine", "l2", "hamming"])
def test_search_copies_no_vectors_and_is_exact(spark, kind, monkeypatch):
    """Distances that single precision cannot tell apart, copies, repeated keys and lengths, over blocks that are written once."""
    monkeypatch.setattr(vectors, "ASKED", 16)
    monkeypatch.setattr(vectors, "SEARCHED", 32)
    monkeypatch.setattr(vectors, "HELD", 100)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 5))[rng.integers(0, 12, 300)] + rng.normal(size=(300, 5)) * 10.0 ** -rng.integers(3, 12, (300, 1))
    x[40:60], x[70] = x[3], 0
    rows_ = [(k, r.tolist()) for k, r in enumerate(x)] + [(5, x[9].tolist()), (301, [1.0, 2.0]), (302, [2.0, 1.0]), (None, [1.0] * 5), (303, None), (304, [1e200] * 5)]
    df = spark.createDataFrame(rows_, "id long, v array<double>").repartition(3)
    found = vectors.search(df, df, "id", "v", 4, kind, itself=False)
    assert "CoGroup" not in found._jdf.queryExecution().optimizedPlan().toString()
    sound = [(k, np.array(v)) for k, v in rows_ if k is not None and v is not None]
    want = {}
    for a, v in sound:
        own = want.setdefault(a, [])
        same = [(k, w) for k, w in sound if k != a and len(w) == len(v)]
        d = vectors._distances(v[None, :], np.array([w for _, w in same]), kind)[0]
        own += [(round(float(y), 8), k) for (k, _), y in zip(same, d, strict=True) if not np.isnan(y)]
    got = defaultdict(list)
    for r in found.orderBy("asked", "rank").collect():
        got[r["asked"]].append((round(r["distance"], 8), r["id"]))
    for a, own in want.items():
        near = sorted(own)[:4]
        assert [d for d, _ in got[a]] == [d for d, _ in near] and set(got[a]) <= set(own), (a, got[a], near)
    whole = sorted(tuple(r) for r in found.collect())
    monkeypatch.setattr(vectors, "HELD", 1 << 20)
    monkeypatch.setattr(vectors, "SEARCHED", 1000)
    monkeypatch.setattr(vectors, "ASKED", 1000)
    again = sorted(tuple(r) for r in vectors.search(df, df, "id", "v", 4, kind, itself=False).collect())
    assert [r[:2] for r in again] == [r[:2] for r in whole]


def test_communities_by_hand(spark, tmp_path, monkeypatch):
    """Edges to the three nearest and four rounds of labels, as by hand, over blocks that are written once and not copied for each other."""
    from memlake import registry

    monkeypatch.setattr(vectors, "ASKED", 8)
    monkeypatch.setattr(vectors, "SEARCHED", 16)
    rng = np.random.default_rng(7)
    v = (rng.normal(size=(5, 6))[rng.integers(0, 5, 60)] + rng.normal(size=(60, 6)) / 2).astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    assert "CoGroup" not in vectors.neighbour_edges(df, "vec_id", "embedding", 3)._jdf.queryExecution().optimizedPlan().toString()
    c = np.round(v @ v.T / np.sqrt((v * v).sum(1)[:, None] * (v * v).sum(1)[None, :]), 9)
    weight = {}
    for a in range(60):
        for b in sorted((b for b in range(60) if b != a), key=lambda b: (-c[a, b], b))[:3]:
            weight[min(a, b), max(a, b)] = c[a, b]
    labels = {k: k for k in range(60)}
    for _ in range(4):
        votes = {k: defaultdict(float, {labels[k]: 0.5}) for k in labels}
        for (a, b), w in weight.items():
            votes[a][labels[b]] += w
            votes[b][labels[a]] += w
        labels = {k: max(x, key=lambda m: (round(x[m], 9), -m)) for k, x in votes.items()}
    assert dict(rows(registry.QUERIES["communities"](spark, str(tmp_path)), "id", "label")) == labels
