"""Text rules, prompts, merges and upkeep on small tables: what the generated tables do not hold."""

from pyspark.sql import functions as F

from memlake.functions import text as x
from memlake.operators import graph as g
from memlake.operators import joins
from memlake.operators import search as s
from memlake.operators import upkeep as u


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, v {kind}").select("k", make(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows)]


def test_feelings_of_two_languages(spark):
    texts = ["זה לא עובד, נמאס", "תודה", "בדיוק מה שרציתי!", "שבורים", "why is it so? fml", "it works great", "exactly what I needed", "rigid", "thanks", "", None, "damn, thanks so much"]
    got = column(spark, texts, x.feeling)
    assert [r["label"] for r in got] == ["frustration", "neutral", "satisfaction", "neutral", "frustration", "positive", "satisfaction", "frustration", "neutral", "neutral", "neutral", "frustration"]
    assert [r["score"] for r in got] == [-1.0, 0.25, 0.8, 0.0, -1.0, 1.0, 0.8, -0.5, 0.25, 0.0, 0.0, -0.2]


def test_content_class(spark):
    texts = ["we decided on it", "smoke test of the bank", "smoke test", "heartbeat ok\nworker done", "heartbeat ok\nthe reader now keeps its offsets in the store", "<task-notification a>\nmuch text\nhere</task-notification>", "heartbeat תודה", "surface:3 down", "gist bench: why", "gist bench: my sleep", None]
    got = column(spark, texts, lambda c: x.content_class(c, benchmark="gist bench\\b"))
    assert got == ["decision", "knowledge", "test", "operational", "knowledge", "operational", "knowledge", "operational", "benchmark", "knowledge", "knowledge"]
    assert column(spark, ["a", "why"], lambda c: x.content_class(c, F.lit("learning"))) == ["knowledge", "knowledge"]
    assert column(spark, ["a", "heartbeat"], lambda c: x.content_class(c, F.lit("Decision"))) == ["decision", "decision"]
    assert column(spark, ["heartbeat ann", "heartbeat bob"], lambda c: x.content_class(c, persons=r"\bann\b")) == ["knowledge", "operational"]


def test_provenance(spark):
    rows = [
        (None, "user", "Yeah, exactly that", "use a queue", "endorsement"), (None, "user", "no, not that", "use a queue", "direct"), (None, "user", "a queue then", "use a queue", "endorsement"),
        (None, "user", "a lock then please", "use threads", "direct"), (None, "user", "yes", None, "direct"), ("tool_result", "user", "yes", "a", "inference"), ("user_message", None, "x" * 90, "x", "direct"),
        (None, "assistant", 'as you said "go"', None, "paraphrase"), ("assistant_text", "user", "so it is", None, "inference"), (None, None, None, None, "inference"),
    ]
    df = spark.createDataFrame(rows, "k string, w string, t string, b string, want string")
    got = df.select(x.provenance(F.col("k"), F.col("w"), F.col("t"), F.col("b")).alias("o"), "want").collect()
    assert [r["o"] for r in got] == [r["want"] for r in got]


def test_tags(spark):
    raw = [" React.js ", "tech__Debug", "a/b", "tech//debug", "misc", "123", "x", "y" * 65, "Gh Actions", "-/x.y/-", None]
    assert column(spark, raw, x.tag) == ["react", "tech-debug", None, "tech/debug", None, None, None, None, "github-actions", "x.y", None]
    lists = [["retrieval", "Retrievel", "react", "ReactJS", None, "api"], [], None]
    assert column(spark, lists, x.tag_list, "array<string>") == [["retrieval", "react", "api"], [], None]
    assert column(spark, [[f"tag-{chr(97 + k) * 3}" for k in range(20)]], lambda c: F.size(x.tag_list(c)), "array<string>") == [10]
    assert column(spark, ["nanoClaw", "Nano-Claw 5.5", "אבג", None], x.entity_key) == ["nanoclaw", "nanoclaw55", "אבג", ""]


def test_noise(spark):
    rows = [(["Pre-Compact"], None, "a", True, False), ([], {"Quarantined": "no"}, "a", True, True), ([], {"is_quarantined": "1"}, "", True, True), (None, None, "# Session-Restore", True, False), ([None, "k"], {"a": None}, None, False, False)]
    df = spark.createDataFrame(rows, "t array<string>, m map<string,string>, c string, hidden boolean, held boolean")
    got = df.select(x.noise(F.col("t"), F.col("m"), F.col("c")).alias("a"), x.noise(F.col("t"), F.col("m"), F.col("c"), True).alias("b"), "hidden", "held").collect()
    assert [(r["a"], r["b"]) for r in got] == [(r["hidden"], r["held"]) for r in got]


def test_prompt_rows(spark):
    scores = {"sure": [0.02, 0.019, 0.018, 0.017], "one sure": [0.02, 0.004, 0.003], "likely": [0.012, 0.011, 0.009], "possible": [0.006, 0.0055], "none": [0.004], "alone": [0.02]}
    rows = [(q, k, v, False) for q, vs in scores.items() for k, v in enumerate(vs)] + [("sure", 9, 0.5, True), ("tests only", 0, 0.5, True), ("likely", 8, 0.012, None)]
    df = spark.createDataFrame(rows, "q string, k long, v double, p boolean")
    got = {}
    for r in s.for_prompt(df, "q", "k", "v", F.col("p")).orderBy("place").collect():
        got.setdefault(r["q"], []).append(r["k"])
    assert got == {"sure": [0, 2, 1], "one sure": [0, 1], "likely": [0, 1, 8], "possible": [0], "alone": [0]}
    assert s.for_prompt(df.where("q = 'sure'"), "q", "k", "v", F.col("p"), 2).count() == 2
    assert s.for_prompt(df.limit(0), "q", "k", "v", F.col("p")).count() == 0


def test_bm25_splits_texts_once(spark):
    df = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "grey cat"), (4, None), (5, "grey dog"), (6, "")], "id long, t string")
    got = {r["id"]: round(r["score"], 9) for r in s.bm25(df, "id", "t", ["red", "red", "blue"]).collect()}
    # texts: 6 in number, 5 with a size; mean of the sizes that are known
    assert set(got) == {1, 2}
    assert s.bm25(df.limit(0), "id", "t", ["red"]).count() == 0


def test_hybrid_search_hides_before_ranking(spark):
    rows = spark.createDataFrame([(k, k % 2 == 0, "en" if k < 8 else "de") for k in range(10)], "id long, on boolean, lang string")
    scores = rows.select("id", (100 - F.col("id")).cast("double").alias("score"))
    got = [r["id"] for r in s.hybrid_search(rows, "id", scores, scores.limit(0), F.col("on"), F.col("lang") == "en", top=3).collect()]
    assert got == [0, 2, 4]
    boosted = s.hybrid_search(rows, "id", scores, scores, F.col("on"), None, {"late": F.when(F.col("id") == 8, 9.0).otherwise(1.0)}, {"late": 0.5}, top=1).first()
    assert boosted["id"] == 8 and boosted["r_fts"] == 4
    unweighed = s.hybrid_search(rows, "id", scores, scores, F.col("on"), None, {"late": F.when(F.col("id") == 8, 9.0).otherwise(1.0)}, {"late": 0.0}, top=1).first()
    assert unweighed["id"] == 0


def test_sessions_of_files(spark):
    df = spark.createDataFrame([(1, "/a.b/s1.jsonl"), (2, "s1"), (3, ""), (4, None), (5, "/x/.hidden"), (6, "/x/s2.tar.gz")], "k long, f string")
    known = spark.createDataFrame([("s1", "fixed")], "session_id string, outcome string")
    got = {r["k"]: (r["session_id"], r["outcome"]) for r in s.with_session(df, known, "f").collect()}
    assert got == {1: ("s1", "fixed"), 2: ("s1", "fixed"), 3: (None, None), 4: (None, None), 5: (".hidden", None), 6: ("s2.tar", None)}


def test_sounds(spark):
    sounds = lambda c: F.array_distinct(F.transform(F.split(c, " "), lambda w: F.soundex(w)))
    names = spark.createDataFrame([("Jon Smyth",), ("Ann",), ("zzz",)], "asked string").withColumn("key", sounds("asked"))
    aliases = spark.createDataFrame([("b", "John Smith"), ("a", "John Brown"), ("c", "Anne")], "id string, alias string").withColumn("key", sounds("alias"))
    assert sorted(tuple(r) for r in g.sounding_like(names, aliases).collect()) == [("Ann", "c", 1.0), ("Jon Smyth", "b", 1.0)]


def test_merged_links_keep_the_richer(spark):
    m = spark.createDataFrame([("a", 1, 0.5, "mine"), ("b", 1, 0.5, "yours"), ("b", 2, None, None), ("a", 2, 0.1, "seen"), ("c", 1, 1.0, None)], "entity_id string, chunk_id long, relevance double, context string")
    merges = spark.createDataFrame([("b", "a")], "merge_id string, keep_id string")
    assert sorted(tuple(r) for r in g.merge_mentions(m, merges, "context").collect()) == [("a", 1, 0.5, "yours"), ("a", 2, 0.1, "seen"), ("c", 1, 1.0, None)]
    e = spark.createDataFrame([("a", "b", "t", 0.5, 1.0), ("b", "c", "t", 0.2, 3.0), ("a", "c", "t", 0.9, None)], "source_id string, target_id string, relation_type string, confidence double, importance double")
    assert [tuple(r) for r in g.merge_edges(e, merges).collect()] == [("a", "c", "t", 0.9, 3.0)]


def test_pairs_of_two_kinds(spark):
    m = spark.createDataFrame([(k, e) for k in range(3) for e in ("p:1", "p:2", "s:1")] + [(7, None), (None, "p:1")], "chunk_id long, entity_id string")
    assert sorted(tuple(r) for r in g.co_mentions(m, F.substring("entity_id", 1, 1)).collect()) == [("p:1", "s:1", 3), ("p:2", "s:1", 3)]
    assert g.co_mentions(m).count() == 3


def test_pairs_of_large_groups(spark, monkeypatch):
    m = spark.createDataFrame([(k, e) for k, size in ((1, 30), (2, 7), (3, 5)) for e in range(size)], "chunk_id long, entity_id long")
    want = sorted(tuple(r) for r in g.co_mentions(m).collect())
    assert len(want) == 30 * 29 / 2 and (0, 1, 3) in want and (28, 29, 1) in want
    monkeypatch.setattr(joins, "LARGE", 5)
    assert sorted(tuple(r) for r in g.co_mentions(m).collect()) == want


def test_texts_merged_in_order(spark):
    df = spark.createDataFrame([("g", 2, "B  b"), ("g", 1, "b B"), ("g", 3, "other"), ("g", 4, None), ("h", 9, "one"), ("g", 5, "OTHER ")] + [("h", 10 + k, "ONE") for k in range(50)], "g string, k long, c string")
    assert {r["g"]: r["content"] for r in u.merged_text(df, "g", "k", "c").collect()} == {"g": "b B\n\n[merged]\n1. other", "h": "one"}


def test_retargeted_and_plans(spark):
    a = spark.createDataFrame([(1, 2), (5, 6), (2, 9)], "old_id long, new_id long")
    merges = spark.createDataFrame([(2, 3), (6, 5)], "old_id long, new_id long")
    assert sorted(tuple(r) for r in u.retargeted(a, merges).collect()) == [(1, 3), (2, 3), (6, 5)]


def test_late_spans_need_time(spark):
    rows = [("a", t * 60_000_000, 9.0 if t < 6 else 0.0) for t in range(8)] + [("b", t * 60_000_000, 9.0 if t % 3 else 0.0) for t in range(20)] + [("c", 0, None), (None, 5, 9.0), ("a", None, 9.0)]
    df = spark.createDataFrame(rows, "s string, us long, lag double")
    assert [tuple(r) for r in u.late_spans(df, "s", "us", "lag", 5.0, 300).collect()] == [("a", 0, 300_000_000, 9.0)]


def test_silhouette(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.0]), (3, 1, [0.0, 1.0]), (4, 1, [0.0, 5.0]), (5, 2, [1.0, 1.0]), (6, 1, [0.0, 0.0]), (7, 1, None), (8, None, [1.0, 0.0])], "id long, l int, v array<double>")
    got = {r["id"]: round(r["silhouette"], 6) for r in u.silhouette(df, "id", "l", "v").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 0.0}


def test_alias_mentions(spark):
    """As by pairs of entity and member; 3,000 entities of one name make no nine million of them."""
    import random

    from memlake.operators import upkeep

    r = random.Random(3)
    entities = [(k, r.choice("pq"), r.choice(["Oak", "oak", "elm", "ASH", None])) for k in range(40)]
    aliases = [(r.randrange(45), r.choice(["OAK", "Elm", "fir", None])) for _ in range(30)]
    seen = [(r.randrange(42), r.choice([*range(12), None])) for _ in range(90)]
    e, a = spark.createDataFrame(entities, "id long, entity_type string, name string"), spark.createDataFrame(aliases, "id long, alias string")
    m = spark.createDataFrame(seen, "entity_id long, chunk_id long")
    want = sorted(map(tuple, upkeep.group_mentions(upkeep.alias_groups(e, a), m).collect()))
    assert sorted(map(tuple, upkeep.alias_mentions(e, a, m).collect())) == want
    big = spark.range(3000).selectExpr("id", "'p' as entity_type", "'Oak' as name")
    got = upkeep.alias_mentions(big, big.selectExpr("id", "'OAK' as alias"), big.selectExpr("id as entity_id", "id % 700 as chunk_id"))
    assert [tuple(x) for x in got.groupBy("chunks").count().collect()] == [(700, 3000)]
