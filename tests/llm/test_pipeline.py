"""The pipeline's stages: what each must keep, drop and change."""

import math
import random
import re

import corpus_pipeline
from conftest_llm import words
from pyspark.sql import functions as F


def corpus(spark, tmp):
    rng = random.Random(4)
    clean = [" ".join(words(rng, 150, 5000)) for _ in range(30)]
    near = [" ".join(t.split()[:-1]) for t in clean[:5]]
    passage = " ".join(words(rng, 60, 50_000))
    shared = [f"{t}\n{passage} end{k}" for k, t in enumerate(" ".join(words(rng, 120, 50_000)) for _ in range(4))]
    secret = [" ".join(words(rng, 100, 50_000)) + " password=hunter22hunter and more"]
    junk = ["too few words", "buy now cheap offer today " * 40, "", None]
    texts = clean + near + shared + secret + junk
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    return texts, passage


def test_stages(spark, tmp_path):
    texts, passage = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality rules", "n-gram Jaccard join", "substring dedup", "secret scans", "best-fit packing")
    seen = [docs]
    for k, stage in enumerate(stages):
        out = stage(spark, seen[-1], str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/stage{k}"))
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] - ids[1] == {40, 41, 42, 43}
    assert ids[1] - ids[2] == {30, 31, 32, 33, 34}
    assert ids[2] == ids[3] == ids[4] == ids[5]
    cut = {r["doc_id"]: r["text"] for r in seen[3].collect()}
    assert passage in cut[35] and all(passage not in cut[k] and f"end{k - 35}" in cut[k] for k in (36, 37, 38))
    assert all(cut[k] == texts[k] for k in range(30))
    masked = {r["doc_id"]: r for r in seen[4].collect()}
    assert "hunter22" not in masked[39]["text"] and "[SECRET]" in masked[39]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in masked.values())
    packed = seen[5].agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert packed["s"] <= math.ceil(packed["n"] / 2048) + 1
    whole = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in seen[5].collect()}
    assert re.search("password", texts[39])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def table(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def test_near_duplicates_by_row(spark, tmp_path):
    rng = random.Random(9)
    a, b, c = (" ".join(words(rng, 80, 50_000)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (3, b + " x"), (4, c), (4, c), (None, c), (None, "only here " + " ".join(words(rng, 30, 50_000))), (5, ""), (5, ""), (6, None)]
    out = sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), "").collect()), key=repr)
    assert out == sorted([(1, a), (2, b), (4, c), rows[7], (5, ""), (5, ""), (6, None)], key=repr)


def test_columns_of_the_caller_pass(spark, tmp_path):
    """Every stage but the last leaves columns alone whose names the operators use, in any place."""
    rng = random.Random(10)
    named = ["spans", "base", "kept", "score", "n_words", "factors", "n_removed", "toxic_score", "_h", "_id", "a.b", "class", "token"]
    long = " ".join(words(rng, 20_000, 50_000)) + " password=abcdef12 " * 200
    texts = [" ".join(words(rng, 120, 5000)) for _ in range(8)] + [long]
    rows = [(f"mine{k}", *[f"{n}{k}" for n in named], k, t, 7) for k, t in enumerate(texts)]
    docs = table(spark, rows, "lang string, " + ", ".join(f"`{n}` string" for n in named) + ", doc_id long, text string, n_chars int")
    labels = table(spark, [(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        got = {r[-3]: tuple(r) for r in out.collect()}
        assert len(got) >= 8  # the long text has little of good documents
        assert all(got[k][: len(named) + 1] == rows[k][: len(named) + 1] for k in got)
    assert "password=" not in got[8][-2] and got[8][-2].count("[SECRET]") == 200
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == set(range(9))


def test_null_ids_and_repeats_pass(spark, tmp_path):
    rng = random.Random(11)
    a, b = (" ".join(words(rng, 100, 50_000)) for _ in range(2))
    docs = table(spark, [(None, a), (None, a), (1, b), (1, b)])
    table(spark, [(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.cut_repeated_passages, corpus_pipeline.mask_secrets):
        assert sorted(map(repr, stage(spark, docs, str(tmp_path)).collect())) == sorted(map(repr, docs.collect()))
    assert corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path)).count() in (0, 2, 4)
