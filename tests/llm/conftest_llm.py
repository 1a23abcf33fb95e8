import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("score", T.StringType()), T.StructField("shard", T.StringType()),
])


def words(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n)]


def texts():
    """Texts with copies, near copies, shared passages, few words, none, null, white space and one long text."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(1, 160)) for _ in range(40)]
    passage = words(rng, 60, 10_000)
    out = [" ".join(w) for w in base]
    out += [" ".join(w) for w in base[:8]]
    for w in base[8:20]:
        near = list(w)
        near[rng.randrange(len(near))] = "changed"
        out.append(" ".join(near))
    out += [" ".join(w[:10] + passage[k : k + 40] + w[10:]) for k, w in enumerate(base[20:30])]
    out += ["", None, " \n\t ", "one", "one two", "One TWO", "Repeat the line again and again now " * 12, " ".join(words(rng, 6000, 3000)), "ünï çödé x 日本語 İstanbul don't #1"]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """Rows as above in shuffled order; one row comes twice, and columns clash with what operators make."""
    rows = [(k, t, ("en", "de", None)[k % 3], "src0", len(t or ""), "a", "b", "c") for k, t in enumerate(texts())]
    rows += [rows[3], (None, "row without an id " * 4, None, None, None, None, None, None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 4 > 0), 0 if k % 5 else None) for k in range(40)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")


def given(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]
