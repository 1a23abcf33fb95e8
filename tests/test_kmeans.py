"""K-means and its sample against the same steps on one machine."""

import numpy as np

from memlake.operators import kmeans


def test_sample(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((3, 5))[rng.integers(3, size=200)] * 4 + rng.standard_normal((200, 5)), np.ones((80, 5))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(None, [1.0] * 5), (900, None), (901, [1.0, 2.0]), (902, [None] * 5), (903, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    order = [r["k"] for r in spark.range(280).selectExpr("id as k", f"xxhash64({kmeans.SEED}, id) as h").orderBy("h", "k").collect()]
    centres = x[order[:6]]
    for _ in range(kmeans.ROUNDS):
        own, _ = kmeans._nearest(x, centres)
        centres = np.array([np.round(x[own == c].sum(axis=0) / (own == c).sum(), 9) if (own == c).any() else centres[c] for c in range(6)])
    own, d = kmeans._nearest(x, centres)
    want = {(int(i), c, n + 1) for c in range(6) for n, i in enumerate(sorted(np.flatnonzero(own == c), key=lambda i: (d[i], i))[:3])}
    got = kmeans.sampled(df, "id", "v", 6)
    assert {(r["id"], r["centre"], r["rank"]) for r in got.collect()} == want
    assert kmeans.sampled(df.where("id < 0"), "id", "v", 6).count() == 0
    assert {r["id"] for r in kmeans.sampled(df.where("id < 2"), "id", "v", 6).collect()} == {0, 1}
