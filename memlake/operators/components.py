"""Connected components by smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.storage import materialize


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable id of each vertex: (id, component_id), both long.

    `vertices` has a column id without repeats, `edges` has a and b, both
    among the ids. Each round every vertex takes the smallest label among its
    neighbours, hooks its old label's vertex to it, and follows two labels
    (pointer jumping), so the rounds grow with the logarithm of the longest
    path. Labels stay in written tables; only the number of changes comes to
    the driver. Vertices without an edge never enter the rounds.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("c")), "labels"
    )
    while True:
        # the smallest label next to each vertex
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("c").alias("n"))
        seen = labels.join(near, labels.id == near.a, "left").select("id", "c", F.least("c", "n").alias("n"))
        # a vertex's old label is a vertex too: hook it to what its members have found
        hooks = seen.where("n < c").groupBy(F.col("c").alias("h")).agg(F.min("n").alias("hook"))
        hooked = seen.join(hooks, seen.id == hooks.h, "left").select("id", "c", F.least("n", "hook").alias("n"))
        hooked = materialize(hooked, "labels")
        up = hooked.select(F.col("id").alias("u"), F.col("n").alias("up"))
        fresh = hooked.join(up, hooked.n == up.u, "left").select("id", F.col("c").alias("old"), F.least("n", "up").alias("c"))
        fresh = materialize(fresh, "labels")
        labels = fresh.select("id", "c")
        if fresh.where("old <> c").isEmpty():
            break
    return vertices.join(labels, "id", "left").select("id", F.coalesce("c", "id").alias("component_id"))
