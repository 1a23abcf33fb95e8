"""Names in texts: the longest spans of words that are a name, from left to right, none over another.

A text is only cut into runs of words that can be a name: a bitmap of hashes,
of bounded size, says which first words have names of which lengths and which
runs can be names, so that hardly more than the names in the texts is exchanged
for the join with the names, which decides. What is left for a text are the
places of its names, which one pass goes through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.storage import materialize

#: What a word is; bits of the bitmap for each name, and its longs at most (8 MB): with more names it lets more runs through, the join decides.
WORD, BITS, LONGS = r"[\p{L}\p{N}_'-]+", 64, 1 << 20


def words_of(text: Column, word: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(word), F.lit(0))


def name_table(names: DataFrame, key: str, name: str, kind: str | None = None, single: tuple[str, ...] = (), word: str = WORD) -> DataFrame:
    """phrase, first, n, ids (array, ascending) of the names; those of one word whose kind is among `single`, as it says too little alone, are left out."""
    rows = names.select(key, words_of(F.col(name), word).alias("_w"), *([kind] if kind else [])).where("size(_w) > 0")
    if kind and single:
        rows = rows.where((F.size("_w") > 1) | F.coalesce(~F.col(kind).isin(*single), F.lit(True)))
    rows = rows.select(key, F.array_join("_w", " ").alias("phrase"), F.col("_w")[0].alias("first"), F.size("_w").alias("n"))
    return rows.groupBy("phrase", "first", "n").agg(F.array_sort(F.collect_set(key)).alias("ids"))


def _bitmap(names: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """A row with the bits of names' phrases and of their first words with lengths, and the test of a hash against it."""
    longs = min(LONGS, 1 << max(4, (names.count() * BITS // 64).bit_length()))
    place = lambda h: F.shiftright(h, 6).bitwiseAND(F.lit(longs - 1)).cast("int")
    bit = lambda h: h.bitwiseAND(F.lit(63)).cast("int")
    hashes = names.select(F.explode(F.array(F.xxhash64("phrase"), F.xxhash64("first", "n"))).alias("h"))
    held = hashes.groupBy(place(F.col("h")).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toArrow()
    bits = np.zeros(longs, np.int64)
    bits[held["at"].to_numpy()] = held["b"].to_numpy()
    row = names.sparkSession.createDataFrame(pa.table({"_bits": pa.array([bits])}))
    return F.broadcast(row), lambda h: F.call_function("shiftright", F.col("_bits")[place(h)], bit(h)).bitwiseAND(F.lit(1)) == 1


def _chosen(once: bool, owner: pa.DataType, kind: pa.DataType):
    """Goes through places in order (owner, at, longest first), a batch at a time; only the owner at hand is held from one batch to the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end, seen = object(), 0, set()
        for batch in batches:
            own, at, n, ids = (batch.column(c).to_pylist() for c in range(4))
            rows, found = [], []
            for k, (o, place, length, these) in enumerate(zip(own, at, n, ids, strict=True)):
                if o != now:
                    now, end, seen = o, 0, set()
                if place >= end:
                    free = next((i for i in these if i not in seen), None) if once else these[0]
                    if free is not None:
                        end = place + length
                        if once:
                            seen.add(free)
                        rows.append(k)
                        found.append(free)
            kept = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(kept) for c in range(3)), pa.array(found, kind)], names=["owner", "at", "n", "id"])

    return run


def name_spans(texts: DataFrame, owner: str, text: str, names: DataFrame, once: bool = False, word: str = WORD) -> DataFrame:
    """owner, at (word, from 0), n (words), id: the names (see `name_table`) in each text.

    At each word the longest name that begins there and does not begin within
    the one before; of several names that read alike the smallest id. With
    `once` an id is found once in a text, and where it comes again its words are
    free for shorter names. Texts that are null or have no words have none; rows
    that share an owner should not, as their places would be one list.
    """
    names = materialize(names, "names")
    lengths = [r["n"] for r in names.select("n").distinct().orderBy("n").collect()]
    bits, known = _bitmap(names)
    words = texts.select(F.col(owner).alias("owner"), words_of(F.col(text), word).alias("_w"))
    # each place with as many words as the longest name has: a text's words are never copied whole to each of its places
    place = lambda i: F.struct(i.alias("at"), F.slice("_w", i + 1, F.lit(max(lengths, default=1))).alias("w"))
    placed = words.where("size(_w) > 0").select("owner", F.explode(F.transform(F.sequence(F.lit(0), F.size("_w") - 1), place)).alias("_p"))
    n = F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("_n")
    placed = placed.select("owner", F.col("_p.at").cast("long").alias("at"), F.col("_p.w").alias("_w"), n).where("_n <= size(_w)")
    begun = placed.withColumn("_h", F.xxhash64(F.col("_w")[0], "_n")).join(bits, known(F.col("_h"))).select("owner", "at", F.array_join(F.slice("_w", 1, F.col("_n")), " ").alias("phrase"))
    runs = begun.withColumn("_h", F.xxhash64("phrase")).join(bits, known(F.col("_h"))).select("owner", "at", "phrase")
    held = F.col("ids") if once else F.slice("ids", 1, 1).alias("ids")
    hits = runs.join(names.select("phrase", F.col("n").cast("long").alias("n"), held), "phrase").select("owner", "at", "n", "ids")
    kinds = [hits.schema[c].dataType for c in ("owner", "ids")]
    from pyspark.sql.pandas.types import to_arrow_type

    chosen = _chosen(once, to_arrow_type(kinds[0]), to_arrow_type(kinds[1].elementType))
    ordered = hits.repartition("owner").sortWithinPartitions("owner", "at", F.desc("n"))
    return ordered.mapInArrow(chosen, f"owner {kinds[0].simpleString()}, at long, n long, id {kinds[1].elementType.simpleString()}")
