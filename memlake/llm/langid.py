"""Language identification by rank-order profiles of character n-grams.

N-grams are runs of one to three letters of a word, lower-cased, with an edge
mark on either side of the word. A task turns a text into numbers, one for each
n-gram (21 bits a character), and counts them by sorting.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import slices

#: N-grams in a profile, parts that a language's n-grams are ranked in before they meet, and n-grams of texts counted at a time.
PROFILE, PARTS, BLOCK = 400, 64, 1 << 22
EDGE = ord("_")


@cache
def _tables() -> np.ndarray:
    """For each character of the basic plane its lower-case letter, or the edge mark if it is no letter."""
    return np.array([_letter(k) for k in range(1 << 16)], dtype=np.int64)


def _letter(k: int) -> int:
    c = chr(k)
    low = c.lower() if c.isalpha() else "_"
    return ord(low) if len(low) == 1 else k


def grams(text: str) -> np.ndarray:
    """The n-grams of a text as numbers, in no order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    high = codes >= 1 << 16
    letters = _tables()[np.where(high, 0, codes)]
    if high.any():
        found, back = np.unique(codes[high], return_inverse=True)
        letters[high] = np.array([_letter(int(k)) for k in found], dtype=np.int64)[back]
    x = np.concatenate([[EDGE], letters, [EDGE]])
    edge = x == EDGE
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = ~(edge[1:] & edge[:-1])  # one mark between words
    x, edge = x[keep], edge[keep]
    if len(x) < 3:
        return np.zeros(0, np.int64)
    two = x[:-1] << 21 | x[1:]
    return np.concatenate([x[~edge], two, (two[:-1] << 21 | x[2:])[~edge[1:-1]]])


def shown(gram: int) -> str:
    return "".join(chr(c) for k in (42, 21, 0) if (c := gram >> k & (1 << 21) - 1))


def counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.sort(found)
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, int)
    return found[first], np.diff(np.append(first, len(found)))


def learn_profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram (long; see `shown`), n, rank (int, from 0): the most frequent n-grams of each language, counted over all rows with a lang.

    Ties go to the smaller number. Rows with a null text or lang give nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                found, times = counted(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(times, pa.int64())], names=["lang", "gram", "n"])

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(grams(text))
                n += len(held[lang][-1])
                if n >= BLOCK:
                    yield from out()
                    held, n = {}, 0
        yield from out()

    counts = docs.where("lang is not null and text is not null").select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # first within parts of a language, then among their best
    best = Window.partitionBy("lang", "_part").orderBy(F.desc("n"), "gram")
    counts = counts.withColumn("_part", F.pmod(F.xxhash64("gram"), F.lit(PARTS))).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= size)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("rank", rank).where(F.col("rank") < size).select("lang", "gram", "n", "rank")


def predict(docs: DataFrame, profiles: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of each row.

    A text's most frequent n-grams are ranked like a profile's; each adds its
    distance from its place in the profile, or `size` if it is not there. The
    least sum wins, ties go to the smaller name; score is 1 less the share of
    the largest possible sum. A null text, one without letters, and any text
    if there are no profiles: `und`, 0. Repeated rows are each predicted.
    """
    rows = profiles.select("lang", "gram", "rank").collect()  # `size` rows for each language
    langs = sorted({r["lang"] for r in rows})
    known = np.array(sorted({r["gram"] for r in rows}), dtype=np.int64)
    index, column = {int(g): k for k, g in enumerate(known)}, {x: k for k, x in enumerate(langs)}
    places = np.full((len(known) + 1, len(langs)), 1 << 30, dtype=np.int64)  # the last row: of n-grams in no profile
    for r in rows:
        places[index[r["gram"]], column[r["lang"]]] = r["rank"]

    def one(text: str) -> tuple[str, float]:
        found, times = counted(grams(text))
        if not len(found) or not langs:
            return "und", 0.0
        if len(found) > size:
            least = np.partition(times, len(times) - size)[len(times) - size]
            found, times = found[times >= least], times[times >= least]
        top = found[np.lexsort((found, -times))[:size]]
        at = np.minimum(np.searchsorted(known, top), len(known) - 1)
        at = np.where(known[at] == top, at, len(known))
        apart = np.minimum(np.abs(places[at] - np.arange(len(top))[:, None]), size).sum(axis=0)
        best = int(np.argmin(apart))
        return langs[best], float(1 - apart[best] / (size * len(top)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [one(text or "") for text in batch.column(1).to_pylist()]
            columns = [batch.column(0).cast(pa.int64()), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
