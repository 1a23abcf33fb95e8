"""The corpus pipeline: its stages in order, each over all that the one before kept.

quality rules reject documents; of each group of near-duplicates one document
stays; passages that stand earlier elsewhere are cut out; secrets are masked;
what is left is packed into training sequences. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import jaccard, packing, quality, secrets, substrings
from memlake.llm.common import materialize

#: Words of a shingle and similarity in percent of near-duplicates; words of a passage that may stand once.
SHINGLE, PERCENT, PASSAGE = 5, 80, 50


def _plain(docs: DataFrame) -> DataFrame:
    """`docs` with its columns besides doc_id and text under names that no operator makes or reads."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"_own_{k}" for k, c in enumerate(docs.columns)))


def _as(docs: DataFrame, made: DataFrame) -> DataFrame:
    """What an operator has made of `_plain(docs)`, with the columns of `docs`."""
    return made.select(*_plain(docs).columns).toDF(*docs.columns)


def _with_text(docs: DataFrame, made: DataFrame) -> DataFrame:
    """As `_as`, where n_chars, if there is one, says how long the text is now."""
    out = _as(docs, made)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Each row is judged by its text: rows that repeat are kept or go together,
    rows without doc_id are judged like others, null and empty texts go. Columns
    besides doc_id and text pass as they are, whatever their names; an empty
    table gives an empty one.
    """
    judged = quality.with_quality(_plain(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # a row goes on as often as its verdict says; unlike a filter, this is not moved below and judged twice
    return _as(docs, judged.withColumn("_once", F.explode(F.expr("if(kept, array(1), cast(array() as array<int>))"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id (of several such, the smallest hash of doc_id and text).

    Rows are told apart by doc_id and text, so a doc_id that comes with several
    texts loses those only that stand elsewhere. Of rows equal in both one
    stays, whatever their other columns hold. Rows without doc_id are near-duplicates like
    others and stay only where no row of their group has one. Texts without words
    are like no other and all stay. Other columns pass as they are; an empty
    table gives an empty one.
    """
    plain = _plain(docs)
    keyed = plain.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = jaccard.jaccard_components(keyed.select(F.col("_row").alias("doc_id"), "text"), SHINGLE, PERCENT)
    groups = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_row")).agg(F.min("component_id").alias("_c"), F.count("*").alias("_n"))
    groups = materialize(groups, "groups")
    large = groups.groupBy("_c").agg(F.count("*").alias("_m")).where("_m > 1").select("_c")
    members = groups.join(large, "_c", "left_semi").join(keyed.select("_row", "doc_id"), "_row")
    first = members.groupBy("_c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    gone = materialize(groups.join(first, "_c").where("_row <> first._row").select("_row"), "gone")
    again = groups.where("_n > 1").join(gone, "_row", "left_anti").select("_row")
    again = materialize(again, "again")
    once = keyed.join(again, "_row", "left_semi").groupBy("_row").agg(F.first(F.struct(*plain.columns)).alias("_w")).select("_w.*")
    return _as(docs, keyed.join(gone.union(again), "_row", "left_anti").select(*plain.columns).union(once))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier; rows of which nothing is left go.

    Rows that share a doc_id are positions of one document; those without one
    pass as they are, and so do texts without words. Columns besides doc_id,
    text and n_chars pass as they are; an empty table gives an empty one.
    """
    found = substrings.dedup_substrings(_plain(docs), PASSAGE)
    return _with_text(docs, found.where("n_removed = 0 or n_removed < n_words"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in the place of each secret.

    Each row is masked by itself, with or without doc_id, repeated or not; null
    and empty texts stay. Columns besides text and n_chars pass as they are; an
    empty table gives an empty one.
    """
    return _with_text(docs, secrets.redacted(secrets.with_secrets(_plain(docs))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in the training sequences; rows that repeat, or have no doc_id, are packed each. Other columns are not read."""
    return packing.packed(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: Packing, entropy and hashed n-gram ratios have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
