"""Ingest of append-only files: a file source, validation and quarantine, idempotent micro-batches.

The checkpoint of a stream is its registry of offsets: a file counts as read
when its batch is committed. Each batch writes under its own number, so that a
batch that runs again replaces what it wrote before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or temporary where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="memlake-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def jsonl_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Complete lines of the files of a folder: the schema's columns, _raw, and _bad for lines that are no such record."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).withColumnRenamed("value", "_raw")
    record = F.from_json("_raw", schema)
    return lines.withColumn("_r", record).select("_raw", F.col("_r").isNull().alias("_bad"), "_r.*")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last state of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*(c for c in df.columns if c != key)), order).alias("_s")).select(key, "_s.*")


def write_batches(stream: DataFrame, out: str, quarantine: str, bad: Column, checkpoint: str) -> None:
    """Run the stream to its end; each batch replaces its own part of `out` and, for bad rows, of `quarantine`."""

    def put(batch: DataFrame, number: int) -> None:
        batch.where(~bad).write.mode("overwrite").parquet(f"{out}/batch={number}")
        batch.where(bad).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingested(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table's file streamed into a folder of batches, each key once, and read back."""
    source = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(source).schema
    root = work_folder(spark, "stream")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(source if _is_folder(spark, source) else f"{folder}/{name}.parquet*")
    write_batches(stream, f"{root}/out", f"{root}/bad", F.col(key).isNull(), f"{root}/checkpoint")
    rows = spark.read.option("basePath", f"{root}/out").schema(schema.add("batch", T.IntegerType())).parquet(f"{root}/out")
    return latest(rows, key, "batch").select(*schema.names[:-1])


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def unread(messages: DataFrame, acks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages over each subscriber's acknowledged floor with a tag that it wants.

    messages: seq, tag; acks: agent, seq; subscriptions: agent, tag.
    """
    floor = acks.groupBy("agent").agg(F.max("seq").alias("floor"))
    wanted = subscriptions.join(floor, "agent", "left")
    return messages.join(wanted, "tag").where(F.col("seq") > F.coalesce("floor", F.lit(-1))).select("agent", "seq", "tag")


def liveness(events: DataFrame, at: str, width: str, late: str = "1 hour") -> DataFrame:
    """Events in tumbling windows; what comes later than `late` is not waited for."""
    return events.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count("*").alias("n"))
