"""Readers of logs, exports, notes and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of line-wise JSON with _bad: the text of lines that are none."""
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def session_messages(lines: DataFrame) -> DataFrame:
    """session, sender, content, at of log lines (raw), where a message is a string or a list of typed parts.

    Parts of type text are joined; progress and queue lines go.
    """
    at = lambda p: F.get_json_object("raw", f"$.{p}")
    parts = F.from_json(at("message.content"), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    text = F.when(at("message.content").startswith("["), joined).otherwise(F.coalesce(at("message.content"), at("message")))
    return lines.where(at("type").isin("user", "assistant")).select(
        at("sessionId").alias("session"), at("type").alias("sender"), text.alias("content"), F.try_to_timestamp(at("timestamp")).alias("at")
    )


def system_prompts(messages: DataFrame) -> DataFrame:
    """Distinct system prompts by hash, with the number of sessions that use them."""
    prompts = messages.where("sender = 'system'").withColumn("hash", F.sha2("content", 256))
    return prompts.groupBy("hash").agg(F.min("content").alias("content"), F.countDistinct("session").alias("sessions"))


def continuations(messages: DataFrame) -> DataFrame:
    """session, first, last, files of sessions that several files hold."""
    return messages.groupBy("session").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.countDistinct("file").alias("files")).where("files > 1")


def carried(df: DataFrame, scope: str, order: str, *columns: str) -> DataFrame:
    """Nulls filled with the last value before in the scope."""
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """file, kind (by folder), title (first heading), content of Markdown files."""
    notes = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    kind = F.when(F.col("file").contains("/docs/"), "docs").when(F.col("file").rlike(r"/(plans?|adr)/"), "decision").otherwise("note")
    return notes.select("file", kind.alias("kind"), F.nullif(F.regexp_extract("value", r"(?m)^#\s+(.+)$", 1), F.lit("")).alias("title"), F.col("value").alias("content"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query, doc, grade of a JSON object {query: {doc: grade}}."""
    whole = spark.read.text(path, wholetext=True)
    outer = whole.select(F.explode(F.from_json("value", "map<string,map<string,int>>")).alias("query", "docs"))
    return outer.select("query", F.explode("docs").alias("doc", "grade"))


def queue_files(files: DataFrame, most: int) -> DataFrame:
    """Files (name, kind) to take next: all that are no enrichment, or else the first `most` of those that are."""
    urgent = files.where("kind <> 'enrichment'")
    some = files.where("kind = 'enrichment'").orderBy("name").limit(most)
    none = urgent.limit(1).agg(F.count("*").alias("n")).scalar() == 0
    return urgent.union(some.withColumn("_none", none).where("_none").drop("_none"))


def commit_files(log: DataFrame) -> DataFrame:
    """commit, file of a log with files: array<string>."""
    return log.select("commit", F.explode("files").alias("file"))


def dependencies(manifests: DataFrame) -> DataFrame:
    """project, package, version of manifests (project, json) with dependencies and devDependencies."""
    deps = F.map_concat(*(F.coalesce(F.from_json(F.get_json_object("json", f"$.{k}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for k in ("devDependencies", "dependencies")))
    return manifests.select("project", F.explode(deps).alias("package", "version"))
