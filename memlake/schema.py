"""Schemas that readers tolerate: missing columns are typed nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = T.StructType([
    T.StructField("chunk_id", T.StringType()), T.StructField("content", T.StringType()), T.StructField("source_file", T.StringType()),
    T.StructField("project", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("sender", T.StringType()),
    T.StructField("conversation_id", T.StringType()), T.StructField("position", T.LongType()), T.StructField("created_at", T.TimestampType()),
    T.StructField("importance", T.DoubleType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("content_class", T.StringType()), T.StructField("source_class", T.StringType()), T.StructField("archived_at", T.TimestampType()),
    T.StructField("superseded_by", T.StringType()), T.StructField("aggregated_into", T.StringType()), T.StructField("invalid_at", T.TimestampType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """`df` with exactly the columns of `schema`: cast where they are there, null where not."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def parsed_tags(json_text: str) -> Column:
    """A JSON array of strings as array<string>; empty where it is null or no such array."""
    return F.coalesce(F.from_json(F.col(json_text), "array<string>"), F.array().cast("array<string>"))
