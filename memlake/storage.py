"""Written tables: the folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset (a
    local session, as in tests) is a temporary folder of this machine taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="memlake-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get()
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation of what
    was written, and what reads the table twice computes it once.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
