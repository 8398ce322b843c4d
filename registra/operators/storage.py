"""Tables between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one where none is set, in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: written tables need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="registra-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{working_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, large: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage; ``dropped`` deletes it.

    ``large``: the table grows with the input and is joined by sorted rows, as its file, by which Spark would
    broadcast it, may be a small part of what its rows take in memory.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if large:
        out = out.hint("merge")
    out.scratch = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the folders of stored tables that nothing reads any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(conf).delete(path, True)
