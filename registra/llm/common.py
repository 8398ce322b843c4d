"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, as in tests, a temporary folder is made and set where none is named; on a
    cluster that is an error, as executors would not see each other's files.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="registra-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage in a form that survives a lost executor. ``release`` deletes the folder.
    """
    path = f"{shared_dir(df.sparkSession)}/registra-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the folders of materialized tables that nothing will read again."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(conf).delete(path, True)


def hinted(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows; else left to Spark."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def is_small(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def hex_long(digest: Column, start: int, digits: int) -> Column:
    """Bits of a hex digest as a long (at most 15 digits)."""
    return F.conv(F.substring(digest, start, digits), 16, 10).cast("long")


def key128(*values: Column) -> Column:
    """16 bytes of two hashes of the values under different seeds."""
    two = [F.xxhash64(F.lit(seed), *values) for seed in (1, 2)]
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in two]))


def row_key(id_col: str, text_col: str) -> Column:
    """Key of a document row; rows with equal id and text share it, and share every result."""
    return key128(F.col(id_col), F.col(text_col))


def text_key(text_col: str) -> Column:
    """Key of a text; a null text counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def finite_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>, dim) of the rows whose vector is not null or empty and all finite."""
    v = F.col(vector_col).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & ~odd & (F.size("v") > 0)).withColumn("dim", F.size("v"))
