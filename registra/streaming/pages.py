"""Structured Streaming over page results: progress, idempotent sink, completion, suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from registra.operators.storage import new_path


def progress(pages: DataFrame) -> DataFrame:
    """Per job and file: pages completed, failed and in all, records, first and last time.

    Works on a stream and on a batch.
    """
    return pages.groupBy("job_id", "file_id").agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count(F.lit(1)).alias("total"),
        F.sum("records").alias("records"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def rate(counts: DataFrame, page_count: str) -> DataFrame:
    """Pages a second and seconds left of each file."""
    spent = F.col("last_ts").cast("double") - F.col("first_ts").cast("double")
    speed = F.when(spent > 0, F.col("total") / spent)
    return counts.withColumns({"pages_per_s": speed, "eta_s": F.when(speed > 0, F.greatest(F.col(page_count) - F.col("total"), F.lit(0)) / speed)})


def without_repeats(pages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (file, page) once; the watermark bounds what is remembered."""
    return pages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["file_id", "page_number"])


def files_with_all_pages(counts: DataFrame, files: DataFrame) -> DataFrame:
    """Files of which all pages are in, in a table of counts; ``completion`` follows a stream."""
    done = counts.groupBy("file_id").agg(F.sum("total").alias("pages_in"))
    return done.join(files, "file_id").filter(F.col("pages_in") >= F.col("page_count")).select("file_id", "pages_in")


def page_sink(path: str):
    """``foreachBatch`` function: newest row of each (file, page), re-delivery changes nothing.

    Each batch is a folder of its own, replaced if the batch comes again; readers take the newest
    row of a key over all batches (``latest_pages``).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_pages(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("file_id", "page_number").agg(F.max(F.struct("ts", "batch", "status", "records")).alias("x"))
    return best.select("file_id", "page_number", "x.status", "x.records", "x.ts")


def run_available(spark: SparkSession, folder: str, schema: T.StructType, build, name: str, mode: str = "update", files_a_batch: int = 1) -> DataFrame:
    """Run ``build`` over the Parquet files of a folder as a stream until they are used up; the
    batches land in a table of their own, which is returned."""
    out = new_path(spark, name)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/n={number}")

    query = build(stream).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", new_path(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("n")


def snapshot_then_changes(snapshot: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Events for a reader that joins late: the stored counts first, then each later batch, up to
    and with the one in which the job is done (column ``done``)."""
    first = snapshot.withColumns({"batch": F.lit(-1).cast("long"), "event": F.lit("snapshot")})
    later = changes.withColumn("event", F.when(F.col("done"), "job_done").otherwise("progress"))
    end = changes.filter("done").groupBy(key).agg(F.min("batch").alias("_end"))
    later = later.join(end, key, "left").filter("_end is null or batch <= _end").drop("_end")
    return first.unionByName(later, allowMissingColumns=True)
