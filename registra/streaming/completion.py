"""Jobs that start when a file's last page is in.

The stream of page results is keyed by file. The state of a file is a bitmap of its pages, given up for a
mark once all are in; a file is emitted at that moment and never again, however often its pages
are delivered. Each micro-batch hands the files that it completed to the batch jobs and writes
the result to a folder of its own, which a repeated batch replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from registra.operators.storage import new_path

STATE = "seen binary, left int"


def _arrived(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, left = state.get if state.exists else (None, None)
    if state.exists and left == 0:
        return
    for rows in batches:
        n = int(rows["page_count"].iloc[0])
        bits = np.zeros(n, bool) if seen is None else np.unpackbits(np.frombuffer(seen, np.uint8), count=n).astype(bool)
        place = rows["place"].to_numpy()
        bits[place[(place >= 0) & (place < n)]] = True
        seen, left = np.packbits(bits).tobytes(), int(n - bits.sum())
    if left == 0:
        yield pd.DataFrame({"file_id": [key[0]], "pages_in": [n]})
    state.update((b"" if left == 0 else seen, left))


def completed_files(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Files of a stream of pages, each once, as soon as all their pages are in: file_id, pages_in.

    pages: file_id, place (the page's number from 0 on); files: file_id, page_count (at least 1), a static table.
    Pages beyond the count and files that are not listed play no part.
    """
    known = pages.select("file_id", F.col("place").cast("int").alias("place")).join(files.filter("page_count > 0").select("file_id", F.col("page_count").cast("int").alias("page_count")), "file_id")
    return known.groupBy("file_id").applyInPandasWithState(_arrived, "file_id string, pages_in long", STATE, "append", GroupStateTimeout.NoTimeout)


def run_on_completion(spark: SparkSession, folder: str, schema: T.StructType, files: DataFrame, job: Callable[[DataFrame], DataFrame], name: str, files_a_batch: int = 1, state: str | None = None, out: str | None = None) -> DataFrame:
    """Follow the Parquet files of a folder until they are used up and run ``job`` on the files that each
    batch completes (a table of file_id and pages_in). Returns all results; ``batch`` tells the batch.

    ``state`` and ``out``: folders of an earlier run to go on from.
    """
    out, state = out or new_path(spark, name), state or new_path(spark, f"{name}-state")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)

    def on_batch(done: DataFrame, number: int) -> None:
        ids = done.persist()
        if ids.limit(1).count():
            job(ids).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/n={number}")
        ids.unpersist()

    query = completed_files(stream, files).writeStream.outputMode("append").foreachBatch(on_batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(out)
