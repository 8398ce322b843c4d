"""What is done with a file once all its pages are read: spellings, sections, promotion.

The steps are those of the batch jobs, with the file as their scope, for any number of files at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.functions import text as X
from registra.operators import jobs, promotion
from registra.operators.storage import stored


def finished_records(records: DataFrame, vowels: str, short: str, long: str) -> DataFrame:
    """Records with the name that their file's spelling vote leaves them and the section they belong to.

    records: file_id, page_number, name, section_name, confidence and more, which stays.
    """
    skeleton = lambda c: X.skeleton(F.col(c), f"[{vowels}]")
    words = records.filter(F.trim("name") != "").select("file_id", F.trim("name").alias("word"), F.col("confidence").alias("conf"))
    winners = jobs.consensus(words, "file_id", "word", skeleton("word"), "conf", short, long)
    fields = records.withColumnRenamed("name", "original_value").withColumn("edited_value", F.lit(None).cast("string"))
    voted = jobs.harmonised(fields, winners, "file_id", skeleton("_v"))
    voted = voted.withColumn("name", F.coalesce("edited_value", "original_value")).drop("edited_value", "suggested_value", "original_value")
    placed = jobs.reconcile_sections(voted, "file_id", "page_number", "section_name", X.section_number(F.col("section_name")))
    return placed.withColumn("section_name", F.col("reconciled")).drop("reconciled", "carried")


def run_file_jobs(records: DataFrame, pages: DataFrame, files: DataFrame, stations: DataFrame, current: DataFrame, vowels: str, short: str, long: str) -> dict[str, DataFrame]:
    """All jobs over whole files; returns what ``promotion.promotion`` does."""
    finished = stored(finished_records(records, vowels, short, long), "finished")
    return promotion.promotion(promotion.placed(finished, pages, files, stations), current)
