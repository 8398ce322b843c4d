"""Sources: recognised lines, nested pages, folders, drifting copies and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_CONFIDENCE = 0.30


def normalised_lines(raw: DataFrame, scale: Column, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """Lines with text and confidence from ``least``; polygon (array of x, y) as box, unscaled."""
    kept = raw.filter((F.trim("text") != "") & (F.col("confidence") >= least))
    xs, ys = F.transform("polygon", lambda p: p[0] / scale), F.transform("polygon", lambda p: p[1] / scale)
    x, y = F.array_min(xs), F.array_min(ys)
    box = F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h"))
    return kept.withColumns({"bbox": box, "confidence": F.round("confidence", 4), "text": F.trim("text")}).drop("polygon")


def nested_pages(records: DataFrame, page: str, order: str, fields: list[str]) -> DataFrame:
    """A row for each page with its records as an array in order."""
    return records.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order]))).alias("records"))


def flat_records(pages: DataFrame, page: str) -> DataFrame:
    return pages.select(page, F.posexplode("records").alias("pos", "r")).select(page, "pos", "r.*")


def folder_listing(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Path, name and size of the files of a folder and its subfolders; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"))


def matched_files(listing: DataFrame, registered: DataFrame) -> DataFrame:
    """Listed files with the registered file of the same path, else of the same name."""
    by_path = registered.select(F.col("stored_path").alias("path"), F.col("file_id").alias("_p"))
    by_name = registered.groupBy("name").agg(F.min("file_id").alias("_n"))
    out = listing.join(by_path, "path", "left").join(by_name, "name", "left")
    return out.select("path", "name", "size_bytes", F.coalesce("_p", "_n").alias("file_id"))


def unregistered(listing: DataFrame, registered: DataFrame) -> DataFrame:
    return listing.join(registered.select(F.col("stored_path").alias("path")), "path", "left_anti")


def scanned_files(listing: DataFrame, registered: DataFrame, counts: DataFrame) -> DataFrame:
    """Listed files with what is known of them: id by path, else by name, status, number of records
    and recognition seconds; ``new`` without an id. ``counts``: file_id, records, ocr_s."""
    known = matched_files(listing, registered).join(registered.select("file_id", "status"), "file_id", "left").join(counts, "file_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "ocr_s")]
    return known.select("path", "name", "size_bytes", "file_id", F.coalesce("status", F.lit("new")).alias("status"), *zero)


def imported(listing: DataFrame, registered: DataFrame) -> DataFrame:
    """Files of a folder after import: those registered by path with their id, the others with a new
    one made of the path; ``is_new`` tells them apart."""
    ids = registered.select(F.col("stored_path").alias("path"), "file_id")
    old = listing.join(ids, "path").select("path", "name", "file_id", F.lit(False).alias("is_new"))
    new = unregistered(listing, registered).select("path", "name", F.concat(F.lit("F"), F.substring(F.md5(F.col("path").cast("binary")), 1, 12)).alias("file_id"), F.lit(True).alias("is_new"))
    return old.unionByName(new)


def copied(source: DataFrame, target: DataFrame, defaults: dict) -> DataFrame:
    """Source rows in the target's columns: unknown columns dropped, missing ones by default."""
    kept = source.select(*[c for c in source.columns if c in target.columns])
    return target.limit(0).unionByName(kept, allowMissingColumns=True).fillna(defaults).select(target.columns)


def catalog_columns(spark: SparkSession, names: list[str]) -> DataFrame:
    """Columns of temporary views or tables: name, position, type."""
    rows = [(n, i, c.name, c.dataType) for n in names for i, c in enumerate(spark.catalog.listColumns(n))]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")
