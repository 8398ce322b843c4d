"""Sinks: flat exports as CSV, JSON, text, Markdown and XML, and the relational export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions.similarity import one_decimal

BOM = "﻿"


def issue_text(issues: Column) -> Column:
    """``message; field: message`` of an array of issues."""
    return F.array_join(F.transform(issues, lambda i: F.concat(F.when(i["field"].isNotNull(), F.concat(i["field"], F.lit(": "))).otherwise(""), i["message"])), "; ")


def export_table(records: DataFrame, fields: list[str], mode: str = "all") -> DataFrame:
    """Flat table of a map column ``fields``; ``clean`` keeps rows without errors, ``audit`` adds
    each field's original value and confidence."""
    if mode not in ("all", "clean", "audit"):
        raise ValueError(mode)
    rows = records.filter("error_count = 0") if mode == "clean" else records
    columns: list[Column] = []
    for f in fields:
        x = F.col("fields")[f]
        columns.append(F.coalesce(x["edited_value"], x["original_value"]).alias(f))
        if mode == "audit":
            columns += [x["original_value"].alias(f"{f}_ocr"), F.round(x["confidence"], 4).alias(f"{f}_confidence")]
    others = [c for c in records.columns if c != "fields"]
    return rows.select(*others, *columns)


def shown(rows: DataFrame) -> DataFrame:
    """All columns as text: booleans as Yes and No, timestamps to the minute, null as ''."""

    def text(c: str, kind: str) -> Column:
        x = F.col(c)
        if kind == "boolean":
            x = F.when(x, "Yes").otherwise("No")
        elif kind == "timestamp":
            x = F.date_format(x, "yyyy-MM-dd HH:mm")
        return F.coalesce(x.cast("string"), F.lit("")).alias(c)

    return rows.select(*[text(c, k) for c, k in rows.dtypes])


def write_csv(rows: DataFrame, path: str, bom: bool = False) -> None:
    if bom and rows.columns:
        rows = rows.withColumnRenamed(rows.columns[0], BOM + rows.columns[0])
    rows.write.option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def envelope(rows: DataFrame, title: str) -> DataFrame:
    """The one-row metadata table that goes with a JSON export."""
    return rows.agg(F.count(F.lit(1)).alias("total_records")).select(F.lit(title).alias("title"), "total_records")


def text_lines(rows: DataFrame, page: str, order: str, fields: list[str]) -> DataFrame:
    """``k: v | k: v`` lines with a separator before each page, in order (columns page, place, value)."""
    body = F.concat_ws(" | ", *[F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])
    lines = rows.select(page, F.col(order).cast("long").alias("place"), body.alias("value"))
    heads = rows.select(page).distinct().select(page, F.lit(-1).cast("long").alias("place"), F.concat(F.lit("--- page "), F.col(page).cast("string")).alias("value"))
    return heads.unionByName(lines)


def markdown_lines(rows: DataFrame) -> DataFrame:
    """Rows as lines of a Markdown table, without its two head lines."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|") for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_head(columns: list[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]


def write_xml(rows: DataFrame, path: str, root: str = "ElectoralRoll", row: str = "VoterRecord") -> None:
    rows.write.format("xml").option("rootTag", root).option("rowTag", row).save(path)


def digits_or_null(c: Column) -> Column:
    return F.when(c.cast("string").rlike("^[0-9]+$"), c.cast("string")).try_cast("long")


def relational_tables(stations: DataFrame, records: DataFrame, electors: DataFrame) -> dict[str, DataFrame]:
    """The four tables of the relational export; text becomes a number only if it is all digits."""
    documents = stations.select(
        F.col("file_id").alias("Document_ID"), F.col("district").alias("District"), F.col("ac_name").alias("Assembly"), F.col("part_number").alias("Part"), F.col("name").alias("Polling_Station"), F.col("revision").alias("Revision")
    )
    pages = records.groupBy(F.col("file_id").alias("Document_ID"), F.col("page_number").alias("Page_No")).agg(F.lit("Voter Record Pages").alias("Page_Type"), F.round(F.avg("mean_confidence"), 6).alias("Confidence"))
    pages = pages.withColumn("Page_ID", F.concat("Document_ID", F.lit("_P"), F.col("Page_No").cast("string")))
    text = lambda c: F.coalesce(c, F.lit(""))
    voters = electors.select(
        F.col("id").alias("Voter_ID"), F.col("file_id").alias("Document_ID"), F.col("page_number").alias("Page_No"), digits_or_null(F.col("serial")).alias("Serial_No"), text("epic").alias("EPIC"), text("name").alias("Name"),
        text("relation_name").alias("Relative_Name"), text("relation_type").alias("Relation"), text("gender").alias("Gender"), digits_or_null(F.col("age")).alias("Age"), text("house_number").alias("House_No"),
    )
    gender = lambda g: F.count_if(F.col("Gender") == g)
    summary = voters.groupBy("Document_ID").agg(gender("Male").alias("Male"), gender("Female").alias("Female"), F.count(F.lit(1)).alias("Total")).withColumn("Third_Gender", F.col("Total") - F.col("Male") - F.col("Female"))
    return {"Documents": documents, "Pages": pages, "Voters": voters, "Summary": summary}


def dataset_columns(electors: DataFrame, stations: DataFrame, confidence: float = 0.95) -> DataFrame:
    """The 13 columns of the data set export, as text."""
    names = stations.select("part_number", F.col("name").alias("_station"))
    columns = {
        "Page_No": "page_number", "Part_No": "part_number", "Serial_No": "serial", "EPIC_ID": "epic", "Name": "name", "Relation": "relation_type", "Relative_Name": "relation_name",
        "House_No": "house_number", "Age": "age", "Gender": "gender", "Section": "constituency", "Polling_Station": "_station",
    }
    rows = electors.join(names, "part_number", "left")
    return shown(rows.select(*[F.col(c).alias(k) for k, c in columns.items()], F.lit(confidence).alias("Confidence")))


def report_columns(reports: DataFrame) -> DataFrame:
    """The 12 columns of the validation report, the pass rate with a per cent sign."""
    columns = {
        "PDF File": "pdf_file", "AC Number": "ac_number", "Part Number": "part_number", "Total PDF Records": "expected", "Total DB Records": "extracted", "Matched": "matched",
        "Missing in DB": "missing", "Extra in DB": "extra", "Incorrect": "incorrect", "Duplicates": "duplicates",
    }
    rate = F.concat(one_decimal(F.col("pass_rate").cast("double")), F.lit("%"))
    return reports.select(*[F.col(c).alias(k) for k, c in columns.items()], rate.alias("Pass %"), F.col("verdict").alias("Status"))


def preview(rows: DataFrame, order: list[Column], limit: int = 50) -> DataFrame:
    """First rows with the number of all and whether it is cut."""
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    return rows.orderBy(*order).limit(limit).join(F.broadcast(total)).withColumn("truncated", F.col("total_rows") > limit)
