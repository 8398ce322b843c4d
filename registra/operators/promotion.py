"""Promotion of recognised records to the curated register, with what was refused and what was changed.

One record of each identifier wins: the latest revision, then clean over unclean, deleted over not,
supplement over main roll, the earlier page and place. Only the latest revision may strike an elector
off; the first stated reason there counts. Winners are found by aggregates, which are combined before
the shuffle, so that an identifier with a third of all records is no burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions import text as X
from registra.operators.storage import stored

# The fields of a curated row, and those whose changes are logged.
OWN = ["name", "relation_type", "relation_name", "house_number", "gender"]
AUDITED = ["epic", "serial", "name", "relation_type", "relation_name", "house_number", "age", "gender", "part_number", "constituency", "is_deleted", "deletion_reason"]
VALUES = [*AUDITED, "polling_station_id", "is_supplement", "section_name", "source_record_id", "source_page_id", "source_file_id", "source_file_name", "page_number"]
LONGEST = 255
#: Files of which the revisions are broadcast, as rows of two small values; more are joined by a shuffle.
FILES = 500_000
NO_ID, LOST, THERE = "No EPIC number on this record", "Superseded by another record for this elector", "EPIC already exists in the voter database"


def scoped(records: DataFrame, record_ids: DataFrame | None = None, page_id: object = None, file_id: object = None, all_documents: bool = False) -> DataFrame:
    """The records to promote: those listed, else a page's, else a file's, else all.

    record_ids: a table with the column record_id, of any size.
    """
    if record_ids is not None:
        return records.join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    for column, value in (("page_id", page_id), ("file_id", file_id)):
        if value is not None:
            return records.filter(F.col(column) == value)
    if not all_documents:
        raise ValueError("name record_ids, page_id, file_id or all_documents")
    return records


def _digits(c: str) -> Column:
    """A number of which the text has nothing but digits; else null."""
    return F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).try_cast("int"))


def own_values(records: DataFrame, only_clean: bool = False) -> DataFrame:
    """``placed`` without what files, stations and pages tell of a record."""
    rows = records.filter((F.col("error_count") == 0) | (F.col("is_deleted") == "Yes")) if only_clean else records
    rows = rows.fillna("", ["epic", *OWN, "serial", "age", "is_deleted", "deletion_reason", "section_name"])
    return rows.select(
        X.normal_id(F.col("epic")).alias("epic"), *OWN, _digits("serial").alias("serial"), _digits("age").alias("age"),
        (F.col("is_deleted") == "Yes").alias("struck"), F.col("deletion_reason").alias("reason"), "section_name",
        F.col("record_id").alias("source_record_id"), F.col("page_id").alias("source_page_id"), F.col("file_id").alias("source_file_id"),
        "page_number", "idx", (F.col("error_count") == 0).alias("clean"),
    )


def revised(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with the ``revision`` of their file; names are read once a file, not once a record."""
    name = F.coalesce("file_name", F.lit(""))
    few = files.select(F.col("file_id").alias("source_file_id"), X.revision(name).alias("revision"))
    few = F.broadcast(few) if files.limit(FILES + 1).count() <= FILES else few
    return rows.join(few, "source_file_id", "left").withColumn("revision", F.coalesce("revision", F.lit(0)))


def on_page(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows with ``is_supplement`` and the ``header_text`` of their page."""
    page = pages.select(F.col("page_id").alias("source_page_id"), "page_type", "header_text")
    rows = rows.join(page, "source_page_id", "left")
    return rows.withColumn("is_supplement", F.coalesce(F.col("page_type") == "supplement_page", F.lit(False))).drop("page_type")


def in_place(rows: DataFrame, pages: DataFrame, files: DataFrame, stations: DataFrame) -> DataFrame:
    """Rows of ``own_values`` with what their page, file and station tell."""
    station = stations.select(F.col("file_id").alias("source_file_id"), F.col("station_id").alias("polling_station_id"), F.col("part_number").alias("_part"), "ac_number", "ac_name", "address")
    name = files.select(F.col("file_id").alias("source_file_id"), F.col("file_name").alias("source_file_name"))
    rows = on_page(rows, pages).join(name, "source_file_id", "left").join(station, "source_file_id", "left")
    ac = F.when(F.coalesce("ac_number", F.lit("")) != "", F.concat_ws("-", "ac_number", "ac_name")).otherwise(F.col("ac_name"))
    named = F.when(F.coalesce("ac_name", F.lit("")) != "", ac).otherwise(F.coalesce("header_text", F.lit("")))
    values = {
        "part_number": F.coalesce("_part", F.lit("")), "constituency": F.substring(named, 1, LONGEST),
        "section_name": F.coalesce(F.when(F.col("section_name") != "", F.col("section_name")), "address"), "source_file_name": F.coalesce("source_file_name", F.lit("")),
    }
    return rows.withColumns(values).drop("_part", "ac_number", "ac_name", "address", "header_text")


def placed(records: DataFrame, pages: DataFrame, files: DataFrame, stations: DataFrame, only_clean: bool = False) -> DataFrame:
    """Records with the values that their curated rows would have.

    records: record_id, page_id, file_id, page_number, idx, error_count and texts epic, name, serial,
    relation_type, relation_name, house_number, age, gender, is_deleted, deletion_reason, section_name.
    pages: page_id, page_type, header_text; files: file_id, file_name; stations: file_id, station_id,
    part_number, ac_number, ac_name, address; one row each. ``only_clean`` leaves records with errors out,
    unless they strike an elector off.
    """
    rows = in_place(own_values(records, only_clean), pages, files, stations)
    return rows.withColumn("revision", X.revision(F.col("source_file_name")))


def winners(rows: DataFrame, pages: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """For each identifier the record that wins, and whether and why it is struck off.

    rows: what ``placed`` gives, or ``own_values`` with pages and files. Only records of an identifier's latest
    revision matter to either, and only those of them that are alike clean and deleted meet their pages.
    """
    rows = rows if files is None else revised(rows, files)
    # unknown before known, as a null is the least of all
    clean = F.coalesce(F.col("clean").cast("long"), F.lit(2))
    rank = F.col("revision").cast("long") * 6 + clean * 2 + F.col("struck").cast("long")
    narrow = ["epic", "source_record_id", "source_page_id", "page_number", "idx", "reason"] + (["is_supplement"] if pages is None else [])
    rows = rows.filter("epic != ''").select(*narrow, rank.alias("_rank"))
    top = rows.groupBy("epic").agg(F.max("_rank").alias("_top"))
    level = lambda c: F.floor(F.col(c) / 6)
    latest = rows.join(top, "epic").filter(level("_rank") == level("_top"))
    latest = stored(latest.select(*narrow, (F.col("_rank") == F.col("_top")).alias("_first"), (F.col("_rank") % 2 == 1).alias("struck")), "latest", large=True)
    place = [F.coalesce("page_number", F.lit(0)).alias("p"), F.coalesce("idx", F.lit(0)).alias("i"), F.col("source_record_id").alias("r")]
    able = latest.filter("_first").select(*[c for c in narrow if c != "reason"])
    able = able if pages is None else on_page(able, pages).drop("header_text")
    best = able.groupBy("epic").agg(F.min_by("source_record_id", F.struct((~F.col("is_supplement")).alias("s"), *place)).alias("winner"))
    stated = F.struct((~F.col("struck")).alias("d"), (F.col("reason") == "").alias("e"), *place)
    why = latest.groupBy("epic").agg(F.min_by(F.struct("struck", "reason"), stated).alias("_d"))
    return best.join(why, "epic").select("epic", "winner", F.col("_d.struck").alias("is_deleted"), F.when(F.col("_d.struck"), F.col("_d.reason")).otherwise("").alias("_stated"))


def promotion(rows: DataFrame, current: DataFrame, on_conflict: str = "overwrite", actor: str = "system", places: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> dict[str, DataFrame]:
    """``curated`` rows with ``status`` (created, updated), ``conflicts`` (record, reason, names), ``audit``
    rows and ``counts``.

    rows: what ``placed`` gives, or ``own_values`` with ``places`` (pages, files, stations), which then meet
    only the records that need them; current: voter_id and VALUES of the register, one row for each epic.
    Overwriting keeps an old value where the new one is null. A record without identifier, one that
    another record supersedes and, with on_conflict 'skip', one that is there already are conflicts and counted as skipped.
    """
    if on_conflict not in ("overwrite", "skip"):
        raise ValueError(on_conflict)
    own = F.col("source_record_id")
    # what is known of an identifier comes together first, so that the records meet it in one join; those without one meet nothing
    held = winners(rows, *(places or ())[:2]).join(current.select("epic", "voter_id", F.struct(*[c for c in VALUES if c != "epic"]).alias("old")), "epic", "left")
    there = F.col("voter_id").isNotNull()
    refused = F.when(own != F.col("winner"), LOST).when(there & F.lit(on_conflict == "skip"), THERE)
    known = rows.filter("epic != ''").join(held, "epic").withColumn("refused", refused)
    lacking = rows.filter("epic = ''")
    kept_old = F.col("refused") == THERE
    conflicts = known.filter("refused is not null").select(own.alias("record_id"), "epic", F.col("refused").alias("reason"), F.when(kept_old, F.col("voter_id")).alias("existing_voter_id"), F.when(kept_old, F.col("old.name")).alias("existing_name"), F.col("name").alias("incoming_name"))
    none = F.lit(None).cast("string")
    conflicts = conflicts.unionByName(lacking.select(own.alias("record_id"), none.alias("epic"), F.lit(NO_ID).alias("reason"), none.alias("existing_voter_id"), none.alias("existing_name"), F.col("name").alias("incoming_name")))
    taken = known.filter("refused is null").withColumn("deletion_reason", F.when(F.col("_stated") != "", F.col("_stated")).otherwise(F.col("reason")))
    taken = taken if places is None else in_place(taken, *places)
    new = taken.select("epic", "voter_id", "old", F.struct(*[c for c in VALUES if c != "epic"]).alias("new"))
    value = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))
    status = F.when(there, "updated").otherwise("created")
    curated = new.select("epic", "voter_id", *[value(c).alias(c) for c in VALUES if c != "epic"], status.alias("status"))
    text = lambda c: F.col(c).cast("string")
    # an identifier is the key, so it does not change
    changes = [F.when(F.col(f"new.{c}").isNotNull() & ~F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")), F.struct(F.lit(c).alias("field_name"), text(f"old.{c}").alias("old_value"), text(f"new.{c}").alias("new_value"))) for c in AUDITED if c != "epic"]
    came = F.array(F.struct(F.lit(None).cast("string").alias("field_name"), F.lit(None).cast("string").alias("old_value"), F.trim(F.concat_ws(" ", "epic", "new.name")).alias("new_value")))
    logged = new.withColumn("_c", F.explode(F.when(there, F.array_compact(F.array(*changes))).otherwise(came)))
    source = lambda c: F.when(there, F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))).otherwise(F.col(f"new.{c}"))
    audit = logged.select("epic", "voter_id", F.lit("promoted").alias("action"), "_c.*", F.lit(actor).alias("user"), source("source_file_id").alias("file_id"), source("source_page_id").alias("page_id"))
    n = lambda c, name: F.count_if(c).alias(name)
    decided = known.select("refused", there.alias("_there")).unionByName(lacking.select(F.lit(NO_ID).alias("refused"), F.lit(False).alias("_there")))
    counts = decided.agg(n(F.col("refused").isNull() & ~F.col("_there"), "created"), n(F.col("refused").isNull() & F.col("_there"), "updated"), n(F.col("refused").isNotNull(), "skipped"))
    return {"curated": curated, "conflicts": conflicts, "audit": audit, "counts": counts}
