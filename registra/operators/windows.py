"""Ordered logic within a group, as windows and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in this order, which must end in a unique tie-break."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def pick_candidates(rows: DataFrame) -> DataFrame:
    """One record of each identifier: the latest revision wins, then clean over unclean, deleted over
    not, supplement over main roll, the earlier page and place. Only the latest revision may
    delete; the reason is the first one given there, in page order."""
    own = Window.partitionBy("epic")
    latest = rows.withColumn("_latest", F.max("revision").over(own)).filter("revision = _latest")
    order = [F.desc("is_clean"), F.desc("is_deleted"), F.desc("is_supplement"), "page_number", "idx", "record_id"]
    first = F.struct((F.col("reason") == "").alias("e"), F.col("page_number"), F.col("idx"), F.col("record_id"))
    marks = latest.withColumns({"deleted": F.max("is_deleted").over(own), "first_reason": F.min_by("reason", first).over(own)})
    return best_per(marks, ["epic"], order).drop("_latest")


def carried(rows: DataFrame, keys: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """The last non-blank value up to the row; blank before the first one."""
    way = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.trim(F.coalesce(F.col(value), F.lit(""))) != "", F.col(value)), ignorenulls=True).over(way)
    return rows.withColumn(out, F.coalesce(seen, F.lit("")))


def sequence_breaks(rows: DataFrame, keys: list[str], order: list[Column], number: str, least: int = 3) -> DataFrame:
    """Rows of which the number does not follow the one before, in groups of ``least`` numbers."""
    numbered = rows.filter(F.col(number).isNotNull())
    way = Window.partitionBy(*keys)
    marked = numbered.withColumns({"previous": F.lag(number).over(way.orderBy(*order)), "_n": F.count(F.lit(1)).over(way)})
    return marked.filter((F.col("_n") >= least) & (F.col(number) != F.col("previous") + 1)).drop("_n")


def repeats(rows: DataFrame, keys: list[str], order: list[Column], first: str, out: str = "first_seen") -> DataFrame:
    """Rows after the first of their keys, with a value of that first row."""
    way = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({"_rn": F.row_number().over(way), out: F.first(first).over(way)}).filter("_rn > 1").drop("_rn")


def chunks(rows: DataFrame, keys: list[str], order: list[Column], number: str, gap: float, out: str = "chunk") -> DataFrame:
    """Number of the chunk: a new one where the number jumps by more than ``gap``. Null numbers
    break nothing."""
    way = Window.partitionBy(*keys).orderBy(*order)
    last = F.last(number, ignorenulls=True).over(way.rowsBetween(Window.unboundedPreceding, -1))
    jump = F.when(F.col(number) - last > gap, 1).otherwise(0)
    return rows.withColumn("_jump", jump).withColumn(out, F.sum("_jump").over(way.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def median_pitch(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median step between the sorted values of a group, and the rows that its span holds."""
    tops = rows.select(*keys, value).distinct()
    way = Window.partitionBy(*keys).orderBy(value)
    steps = tops.withColumn("_step", F.col(value) - F.lag(value).over(way))
    pitch = steps.groupBy(*keys).agg(F.median("_step").alias("pitch"), (F.max(value) - F.min(value)).alias("_span"))
    return pitch.select(*keys, "pitch", F.greatest(F.lit(1), F.round(F.col("_span") / F.col("pitch")) + 1).cast("int").alias("n_rows"))
