"""Filtered, sorted and paged lists of a table."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.operators.similar import holders
from registra.operators.storage import stored


def holds(c: Column, text: str) -> Column:
    """Literal, case-insensitive search."""
    return F.lower(c.cast("string")).contains(text.lower())


def all_of(predicates: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, predicates, F.lit(True))


def any_of(predicates: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, predicates, F.lit(False))


def predicates(equal: dict | None = None, within: dict | None = None, search: dict | None = None) -> list[Column]:
    """Predicates of the given values; a value of None asks nothing.

    equal: column -> value. within: column -> (least, most), ends included, either may be None.
    search: column -> text.
    """
    out = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    for c, (lo, hi) in (within or {}).items():
        out += [F.col(c) >= lo] if lo is not None else []
        out += [F.col(c) <= hi] if hi is not None else []
    return out + [holds(F.col(c), t) for c, t in (search or {}).items() if t]


#: Optional filters of the elector list: name -> (kind, column).
ELECTOR_FILTERS = {
    "search": ("holds", "search_text"), "gender": ("equal", "gender"), "relation_type": ("equal", "relation_type"), "part_number": ("equal", "part_number"), "constituency": ("equal", "constituency"),
    "house_number": ("like", "house_number"), "has_photo": ("filled", "photo_path"), "polling_station_id": ("equal", "polling_station_id"), "is_supplement": ("flag", "is_supplement"), "is_deleted": ("flag", "is_deleted"),
    "min_serial": ("least", "serial"), "max_serial": ("most", "serial"), "min_page": ("least", "page_number"), "max_page": ("most", "page_number"), "source_file_name": ("like", "source_file_name"),
    "source_file_id": ("equal", "source_file_id"), "verified": ("flag", "verified"), "min_age": ("least", "age"), "max_age": ("most", "age"),
}


def elector_filter(name: str, value: object) -> Column:
    """The predicate of one filter of the elector list; an empty text or None asks nothing."""
    kind, column = ELECTOR_FILTERS[name]
    c = F.col(column)
    if value is None or (isinstance(value, str) and not value.strip()):
        return F.lit(True)
    if kind == "holds":
        return F.coalesce(c.contains(str(value).lower().strip()), F.lit(False))
    if kind == "like":  # case does not matter
        return F.coalesce(F.lower(c).contains(str(value).lower().strip()), F.lit(False))
    if kind == "filled":
        there = F.coalesce(c, F.lit("")) != ""
        return there if value else ~there
    test = {"equal": c == value, "flag": c == value, "least": c >= value, "most": c <= value}[kind]
    return F.coalesce(test, F.lit(False))


def elector_list(rows: DataFrame, sort: str, sortable: list[str], descending: bool = True, offset: int = 0, limit: int = 50, **filters) -> DataFrame:
    """A page of the electors that pass all filters, with ``total``, how many do."""
    unknown = set(filters) - set(ELECTOR_FILTERS)
    if unknown:
        raise ValueError(f"unknown filters {sorted(unknown)}")
    found = rows.filter(all_of(elector_filter(k, v) for k, v in filters.items()))
    total = F.broadcast(found.agg(F.count(F.lit(1)).alias("total")))
    return page(found, sort, "id", sortable, descending, offset, limit).join(total)


def search_text(columns: list[str]) -> Column:
    """Non-empty values joined by a space, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.when(F.col(c).cast("string") != "", F.col(c).cast("string")) for c in columns]))


def page(rows: DataFrame, sort: str, tie: str, allowed: list[str], descending: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in the order of a whitelisted column, ties by ``tie``; nulls first ascending."""
    if sort not in allowed:
        raise ValueError(f"cannot sort by {sort}")
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_first()
    return rows.orderBy(order, F.col(tie)).offset(offset).limit(limit)


def disclosed(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows, each with ``total`` and ``truncated``; the total is an aggregate of its own."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).limit(limit).join(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def search_everywhere(rows: DataFrame, text: str, cut: int = 500) -> DataFrame:
    """Rows of which any column holds the text; long strings are shown cut."""
    found = rows.filter(F.coalesce(any_of(F.coalesce(holds(F.col(c), text), F.lit(False)) for c in rows.columns), F.lit(False)))
    shown = [F.when(F.length(c) > cut, F.concat(F.substring(c, 1, cut), F.lit("…"))).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    return found.select(*shown)


def natural_number(c: Column) -> Column:
    """Sort key of a text number: its value, 0 for other text."""
    return F.when(c.rlike("^[0-9]{1,9}$"), c.try_cast("int")).otherwise(F.lit(0))


def cascade(keys: DataFrame, rows: DataFrame, key: str, id_col: str, exact: list[str], partial: list[str]) -> DataFrame:
    """For each key the row of the first tier that holds it: exact columns in turn, then partial.

    Exact tiers are equi-joins; only keys without an exact hit are searched for in part, through an
    index of grams. An empty key is held by no row.
    """
    low = F.lower(F.col(key))
    tiers = [keys.join(rows.select(F.lower(F.col(c).cast("string")).alias("_v"), F.col(id_col).alias("_id")), low == F.col("_v")).select(key, F.lit(i).alias("tier"), "_id") for i, c in enumerate(exact)]
    found = functools.reduce(DataFrame.unionByName, tiers)
    best = found.groupBy(key).agg(F.min(F.struct("tier", "_id")).alias("_b"))
    rest = keys.join(best, key, "left_anti").withColumn("_low", low)
    text = F.concat_ws("\n", *[F.lower(F.col(c).cast("string")) for c in partial])
    part = holders(rest, rows.select(F.col(id_col).alias("_id"), text.alias("_t")), "_low", "_t").groupBy(key).agg(F.min(F.struct(F.lit(len(exact)).alias("tier"), "_id")).alias("_b"))
    return best.unionByName(part).select(key, F.col("_b.tier").alias("tier"), F.col("_b._id").alias(id_col))


def ranked(rows: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """``rows`` with their place in this order, from 1, without a task that sees them all: a range sort, whose
    partitions are numbered from the sizes of those before. What is collected are these sizes."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", *keys).repartitionByRange(parts, *names).sortWithinPartitions(*names)
    keyed = stored(keyed.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    sizes = sorted(keyed.groupBy("_part").agg(F.count(F.lit(1)), F.min("_at")).collect())
    before, offsets = 0, []
    for part, n, first in sizes:
        offsets.append((part, before - first + 1))
        before += n
    shift = F.create_map(*[F.lit(x) for pair in offsets for x in pair]) if offsets else F.create_map().cast("map<int, bigint>")
    return keyed.withColumn(out, F.col("_at") + F.element_at(shift, F.col("_part"))).drop("_part", "_at", *names)


#: Groups of states under which files are listed.
STATUS_GROUPS = {"queued": "active", "running": "active", "processing": "active", "pending": "active"}


def file_items(files: DataFrame, name: str, folder: str, status: str, search: str | None = None, groups: list[str] | None = None, page: int = 1, size: int = 50, limit: int | None = None) -> DataFrame:
    """A page of the file list in natural order: name, folder, ``status_group``, ``place`` and ``total``.

    search: text in the name or folder; groups: wanted status groups. ``limit`` shows less than the page's size.
    """
    group = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in STATUS_GROUPS.items() for x in pair]), F.col(status)), F.col(status))
    rows = files.withColumn("status_group", group)
    if search:
        rows = rows.filter(holds(F.col(name), search) | holds(F.col(folder), search))
    if groups:
        rows = rows.filter(F.col("status_group").isin(groups))
    out = ranked(rows.select(name, folder, "status_group"), [natural_number(F.regexp_extract(name, r"(\d+)", 1)), F.col(name)])
    total = F.broadcast(out.agg(F.count(F.lit(1)).alias("total")))
    first = (page - 1) * size
    return out.filter(F.col("place").between(first + 1, first + min(size, limit or size))).join(total)
