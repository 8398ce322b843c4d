"""Jobs over the text lines of pages: classes, headers, tables, grids, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def without_furniture(lines: DataFrame, text: str, stems: list[str], pattern: str) -> DataFrame:
    """Lines without running heads and feet."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    odd = low.rlike(pattern)
    for s in stems:
        odd = odd | low.contains(s)
    return lines.filter(~odd)


def classified(lines: DataFrame, page: str, text: str, markers: dict[str, list[str]], least: int = 2, identifier: str = "[A-Z]{3}[0-9]{7}") -> DataFrame:
    """Class of each page by ordered rules: a class whose markers are found ``least`` times at least,
    then pages with three identifiers, then pages of three lines or fewer, else ``other``.

    A marker counts once a page, however many lines hold it.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = {k: sum((F.max(low.contains(m).cast("int")) for m in ms), F.lit(0)) for k, ms in markers.items()}
    ids = F.sum(F.size(F.regexp_extract_all(F.upper(F.coalesce(F.col(text), F.lit(""))), F.lit(identifier), 0)))
    per = lines.groupBy(page).agg(*[h.alias(f"m_{k}") for k, h in hits.items()], ids.alias("ids"), F.count(F.lit(1)).alias("lines"))
    kind, sure = None, None
    for k, ms in markers.items():
        hit = F.col(f"m_{k}") >= least
        kind = F.when(hit, k) if kind is None else kind.when(hit, k)
        sure = F.when(hit, F.col(f"m_{k}") / len(ms)) if sure is None else sure.when(hit, F.col(f"m_{k}") / len(ms))
    kind = kind.when(F.col("ids") >= 3, "electors").when(F.col("lines") <= 3, "blank").otherwise("other")
    return per.select(page, kind.alias("page_type"), F.round(sure.when(F.col("ids") >= 3, F.least(F.lit(1.0), F.col("ids") / 10.0)).otherwise(0.5), 4).alias("confidence"), "lines", "ids")


def template_score(lines: DataFrame, page: str, text: str, labels: list[str], header: str) -> DataFrame:
    """Template of each page: label anchors .55, identifiers .35 (some .20), header .10; floor .45."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    anchors = sum((F.max(low.contains(x).cast("int")) for x in labels), F.lit(0)) / float(len(labels))
    ids = F.sum(F.size(F.regexp_extract_all(F.upper(F.coalesce(F.col(text), F.lit(""))), F.lit("[A-Z]{3}[0-9]{7}"), 0)))
    per = lines.groupBy(page).agg(anchors.alias("a"), ids.alias("n"), F.max(low.contains(header).cast("int")).alias("h"))
    score = F.round(F.col("a") * 0.55 + F.when(F.col("n") >= 3, 0.35).when(F.col("n") >= 1, 0.20).otherwise(0.0) + F.col("h") * 0.10, 4)
    return per.select(page, score.alias("score"), F.when(score >= 0.45, "roll").otherwise("generic").alias("template"))


def generic_records(lines: DataFrame, page: str, order: list[Column], text: str, confidence: str) -> DataFrame:
    """One record a line: number, text, confidence and issues."""
    number = F.row_number().over(Window.partitionBy(page).orderBy(*order))
    issue = F.when(F.trim(F.coalesce(F.col(text), F.lit(""))) == "", "empty").when(F.col(confidence) < 0.60, "low confidence")
    return lines.select(page, number.alias("line_number"), F.col(text).alias("text"), F.round(confidence, 4).alias("confidence"), issue.alias("issue"))


def first_match(lines: DataFrame, page: str, order: str, text: str, pattern: str, out: str) -> DataFrame:
    """The first capture of a pattern on each page."""
    got = F.regexp_extract(text, pattern, 1)
    return lines.withColumn("_g", got).filter("_g != ''").groupBy(page).agg(F.min(F.struct(order, "_g")).getField("_g").alias(out))


def anchors(lines: DataFrame, page: str, order: list[str], id_col: str, text: str, stems: dict[str, list[str]]) -> DataFrame:
    """The first line of each page that holds one of the stems of each anchor."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = lambda ss: F.exists(F.array(*[F.lit(s) for s in ss]), lambda s: low.contains(s))
    named = F.array_compact(F.array(*[F.when(hit(ss), k) for k, ss in stems.items()]))
    rows = lines.select(page, *order, id_col, F.explode(named).alias("anchor"))
    return rows.groupBy(page, "anchor").agg(F.min(F.struct(*order, id_col)).getField(id_col).alias(id_col))


def head_and_foot(lines: DataFrame, body: DataFrame, page: str, y: str, h: str, text: str, tie: str) -> DataFrame:
    """Text above and below the body (columns page, top, bottom), in reading order."""
    rows = lines.join(body, page)
    part = F.when(F.col(y) + F.col(h) <= F.col("top"), "header").when(F.col(y) >= F.col("bottom"), "footer")
    inside = rows.withColumn("part", part).filter("part is not null")
    text_of = lambda p: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == p, F.struct(F.col(y), F.col(tie), F.col(text).alias("_t"))))), lambda x: x["_t"]), " ")
    return inside.groupBy(page).agg(text_of("header").alias("header_text"), text_of("footer").alias("footer_text"))


def grid(pages: DataFrame, page: str, rows: int, columns: int) -> DataFrame:
    """Boxes of a proportional grid over the body box x, y, w, h of each page."""
    r, c = F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("c")
    cells = pages.select("*", r).select("*", c)
    w, h = F.col("w") / columns, F.col("h") / rows
    return cells.select(page, (F.col("r") * columns + F.col("c")).alias("cell"), (F.col("x") + F.col("c") * w).alias("cx"), (F.col("y") + F.col("r") * h).alias("cy"), w.alias("cw"), h.alias("ch"))


def continued_pages(pages: DataFrame, file: str, number: str, starts: Column, goes_on: Column, height: str) -> DataFrame:
    """Pages of a table from its first page until one that does not go on, with the height above."""
    way = Window.partitionBy(file).orderBy(number)
    # one order for all windows, so that pages are sorted once
    first = F.min(F.when(starts, F.col(number))).over(way.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = pages.withColumn("_first", first).filter(F.col(number) >= F.col("_first"))
    stop = F.sum(F.when(goes_on, 0).otherwise(1)).over(way.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_stop", stop).filter("_stop = 0").drop("_stop", "_first")
    return rows.withColumn("shift", F.coalesce(F.sum(height).over(way.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def labelled_totals(rows: DataFrame, page: str, order: str, text: str, labels: dict[str, str], total: str) -> DataFrame:
    """Rows of a summary table with the category they belong to: their own label, or on a total row
    the last one above."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    own = None
    for k, stem in labels.items():
        own = F.when(low.contains(stem), k) if own is None else own.when(low.contains(stem), k)
    way = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_own", own)
    carried = F.last("_own", ignorenulls=True).over(way)
    is_total = low.contains(total)
    return marked.withColumns({"category": F.coalesce("_own", F.when(is_total, carried)), "is_total": is_total}).drop("_own")


def bound_citations(replies: DataFrame, id_col: str, text: str, known: DataFrame, key: str) -> DataFrame:
    """Replies without the ``[[v:id]]`` marks of unknown ids, and the cited ids once each, in order."""
    marks = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\[\[v:([^\]]+)\]\]"), 1)
    cited = replies.select(id_col, F.posexplode(marks).alias("pos", key))
    good = cited.join(known.select(F.col(key)).distinct(), key, "left_semi").groupBy(id_col, key).agg(F.min("pos").alias("pos"))
    listed = good.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", key))), lambda x: x[key]).alias("cited"))
    out = replies.join(listed, id_col, "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<string>")))
    bad = F.array_except(F.array_distinct(marks), F.col("cited"))
    clean = F.aggregate(bad, F.coalesce(F.col(text), F.lit("")), lambda t, i: F.replace(t, F.concat(F.lit("[[v:"), i, F.lit("]]")), F.lit("")))
    return out.withColumn(text, clean)


def key_values(lines: DataFrame, id_cols: list[str], text: str, labels: list[str]) -> DataFrame:
    """``label: value`` pairs of lines split at ``|``; the longest label that ends the key counts."""
    parts = lines.select(*id_cols, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\|")).alias("pos", "part"))
    key = F.lower(F.trim(F.regexp_extract("part", r"^([^:=]*)[:=]", 1)))
    value = F.trim(F.regexp_extract("part", r"^[^:=]*[:=](.*)$", 1))
    best = None
    for label in sorted(labels, key=lambda x: (-len(x), x)):
        hit = F.col("key").endswith(label.lower())
        best = F.when(hit, label) if best is None else best.when(hit, label)
    return parts.select(*id_cols, "pos", key.alias("key"), value.alias("value")).withColumn("label", best).filter("label is not null").select(*id_cols, "pos", "label", "value")


def cell_records(lines: DataFrame, cell: list[str], order: str, text: str, labels: list[str], identifier: str = "[A-Z]{3}[0-9]{7}") -> DataFrame:
    """One record a cell: the first value of each label in line order, and the first identifier by
    shape. A label without a value takes the next line of its cell."""
    following = F.lead(text).over(Window.partitionBy(*cell).orderBy(order))
    wrapped = lines.withColumn("_line", F.when(F.trim(F.col(text)).rlike(r"[:=]$"), F.concat_ws(" ", F.col(text), following)).otherwise(F.col(text)))
    pairs = key_values(wrapped, [*cell, order], "_line", labels).filter("value != ''")
    first = lambda label: F.min(F.when(F.col("label") == label, F.struct(order, "pos", "value"))).getField("value").alias(label.replace(" ", "_"))
    values = pairs.groupBy(*cell).agg(*[first(x) for x in labels])
    shape = F.regexp_extract(F.upper(F.coalesce(F.col(text), F.lit(""))), f"({identifier})", 1)
    ids = lines.withColumn("_id", shape).filter("_id != ''").groupBy(*cell).agg(F.min(F.struct(order, "_id")).getField("_id").alias("identifier"))
    return values.join(ids, cell, "full_outer")


def summary_rows(lines: DataFrame, page: str, id_col: str, text: str, labels: dict[str, str], reach: float) -> DataFrame:
    """Printed totals of each page: for each labelled line the number to its right on the same line.

    ``labels``: column -> stem. Adds ``consistent``: base + additions - deletions = net.
    """
    from registra.functions.text import count_text
    from registra.operators.joins import nearest_right

    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    kind = None
    for k, stem in labels.items():
        kind = F.when(low.contains(stem), k) if kind is None else kind.when(low.contains(stem), k)
    named = lines.withColumns({"_kind": kind, "_n": count_text(F.col(text))})
    left, right = named.filter("_kind is not null"), named.filter("_n is not null")
    pairs = nearest_right(left, right, page, id_col, F.lit(reach))
    got = pairs.join(left.select(page, F.col(id_col).alias("label_id"), "_kind"), [page, "label_id"]).join(right.select(page, F.col(id_col).alias("value_id"), "_n"), [page, "value_id"])
    out = got.groupBy(page).agg(*[F.max(F.when(F.col("_kind") == k, F.col("_n"))).alias(k) for k in labels])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.withColumn("consistent", zero("base") + zero("additions") - zero("deletions") == zero("net"))


def cover_rows(lines: DataFrame, page: str, order: str, text: str, labels: list[str]) -> DataFrame:
    """Station row of each cover: values of its labels, the first date and the first pin code."""
    pairs = key_values(lines, [page, order], text, labels).filter("value != ''")
    first = lambda label: F.min(F.when(F.col("label") == label, F.struct(order, "pos", "value"))).getField("value").alias(label.replace(" ", "_"))
    values = pairs.groupBy(page).agg(*[first(x) for x in labels])
    dates = first_match(lines, page, order, text, r"(\d{2}[-/.]\d{2}[-/.]\d{4})", "qualifying_date")
    pins = first_match(lines, page, order, text, r"(?:^|\D)(\d{6})(?:\D|$)", "pincode")
    return values.join(dates, page, "left").join(pins, page, "left")
