"""Cells and lines of a page: rows by first fit, bands, grids and which grid fits best.

Rules that depend on the order of a page's boxes run as a state machine over sorted rows: a task
reads its pages in order and holds the open rows of one page, never the page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.functions import geometry as B

#: Distance from which a cell is too far from a line.
REACH = 15.0


def in_order(rows: DataFrame, page: str, order: list[str], columns: list[str], start: Callable[[], Callable], out: str) -> DataFrame:
    """``rows`` with the number that a page's machine gives each of them, in this order.

    start: makes the machine of a page, a function of the columns' values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, machine = None, None
        for x in batches:
            n, key = x.num_rows, x.column("_page")
            if not n:
                continue
            begins = [machine is None or key[0].as_py() != last, *pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_pylist()]
            last, numbers = key[n - 1].as_py(), []
            for first, *values in zip(begins, *(x.column(c).to_numpy(zero_copy_only=False).tolist() for c in columns), strict=True):
                if first:
                    machine = start()
                numbers.append(machine(*values))
            # only the columns that the machine reads become Python values
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(numbers, pa.int32())], names=[*x.schema.names, out])

    # the page as text, so that null pages are one page
    keyed = rows.withColumn("_page", F.coalesce(F.concat(F.lit("p"), F.col(page).cast("string")), F.lit("")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + f", {out} int"
    return keyed.repartition("_page").sortWithinPartitions("_page", *order).mapInArrow(run, schema).drop("_page")


def banded(rows: DataFrame, page: str, value: str, tie: str, tolerance: float, out: str = "band") -> DataFrame:
    """Bands of sorted values, from 1: a new one where a value is more than ``tolerance`` above the first of the band."""

    def start():
        first, n = None, 0

        def step(v: float) -> int:
            nonlocal first, n
            if first is None or v - first > tolerance:
                first, n = v, n + 1
            return n

        return step

    return in_order(rows.filter(F.col(value).isNotNull()), page, [value, tie], [value], start, out)


def cell_rows(cells: DataFrame, page: str, tie: str, out: str = "row") -> DataFrame:
    """Rows of cells (x, y, w, h), from 0 downwards: a cell joins the first open row whose first cell's
    centre is nearer than half the larger height of the two, else it opens one."""

    def start():
        open_: list[tuple[float, float]] = []

        def step(y: float, h: float) -> int:
            middle = y + h / 2
            for i, (ref, height) in enumerate(open_):
                if abs(middle - ref) < max(height, h) * 0.5:
                    return i
            open_.append((middle, h))
            return len(open_) - 1

        return step

    return in_order(cells, page, ["y", "x", tie], ["y", "h"], start, out)


def reading_order(cells: DataFrame, page: str, tie: str, out: str = "place") -> DataFrame:
    """``cells`` with ``row`` and their place in reading order, from 0: row by row, from the left."""
    way = Window.partitionBy(page).orderBy("row", "x", "y", tie)
    return cell_rows(cells, page, tie).withColumn(out, F.row_number().over(way) - 1)


def _median(values: Column) -> Column:
    known = F.array_sort(F.array_compact(values))
    n = F.size(known)
    at = lambda i: F.get(known, F.floor(i / 2).cast("int"))
    return F.when(n > 0, (at(n - 1) + at(n)) / 2)


def _axis(pages: DataFrame, number: Callable[[Column], Column], centre: Callable[[Column], Column], size: str, out: str) -> DataFrame:
    """First bound and pitch of one axis of each page's grid: the median step between the mean centres, or
    the median size of the cells where there is one line only. pages: the cells of a page as ``_cells``."""

    def mean(i: Column) -> Column:
        some = F.array_compact(F.transform(F.filter("_cells", lambda c: number(c).eqNullSafe(i)), centre))
        return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda x, y: x + y) / F.size(some))

    pages = pages.withColumn("_i", F.array_sort(F.array_distinct(F.transform("_cells", number))))
    pages = pages.withColumn("_c", F.transform("_i", mean))
    more = F.size("_c") - 1
    steps = F.zip_with(F.slice("_c", F.lit(2), more), F.slice("_c", F.lit(1), more), lambda x, y: x - y)
    pages = pages.withColumn("_step", _median(steps)).withColumn(f"_{out}p", F.coalesce("_step", _median(F.transform("_cells", lambda c: c[size]))))
    first = F.when(F.get("_i", F.lit(0)).isNotNull(), F.get("_c", F.lit(0)))
    return pages.withColumn(f"_{out}0", first - F.col(f"_{out}p") * 0.5).drop("_i", "_c", "_step")


def _line_number(value: Column, first: str, pitch: str, count: int) -> Column:
    """Number of the half-open band that holds a value; null beyond the grid."""
    bound = lambda i: F.col(first) + i * F.col(pitch)
    near = F.floor((value - F.col(first)) / F.col(pitch))
    i = F.when(value < bound(near), near - 1).when(value >= bound(near + 1), near + 1).otherwise(near)
    return F.when((F.col(pitch) > 0) & i.between(0, count - 1), i.cast("int"))


def lines_in_grid(lines: DataFrame, cells: DataFrame, page: str, line: str, cell: str, rows: int, cols: int) -> DataFrame:
    """Cell of each line: ``page``, ``line``, ``cell`` (null if none).

    Where a page has all ``rows`` x ``cols`` cells (numbered row by row) a line belongs to the bands of row
    and column that hold its centre, whatever the cells' own borders; elsewhere to the first cell that holds the centre,
    else the nearest within reach. lines: x, y, w, h; cells: x, y, w, h. A page's cells are held in one row;
    each row of ``lines`` is placed by its own box, also where ids repeat.
    """
    # cells move once and lines once: a page's cells become one row, which its lines meet
    boxed = cells.filter(F.col(page).isNotNull()).select(F.col(page).alias("_page"), F.struct(F.col(cell).alias("cell"), *"xywh").alias("_b"))
    pages = boxed.repartition("_page").groupBy("_page").agg(F.collect_list("_b").alias("_cells"))
    pages = _axis(pages, lambda c: F.floor(c["cell"] / cols), lambda c: c["y"] + c["h"] / 2, "h", "r")
    pages = _axis(pages, lambda c: c["cell"] % cols, lambda c: c["x"] + c["w"] / 2, "w", "c")
    whole = F.size("_cells") == rows * cols
    pages = pages.select("_page", "_r0", "_rp", "_c0", "_cp", whole.alias("_whole"), F.when(~whole, F.col("_cells")).alias("_cells"))
    middle = lines.select(page, line, (F.col("x") + F.col("w") / 2).alias("_mx"), (F.col("y") + F.col("h") / 2).alias("_my"))
    found = middle.join(pages, F.col(page) == F.col("_page"), "left")
    r, c = _line_number(F.col("_my"), "_r0", "_rp", rows), _line_number(F.col("_mx"), "_c0", "_cp", cols)
    off = lambda at, x, w: F.greatest(x - at, at - x - w, F.lit(0.0))

    def near(b: Column) -> Column:
        dx, dy = off(F.col("_mx"), b["x"], b["w"]), off(F.col("_my"), b["y"], b["h"])
        return F.struct(F.sqrt(dx * dx + dy * dy).alias("d"), b["cell"].alias("cell"))

    nearest = F.array_min(F.filter(F.transform("_cells", near), lambda x: x["d"] < REACH))["cell"]
    return found.select(page, line, F.when(F.col("_whole"), r * cols + c).otherwise(nearest).cast("int").alias(cell))


def grid_deviations(detected: DataFrame, grids: DataFrame, page: str, tie: str) -> DataFrame:
    """``deviation`` of each (page, grid): mean of 1 - IoU of detected cells and the grid's cells, paired in
    reading order; 1 where their numbers differ.

    detected: page, x, y, w, h, of which null pages play no part; grids: page, grid, place (from 0, in reading order), x, y, w, h. Grids without
    the column page are those of every page that has cells; they are few and broadcast.
    """
    detected = detected.filter(F.col(page).isNotNull())
    found = reading_order(detected, page, tie).select(page, "place", *[F.col(k).alias(f"d{k}") for k in "xywh"])
    if page not in grids.columns:
        return _shared_deviations(found, grids, page)
    n = found.groupBy(page).agg(F.count(F.lit(1)).alias("_found"))
    size = grids.groupBy(page, "grid").agg(F.count(F.lit(1)).alias("_size"))
    overlap = B.iou(tuple(F.col(f"d{k}") for k in "xywh"), tuple(F.col(k) for k in "xywh"))
    paired = grids.join(found, [page, "place"]).groupBy(page, "grid").agg(F.avg(overlap).alias("_iou"))
    out = size.join(n, page, "left").join(paired, [page, "grid"], "left")
    same = F.coalesce(F.col("_size") == F.col("_found"), F.lit(False))
    return out.select(page, "grid", F.when(same, 1 - F.coalesce("_iou", F.lit(0.0))).otherwise(1.0).alias("deviation"))


def _shared_deviations(found: DataFrame, grids: DataFrame, page: str) -> DataFrame:
    """Deviations from grids that all pages share: cells in reading order meet the places of all grids in the
    partitions where they were ordered, a page gives one row, and nothing is generated for each page and grid."""
    sizes = sorted((r["grid"], r["n"]) for r in grids.groupBy("grid").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a grid
    spots = grids.groupBy("place").pivot("grid", [g for g, _ in sizes]).agg(F.first(F.struct(*"xywh")))
    spots = spots.select("place", *[F.col(f"`{g}`").alias(f"_g{i}") for i, (g, _) in enumerate(sizes)])
    met = found.join(F.broadcast(spots), "place", "left")
    own = tuple(F.col(f"d{k}") for k in "xywh")
    mean = lambda i: F.avg(F.when(F.col(f"_g{i}").isNotNull(), B.iou(own, tuple(F.col(f"_g{i}.{k}") for k in "xywh")))).alias(f"_iou{i}")
    pages = met.groupBy(page).agg(F.count(F.lit(1)).alias("_found"), *[mean(i) for i in range(len(sizes))])
    deviation = lambda i, n: F.when(F.col("_found") == n, 1 - F.coalesce(f"_iou{i}", F.lit(0.0))).otherwise(1.0)
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("grid"), deviation(i, n).alias("deviation")) for i, (g, n) in enumerate(sizes)]))
    return pages.select(page, each.alias("_d")).select(page, "_d.*")


def best_grids(deviations: DataFrame, page: str) -> DataFrame:
    """The grid of each page that deviates least, the first by name in a tie."""
    best = F.min(F.struct("deviation", "grid"))
    return deviations.groupBy(page).agg(best.alias("_b")).select(page, "_b.grid", "_b.deviation")
