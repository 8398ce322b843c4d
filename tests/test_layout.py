"""Rows of cells, bands, grids and global ranks against plain loops."""

import random

from pyspark.sql import functions as F

from registra.operators import layout, listing

BOX = "page int, cell int, x double, y double, w double, h double"


def plain_rows(cells):
    rows = []
    for c in sorted(cells, key=lambda c: (c[3], c[2], c[1])):
        for row in rows:
            ref = row[0]
            if abs(c[3] + c[5] / 2 - ref[3] - ref[5] / 2) < max(ref[5], c[5]) * 0.5:
                row.append(c)
                break
        else:
            rows.append([c])
    return {(c[0], c[1]): i for i, row in enumerate(rows) for c in row}


def test_rows_of_cells(spark):
    rng = random.Random(1)
    boxes = [(p, c, rng.choice([0.0, 50.0, 100.0]), float(rng.randint(0, 200)), 40.0, float(rng.choice([4, 20, 30, 90]))) for p in range(30) for c in range(rng.randint(1, 20))]
    boxes += [(None, 1, 0.0, 0.0, 1.0, 1.0), (None, 2, 0.0, 9.0, 1.0, 1.0)]
    want = {}
    for p in {b[0] for b in boxes}:
        want |= plain_rows([b for b in boxes if b[0] == p])
    frame = spark.createDataFrame(boxes, BOX)
    assert {(r.page, r.cell): r.row for r in layout.cell_rows(frame, "page", "cell").collect()} == want
    placed = layout.reading_order(frame.filter("page is not null"), "page", "cell").collect()
    for p in range(30):
        own = sorted((r for r in placed if r.page == p), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and [(r.row, r.x) for r in own] == sorted((r.row, r.x) for r in own)
    assert layout.cell_rows(frame.limit(0), "page", "cell").count() == 0


def grid(page, rows, cols, dx=100.0, dy=40.0):
    return [(page, r * cols + c, c * dx, r * dy, dx - 10, dy - 4) for r in range(rows) for c in range(cols)]


def test_lines_in_grid(spark):
    cells = grid(1, 2, 3) + grid(2, 2, 3)[:5] + grid(3, 1, 1)
    lines = [(1, 1, 95.0, 2.0, 2.0, 2.0), (1, 2, 210.0, 36.0, 4.0, 4.0), (1, 3, 500.0, 0.0, 2.0, 2.0), (1, 4, 0.0, -9.0, 2.0, 2.0), (2, 5, 95.0, 2.0, 2.0, 2.0), (2, 6, 250.0, 60.0, 2.0, 2.0), (2, 7, 500.0, 500.0, 2.0, 2.0), (4, 8, 0.0, 0.0, 1.0, 1.0)]
    lines = spark.createDataFrame(lines, "page int, line int, x double, y double, w double, h double")
    got = {r.line: r.cell for r in layout.lines_in_grid(lines, spark.createDataFrame(cells, BOX), "page", "line", "cell", 2, 3).collect()}
    # 96 lies in the gap between two cells, beyond the middle of it
    assert got == {1: 1, 2: 5, 3: None, 4: None, 5: 1, 6: None, 7: None, 8: None}
    one = layout.lines_in_grid(lines.filter("page = 1"), spark.createDataFrame(grid(1, 1, 1), BOX), "page", "line", "cell", 1, 1)
    assert {r.line: r.cell for r in one.collect()} == {1: None, 2: None, 3: None, 4: None}


def test_lines_in_grid_moves_lines_and_cells_once(spark):
    cells = spark.createDataFrame(grid(1, 2, 3) + grid(2, 2, 3)[:5], BOX)
    lines = spark.createDataFrame([(1, 1, 95.0, 2.0, 2.0, 2.0), (3, 2, 0.0, 0.0, 1.0, 1.0)], "page int, line int, x double, y double, w double, h double")
    out = layout.lines_in_grid(lines, cells, "page", "line", "cell", 2, 3)
    assert 0 < out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert {r.line: r.cell for r in out.collect()} == {1: 1, 2: None}


def test_best_grid(spark):
    detected = [(p, c, x + 3, y + 1, w, h) for p, c, x, y, w, h in grid(1, 2, 3) + grid(2, 2, 2)]
    grids = [(p, f"{r}x{c}", *b[1:]) for p in (1, 2) for r, c in ((2, 3), (3, 2), (2, 2)) for b in grid(p, r, c)]
    grids = spark.createDataFrame(grids, "page int, grid string, place int, x double, y double, w double, h double")
    found = layout.grid_deviations(spark.createDataFrame(detected, BOX), grids, "page", "cell")
    got = {(r.page, r.grid): round(r.deviation, 3) for r in found.collect()}
    assert got[(1, "2x3")] < 0.2 and got[(1, "3x2")] > 0.5 and got[(1, "2x2")] == 1.0 and got[(2, "2x3")] == 1.0
    assert {(r.page, r.grid) for r in layout.best_grids(found, "page").collect()} == {(1, "2x3"), (2, "2x2")}


def test_global_rank(spark):
    rng = random.Random(2)
    values = [rng.choice([None, *range(300)]) for _ in range(2000)]
    frame = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(7)
    got = {r.id: r.place for r in listing.ranked(frame, [F.col("v"), F.col("id")]).collect()}
    order = sorted(range(2000), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert got == {i: n + 1 for n, i in enumerate(order)}
    assert listing.ranked(frame.limit(0), [F.col("v")]).count() == 0


def test_partial_lookup_has_no_nested_loop(spark):
    keys = spark.createDataFrame([("ab",), ("Q7",), ("zzz",), ("",), ("x1",)], "key string")
    rows = spark.createDataFrame([(1, "xab9"), (2, "AB"), (3, "q77"), (4, "x1"), (5, "aab")], "id int, epic string")
    out = listing.cascade(keys, rows, "key", "id", ["epic"], ["epic"])
    assert {(r.key, r.tier, r.id) for r in out.collect()} == {("ab", 0, 2), ("Q7", 1, 3), ("x1", 0, 4)}
    # one-row tables of frequencies apart, all joins are by a key
    joins = [line for line in out._jdf.queryExecution().sparkPlan().toString().split("\n") if "NestedLoop" in line or "Cartesian" in line]
    assert not any("Contains" in line or "contains" in line for line in joins)
