"""What a step shuffles, broadcasts or reads twice; the results are tested elsewhere."""

import pytest
from pyspark.sql import functions as F

from registra import plans
from registra.functions import similarity
from registra.functions.similarity import one_decimal
from registra.operators import audit, joins, labels, layout, mutations, promotion, similar, summary
from registra.operators.storage import dropped, stored

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_range_pairs_meet_no_further_join(spark):
    # a semi join after the pairs shuffled all of them
    plan = _plan(plans.QUERIES["j12_serial_range"](spark, SF))
    assert "LeftSemi" not in plan
    assert "_bucket" in next(line for line in plan.splitlines() if "Join" in line)


def test_either_join_shuffles_no_pairs(spark):
    # pairs were made different by a shuffle and joined to both sides again
    a = spark.createDataFrame([(1, 1, 1), (1, 5, 7), (2, 9, None)], "l int, x int, y int")
    b = spark.createDataFrame([(10, 1, 1), (11, 2, 1), (12, 5, None)], "r int, u int, v int")
    out = joins.either_join(a, b, "l", "r", (["x"], ["u"]), (["y"], ["v"]))
    assert sorted((r.l, r.x, r.r or 0) for r in out.collect()) == [(1, 1, 10), (1, 1, 11), (1, 5, 12), (2, 9, 0)]
    heads = [line for line in _plan(out).splitlines() if "Join" in line or "Aggregate" in line]
    assert "Join" in heads[0]


def test_name_indexes_are_not_broadcast(spark):
    # their files are small, the rows made of them are not, and the driver held them
    rows = spark.createDataFrame([("p", n) for n in ("mani", "manik", "arul", "arun", "perumal")], "part string, name string")
    left, right = rows.withColumnRenamed("name", "a"), rows.withColumnRenamed("name", "b")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert {(r.a, r.b) for r in similar.matching_names(left, right, ["part"], "a", "b").collect()} >= {("mani", "manik"), ("arul", "arun")}
    joins_of = [line for i in range(before, store.executionsCount()) for line in store.executionsList().apply(i).physicalPlanDescription().splitlines()]
    assert any("SortMergeJoin" in line for line in joins_of)
    assert not any("BroadcastHashJoin" in line for line in joins_of)


def test_large_tables_between_steps_are_not_broadcast(spark):
    # tables of people and links were broadcast by the size of their files
    df = spark.createDataFrame([(1, 2), (2, None)], "node int, up int")
    out = stored(df, "probe", large=True)
    other = spark.range(5)
    plan = other.join(out, other["id"] == out["node"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    dropped(out)


def test_pass_rate_is_written_as_by_printf(spark):
    # 6.25 became 6.3
    rows = spark.createDataFrame([(6.25,), (6.75,), (0.15,), (100.0,), (None,)], "x double")
    assert [r.s for r in rows.select(one_decimal("x").alias("s")).collect()] == ["6.2", "6.8", "0.1", "100.0", None]


def test_labels_of_many_lines_are_found_at_once(spark, monkeypatch):
    # F8: each window of each line was scored by itself; small pieces must give the same
    texts, names = ["", "licens", "all rihgts reserved. licence", "x licen", "se y", "e mail addres", "Lizenz: li cense "], ["all rights reserved", "license", ""]
    scored = []
    monkeypatch.setattr(labels, "indel", lambda a, b: scored.append((a, b)) or similarity.indel(a, b))
    got = labels.find_labels(texts * 3, names, 80.0)
    assert len(scored) == len(set(scored))
    monkeypatch.setattr(labels, "LETTERS", 5)
    monkeypatch.setattr(labels, "PLACES", 3)
    assert got == labels.find_labels(texts * 3, names, 80.0) == [labels.find_label(t, names, 80.0) for t in texts] * 3
    want = []
    for t in texts:
        windows = [(-similarity.indel(n, t[s : s + w]), i, s, w) for i, n in enumerate(names) if n for s in range(max(1, len(t) - len(n) + 2)) for w in range(len(n) - 1, len(n) + 3) if t[s : s + w].strip()]
        top = min(windows, default=(0, 0, 0, 0))
        want.append((names[top[1]], -top[0], top[2], min(len(t), top[2] + top[3])) if -top[0] >= 80.0 else None)
    assert got[: len(texts)] == want


def test_bands_of_numbers_take_one_shuffle_without_texts(spark):
    # whole lines were shuffled to the bands and their numbers once more to the groups
    rows = [("a", f"{y}{x}", str(y * 10 + x), float(x), float(y), 5.0, 2.0) for y in (1, 9) for x in range(3 if y == 9 else 2)]
    out = summary.number_bands(spark.createDataFrame(rows, "file_id string, line_id string, text string, x double, y double, w double, h double"), 3)
    plan = _plan(out)
    moved = [line for line in plan.splitlines() if "Repartition" in line]
    assert len(moved) == 1 and "Aggregate" not in plan
    assert [(r.file_id, r.cy, r.numbers) for r in out.collect()] == [("a", 10.0, [90, 91, 92])]


@pytest.fixture
def shuffled(spark):
    """No side is broadcast for its size, as with large tables."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, old)


def test_summaries_shuffle_pages_with_their_lines_once(spark, shuffled):
    # round 4, F3: lines, numbers, bands and labels were shuffled, written and joined one after the other
    plan = plans.QUERIES["r10_summary_rows"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert "Join" not in plan and plan.count("Scan") == 1


def test_records_meet_pages_and_stations_only_if_they_win(spark, monkeypatch):
    # All records were joined to pages, files and stations with all their values, and written
    written = []
    monkeypatch.setattr(promotion, "stored", lambda df, *a, **k: written.append(df.columns) or stored(df, *a, **k))
    plan = _plan(plans.QUERIES["r12_promotion_conflicts"](spark, SF))
    assert "ac_name" not in plan and "header" not in plan.lower()
    assert written and not {"name", "gender", "section_name"} & set(written[0])
    heads = [line for line in _plan(plans.QUERIES["r12_promoted_rows"](spark, SF)).splitlines() if "Join" in line]
    assert "source_file_id" in heads[0] and "source_page_id" in heads[2] and "epic" in heads[3]


def test_promotion_is_the_same_with_early_and_late_places(spark):
    kinds = "record_id string, page_id int, file_id string, page_number int, idx int, error_count int, epic string, name string, serial string, relation_type string, relation_name string, house_number string, age string, gender string, is_deleted string, deletion_reason string, section_name string"
    rows = [(f"r{i % 37}", i % 5, f"f{i % 4}", i % 3 or None, i % 2, (i // 2) % 2 if i % 11 else None, ["", "a1", "A-1", "b", None, "c"][i % 6], f"n{i}", str(i), "", None, "1", "40", "Male", "Yes" if i % 7 == 0 else "", "gone" if i % 14 == 0 else "", "s" if i % 3 else "") for i in range(80)]
    records = spark.createDataFrame([*rows, (None, *rows[1][1:])], kinds)
    pages = spark.createDataFrame([(0, "supplement_page", "h0"), (1, "elector_page", None), (2, "supplement_page", "h2")], "page_id int, page_type string, header_text string")
    files = spark.createDataFrame([("f0", "x Revision2"), ("f1", "x revision 2"), ("f2", None)], "file_id string, file_name string")
    stations = spark.createDataFrame([("f0", "s", "1", "", "T", None), ("f3", "t", "2", "5", "", "st")], "file_id string, station_id string, part_number string, ac_number string, ac_name string, address string")
    current = promotion.promotion(promotion.placed(records.limit(0), pages, files, stations), spark.sql("select 'B' epic, 'v' voter_id, " + ", ".join(f"cast(null as {t}) {c}" for c, t in {**dict.fromkeys(promotion.VALUES[1:], "string"), "serial": "int", "age": "int", "is_deleted": "boolean", "is_supplement": "boolean", "page_number": "int", "source_page_id": "int"}.items())))  # only its schema is of use
    register = current["curated"].drop("status").union(spark.sql("select 'B', 'v', " + ", ".join(f"cast(null as {f.dataType.simpleString()})" for f in current["curated"].schema[2:-1])))
    for clean, way in ((False, "overwrite"), (True, "skip")):
        early = promotion.promotion(promotion.placed(records, pages, files, stations, clean), register, way)
        late = promotion.promotion(promotion.own_values(records, clean), register, way, places=(pages, files, stations))
        for k in early:
            assert sorted(map(str, early[k].collect())) == sorted(map(str, late[k].select(*early[k].columns).collect())), k


def test_electors_are_marked_where_they_meet_their_document(spark, shuffled):
    # electors were shuffled by file twice, by part, and once more by document with all their texts
    docs = spark.createDataFrame([("d1", 1, 1, "f1", 3), ("d2", 1, 2, "f2", None), ("d3", 3, 3, None, None), ("d4", 4, 4, None, None)], "doc string, ac int, part int, file_id string, printed long")
    people = [("a", "f1", "9", "", 1, "EPIC1", "Name", 30, "Male", 1), ("b", "f1", "9", "", 1, " epic1", "Name", 30, "x", 1), ("c", "f1", "9", "", None, "EPIC1", None, None, None, None), ("d", "f2", "2", "1", 5, "EPIC1", "Name", 17, "Male", 1), ("e", None, "3", "no 3", 2, "", "N", 30, "Male", 1), ("f", None, "4", "no 5", 2, "", "N", 30, "Male", 1)]
    electors = spark.createDataFrame(people, "record_id string, file_id string, part_number string, constituency string, serial int, epic string, name string, age int, gender string, page_number int")
    marked = audit.audited(docs, electors)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc" not in plan and "hashpartitioning(file_id" in plan
    totals = docs.drop("printed").join(spark.createDataFrame([("d1", 3, 3), ("d2", 1, 1), ("d3", 1, 1), ("d4", 0, 0)], "doc string, expected long, extracted long"), "doc")
    plain = audit.marked_electors(audit.electors_of(docs.drop("printed"), electors), totals)
    texts = lambda df: sorted(map(str, df.collect()))
    assert texts(audit.mismatches(marked, docs)) == texts(audit.mismatches(plain, totals))
    got = audit.report(marked, docs)
    assert texts(got) == texts(audit.report(plain, totals).select(*got.columns))
    assert {r.doc: (r.expected, r.extracted, r.missing, r.extra, r.duplicates) for r in got.collect()} == {"d1": (3, 3, 2, 0, 2), "d2": (1, 1, 1, 1, 0), "d3": (1, 1, 1, 1, 0), "d4": (0, 0, 0, 0, 0)}


def test_shared_grids_meet_cells_without_a_row_for_each_page_and_place(spark, shuffled):
    # the places of three grids were generated for each page and shuffled to its cells
    box = "page int, cell int, x double, y double, w double, h double"
    cells = spark.createDataFrame([(p, c, float(c % 2 * 11 + (p or 0)), float(c // 2 * 11), 10.0, 10.0) for p in (1, 2, None) for c in range(4 if p != 2 else 3)], box)
    grids = spark.createDataFrame([(g, c, float(c % 2 * 10), float(c // 2 * 10), 10.0, 10.0) for g, n in (("2x2", 4), ("3", 3), ("6", 6)) for c in range(n)], "grid string, place int, x double, y double, w double, h double")
    shared = layout.grid_deviations(cells, grids, "page", "cell")
    own = layout.grid_deviations(cells, cells.select("page").filter("page is not null").distinct().crossJoin(grids), "page", "cell")
    rows = lambda df: sorted((r.page, r.grid, round(r.deviation, 12)) for r in df.collect())
    assert rows(shared) == rows(own) and len(rows(own)) == 6
    assert "SortMergeJoin" not in shared._jdf.queryExecution().executedPlan().toString()


def test_marked_rows_are_not_sorted(spark, shuffled, monkeypatch):
    # rows with all their values were sorted to meet the ids
    monkeypatch.setattr(mutations, "IDS", 1)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "id int, v string")
    out = mutations.marked(rows, spark.createDataFrame([(2,), (2,), (None,)], "id int"), "id", {"v": F.lit("x")})
    assert sorted(map(str, out.collect())) == sorted(["Row(id=1, v='a')", "Row(id=2, v='x')", "Row(id=None, v='c')", "Row(id=2, v='x')"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort [" not in plan
