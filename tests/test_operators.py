"""Operators on small tables, with the cases that rules turn on."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from registra.operators import audit, household, infographic, jobs, joins, layout, listing, mutations, windows
from registra.sources import sinks, tables

SF = "/root/testdata/sf0.001"


def test_entry_and_contract(spark):
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_spec_is_checked(spark):
    with pytest.raises(ValueError):
        infographic.Spec("no such metric", "gender").checked()
    assert infographic.Spec("voter_count", "gender", {"colour": 1, "gender": "Male"}, 99).checked() == infographic.Spec("voter_count", "gender", {"gender": "Male"}, 12)


def test_age_bands(spark):
    df = spark.createDataFrame([(a,) for a in (None, 0, 17, 18, 25, 26, 60, 61, 99, 121)], "age int")
    bands = [tuple(r) for r in df.select(infographic.age_band(F.col("age")), infographic.decade(F.col("age"))).collect()]
    assert bands == [("Unknown", None), ("Unknown", "0-9"), ("Unknown", "10-19"), ("18-25", "10-19"), ("18-25", "20-29"), ("26-40", "20-29"), ("41-60", "60-69"), ("60+", "60-69"), ("60+", "90+"), ("60+", "90+")]


def test_page_refuses_unknown_sort(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 4)], "id int, age int")
    assert [r.id for r in listing.page(df, "age", "id", ["age"]).collect()] == [1, 3, 2]
    with pytest.raises(ValueError):
        listing.page(df, "name", "id", ["age"])


def test_range_join_equals_the_plain_one(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 2), rng.choice([None, *range(-40, 80)])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, part int, serial int")
    got = {(r.a, r.b) for r in joins.near_numbers(df, "part", "serial", "id", 15).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and None not in (a[2], b[2]) and abs(a[2] - b[2]) <= 15}
    assert got == want


def test_either_join_keeps_unmatched_and_counts_pairs_once(spark):
    a = spark.createDataFrame([(1, 1, 1), (2, 9, 9), (3, 1, None)], "l int, x int, y int")
    b = spark.createDataFrame([(10, 1, 1), (11, 2, 1)], "r int, u int, v int")
    got = {(r.l, r.r) for r in joins.either_join(a, b, "l", "r", (["x"], ["u"]), (["y"], ["v"])).collect()}
    assert got == {(1, 10), (1, 11), (2, None), (3, 10)}


def test_bands_measure_from_their_first_value(spark):
    df = spark.createDataFrame([("p", str(i), float(v)) for i, v in enumerate([0, 6, 11, 12, 30])], "page string, line string, y double")
    got = {r.line: r.band for r in layout.banded(df, "page", "y", "line", 10.0).collect()}
    assert got == {"0": 1, "1": 1, "2": 2, "3": 2, "4": 3}


def test_candidates_precedence(spark):
    rows = [
        ("a", "E", 1, True, True, False, 1, 1, "old"), ("b", "E", 2, True, False, False, 5, 1, ""), ("c", "E", 2, False, True, False, 1, 1, ""), ("d", "E", 2, False, True, True, 2, 1, "moved"),
        ("e", "G", 1, False, False, False, 1, 2, ""), ("f", "G", 1, False, False, False, 1, 1, ""),
    ]
    df = spark.createDataFrame(rows, "record_id string, epic string, revision int, is_clean boolean, is_deleted boolean, is_supplement boolean, page_number int, idx int, reason string")
    got = {r.epic: (r.record_id, r.deleted, r.first_reason) for r in windows.pick_candidates(df).collect()}
    assert got == {"E": ("b", True, "moved"), "G": ("f", False, "")}


def test_agreed_readings(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 30), ("a", 3, 30), ("b", 1, 30), ("b", 2, 31), ("b", 3, 30), ("c", 1, 30)], "cell string, seq int, reading int")
    assert [tuple(r) for r in jobs.agreed_readings(df, "cell", "seq", "reading").collect()] == [("a", 30)]


def test_upsert_is_idempotent(spark):
    now = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "k int, t int, v string")
    new = spark.createDataFrame([(2, 1, "z"), (2, 2, "w"), (3, 1, "q")], "k int, t int, v string")
    once = mutations.upsert(now, new, ["k"], [F.desc("t")])
    twice = mutations.upsert(once, new, ["k"], [F.desc("t")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 0, "x"), (2, 2, "w"), (3, 1, "q")]


def test_issue_text(spark):
    df = spark.createDataFrame([([("age", "odd"), (None, "bad")],), ([],)], "i array<struct<field:string,message:string>>")
    assert [r[0] for r in df.select(sinks.issue_text(F.col("i"))).collect()] == ["age: odd; bad", ""]


def test_folder_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.pdf", "sub/b.pdf", "c.txt"):
        (tmp_path / n).write_bytes(b"12345")
    listing_ = tables.folder_listing(spark, str(tmp_path))
    assert sorted((r.name, r.size_bytes) for r in listing_.collect()) == [("a.pdf", 5), ("b.pdf", 5)]
    path = listing_.filter("name = 'a.pdf'").first().path
    known = spark.createDataFrame([("F1", "a.pdf", path), ("F2", "b.pdf", "elsewhere")], "file_id string, name string, stored_path string")
    assert sorted((r.name, r.file_id) for r in tables.matched_files(listing_, known).collect()) == [("a.pdf", "F1"), ("b.pdf", "F2")]
    assert [r.name for r in tables.unregistered(listing_, known).collect()] == ["b.pdf"]


#: what confines a SQL twin to a share of the rows


def test_numbers_and_chains_have_no_bound(spark):
    groups = spark.createDataFrame([("a", 150_000), ("b", 0)], "doc string, expected int")
    rows = spark.range(1, 150_003).filter("id not in (5, 149999)").select(F.lit("a").alias("doc"), F.col("id").cast("int").alias("serial"), F.col("id").cast("string").alias("record_id"), F.concat(F.lit("EPIC"), "id").alias("epic"), F.lit(40).alias("age"), F.lit("Some Name").alias("name"), F.lit("Male").alias("gender"), F.lit(3).alias("page_number"))
    totals = groups.withColumn("extracted", F.lit(150_000).cast("long"))
    marked = audit.marked_electors(rows, totals)
    found = {(r.doc, r.serial_number, r.field_name, r.db_value[:7]) for r in audit.mismatches(marked, totals).collect()}
    assert found == {("a", 5, "record_presence", "MISSING"), ("a", 149_999, "record_presence", "MISSING"), ("a", 150_001, "record_presence", "Serial "), ("a", 150_002, "record_presence", "Serial ")}
    assert {(r.doc, r.missing, r.extra, r.status) for r in audit.report(marked, totals).collect()} >= {("a", 2, 2, "PARTIAL")}
    chain = [(i, i + 1) for i in range(700)] + [(1000, 1001), (1001, 1002), (1002, 1000), (999, 1000)]
    nodes = spark.createDataFrame([*chain, (700, None)], "node long, up long")
    ends = {r.node: (r.root, r.steps) for r in household.chased(nodes).collect()}
    assert ends == {**{i: (700, 700 - i) for i in range(701)}, **{i: (None, None) for i in (999, 1000, 1001, 1002)}}
    assert {(r.node, r.ring) for r in household.ring_members(nodes.filter("up is not null")).collect()} == {(i, 1000) for i in (1000, 1001, 1002)}


def test_folder_scan_and_import(spark):
    listing = spark.createDataFrame([("/a/1.pdf", "1.pdf", 5), ("/b/2.pdf", "2.pdf", 6), ("/b/3.pdf", "3.pdf", None)], "path string, name string, size_bytes long")
    known = spark.createDataFrame([("F1", "/a/1.pdf", "1.pdf", "done"), ("F2", "/old/2.pdf", "2.pdf", "pending")], "file_id string, stored_path string, name string, status string")
    counts = spark.createDataFrame([("F1", 7, 1.5)], "file_id string, records long, ocr_s double")
    got = {r.name: (r.file_id, r.status, r.records, r.ocr_s) for r in tables.scanned_files(listing, known, counts).collect()}
    assert got == {"1.pdf": ("F1", "done", 7, 1.5), "2.pdf": ("F2", "pending", 0, 0.0), "3.pdf": (None, "new", 0, 0.0)}
    new = {r.name: (r.file_id, r.is_new) for r in tables.imported(listing, known).collect()}
    assert new["1.pdf"] == ("F1", False) and new["2.pdf"][1] and new["3.pdf"][1] and len({f for f, _ in new.values()}) == 3
    assert tables.imported(listing.limit(0), known).count() == 0


def test_relational_tables_cast_digits_only(spark):
    stations = spark.createDataFrame([("F1", "D", "A", "1", "S", "r")], "file_id string, district string, ac_name string, part_number string, name string, revision string")
    records = spark.createDataFrame([("F1", 2, 0.5), ("F1", 2, 1.0), ("F1", 3, None)], "file_id string, page_number int, mean_confidence double")
    people = [(1, "F1", 2, "12", "E1", "n", None, None, "Male", "4O", None), (2, "F1", 2, None, None, None, None, None, None, "40", "1/2")]
    columns = "id long, file_id string, page_number int, serial string, epic string, name string, relation_name string, relation_type string, gender string, age string, house_number string"
    got = sinks.relational_tables(stations, records, spark.createDataFrame(people, columns))
    assert {r.Page_ID: r.Confidence for r in got["Pages"].collect()} == {"F1_P2": 0.75, "F1_P3": None}
    assert {(r.Voter_ID, r.Serial_No, r.Age, r.House_No) for r in got["Voters"].collect()} == {(1, 12, None, ""), (2, None, 40, "1/2")}
    assert [(r.Male, r.Female, r.Third_Gender, r.Total) for r in got["Summary"].collect()] == [(1, 0, 1, 2)]
    assert got["Documents"].count() == 1
