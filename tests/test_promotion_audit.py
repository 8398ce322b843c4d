"""Promotion, spelling votes, sign repair and the audit on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from registra.functions import text as X
from registra.operators import audit, jobs, promotion

RECORD = "record_id string, page_id string, file_id string, page_number int, idx int, error_count int, epic string, name string, serial string, relation_type string, relation_name string, house_number string, age string, gender string, is_deleted string, deletion_reason string, section_name string"


def record(i, epic, page="p1", file="f1", number=1, idx=1, errors=0, gone="", why="", age="40", serial="7"):
    return (i, page, file, number, idx, errors, epic, f"name {i}", serial, "Father", "x", "1/2", age, "Male", gone, why, "")


def promoted(spark, records, only_clean=False, on_conflict="overwrite", current=()):
    rows = spark.createDataFrame(records, RECORD)
    pages = spark.createDataFrame([("p1", "elector_page", "H" * 300), ("p2", "supplement_page", "")], "page_id string, page_type string, header_text string")
    files = spark.createDataFrame([("f1", "roll Revision1.pdf"), ("f2", "roll revision 2.pdf"), ("f3", "roll.pdf")], "file_id string, file_name string")
    stations = spark.createDataFrame([("f1", "s1", "12", "5", "Town", "Main Street"), ("f2", "s2", "13", "", "Town", None)], "file_id string, station_id string, part_number string, ac_number string, ac_name string, address string")
    kinds = "epic string, voter_id string, serial int, name string, relation_type string, relation_name string, house_number string, age int, gender string, part_number string, constituency string, is_deleted boolean, deletion_reason string, polling_station_id string, is_supplement boolean, section_name string, source_record_id string, source_page_id string, source_file_id string, source_file_name string, page_number int"
    out = promotion.promotion(promotion.placed(rows, pages, files, stations, only_clean), spark.createDataFrame(list(current), kinds), on_conflict)
    return {k: v.collect() for k, v in out.items()}


OLD = ("AB1", "v1", 3, "old name", "Father", "x", "1/2", 33, "Male", "12", "5-Town", False, "", "s0", False, "sec", "r0", "p0", "f0", "", 1)


def test_precedence(spark):
    rows = [
        record("a", "ab-1"), record("b", "AB 1", file="f2"),  # the later revision wins
        record("c", "AB2", errors=1), record("d", "ab2", number=9),  # clean wins over the earlier page
        record("e", "AB3"), record("f", "AB3", page="p2", number=8, gone="Yes", why="Expired"),  # deleted wins
        record("g", "AB4", file="f2"), record("h", "AB4", gone="Yes", why="Shifted"),  # reinstated by the later revision
        record("i", "AB5", number=2), record("j", "AB5", number=3, errors=1, gone="Yes"), record("k", "AB5", number=4, errors=1, gone="Yes", why="Missing"),  # an unclean copy strikes off
        record("l", ""), record("m", " - "), record("n", None, file="f3"), record("o", "AB6", file="f3", age="4O", serial="x1"),
    ]
    out = promoted(spark, rows)
    got = {r.epic: r for r in out["curated"]}
    assert {k: r.source_record_id for k, r in got.items()} == {"AB1": "b", "AB2": "d", "AB3": "f", "AB4": "g", "AB5": "i", "AB6": "o"}
    assert {k: (r.is_deleted, r.deletion_reason) for k, r in got.items() if r.is_deleted} == {"AB3": (True, "Expired"), "AB5": (True, "Missing")}
    assert got["AB3"].is_supplement and not got["AB1"].is_supplement
    assert (got["AB1"].constituency, got["AB2"].constituency, got["AB6"].constituency) == ("Town", "5-Town", "H" * 255)
    assert (got["AB2"].section_name, got["AB1"].section_name, got["AB6"].part_number, got["AB6"].age, got["AB6"].serial) == ("Main Street", None, "", None, None)
    reasons = {r.record_id: r.reason for r in out["conflicts"]}
    assert set(reasons) == set("acehjklmn") and {reasons[x] for x in "lmn"} == {promotion.NO_ID} and reasons["a"] == promotion.LOST
    assert tuple(out["counts"][0]) == (6, 0, 9)
    assert all(r.voter_id is None and r.field_name is None and r.new_value.startswith(r.epic) for r in out["audit"]) and len(out["audit"]) == 6


def test_conflicts_and_changes(spark):
    rows = [record("a", "AB1", age="x", gone="Yes", why="Expired"), record("b", "AB2", errors=1), record("c", "AB3", errors=1, gone="Yes")]
    out = promoted(spark, rows, current=[OLD])
    row = next(r for r in out["curated"] if r.epic == "AB1")
    assert (row.status, row.voter_id, row.age, row.serial, row.name) == ("updated", "v1", 33, 7, "name a")  # an unread age keeps the old one
    changes = {r.field_name: (r.old_value, r.new_value) for r in out["audit"] if r.epic == "AB1"}
    assert changes == {"serial": ("3", "7"), "name": ("old name", "name a"), "is_deleted": ("false", "true"), "deletion_reason": ("", "Expired")}
    out = promoted(spark, rows, only_clean=True, on_conflict="skip", current=[OLD])
    assert [r.epic for r in out["curated"]] == ["AB3"]  # a deletion passes although it is not clean
    assert [(r.record_id, r.reason, r.existing_voter_id, r.existing_name) for r in out["conflicts"]] == [("a", promotion.THERE, "v1", "old name")]
    assert tuple(out["counts"][0]) == (1, 0, 1)
    assert tuple(promoted(spark, [])["counts"][0]) == (0, 0, 0)
    frame = spark.createDataFrame(rows, RECORD)
    assert promotion.scoped(frame, page_id="p1").count() == 3 and promotion.scoped(frame, file_id="f9").count() == 0
    assert promotion.scoped(frame, record_ids=frame.limit(1).union(frame.limit(1))).count() == 1
    with pytest.raises(ValueError):
        promotion.scoped(frame)


def votes(spark, counts):
    rows = [("f", w, 0.5) for w, n in counts.items() for _ in range(n)]
    words = spark.createDataFrame(rows, "scope string, word string, conf double")
    return [r.winner for r in jobs.consensus(words, "scope", "word", X.skeleton(F.col("word"), "[aeiouäö]"), "conf", "ao", "äö").collect()]


def test_spelling_votes(spark):
    assert votes(spark, {"kanal": 3, "kanil": 1}) == ["kanal"]
    assert votes(spark, {"kanal": 5, "kanil": 2}) == []  # below three times the votes
    assert votes(spark, {"kanal": 1, "kanil": 1}) == [] and votes(spark, {"kanal": 9}) == []
    assert votes(spark, {"kanäl": 5, "kanal": 6}) == ["kanäl"]  # ranked first by its long sign, 0.8 of the votes are enough
    assert votes(spark, {"känäl": 4, "kenel": 3}) == []  # weighted 6 to 3, but no repair: votes decide
    assert votes(spark, {"känäl": 3, "kenel": 4}) == []


def test_suggestions_never_touch_originals(spark):
    fields = spark.createDataFrame([(1, "f", "kanil", None), (2, "f", "kanal", None), (3, "f", "odd", "kunal"), (4, "f", None, " ")], "id int, scope string, original_value string, edited_value string")
    winners = spark.createDataFrame([("f", "knl", "kanal")], "scope string, skeleton string, winner string")
    skeleton = X.skeleton(F.col("_v"), "[aeiou]")
    got = {r.id: (r.original_value, r.edited_value, r.suggested_value) for r in jobs.harmonised(fields, winners, "scope", skeleton).collect()}
    assert got == {1: ("kanil", "kanal", "kanal"), 2: ("kanal", None, None), 3: ("odd", "kanal", "kanal"), 4: (None, " ", None)}
    kept = {r.id: (r.edited_value, r.spelling_issue) for r in jobs.harmonised(fields, winners, "scope", skeleton, apply=False).collect()}
    assert kept[1] == (None, "Majority spelling across this batch is 'kanal' (OCR read 'kanil')") and kept[3][0] == "kunal"


def test_signs_are_composed_from_left_to_right(spark):
    cases = {"கெொ": "கோ", "கெ" + "ா": "கொ", "காெ": "கெ", "கி" + "ி" + "ு": "கு", "abc": "abc", "": "", "க" + "ெெே": "க" + "ே"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.repaired_signs(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in got} == cases


def test_audit_thresholds(spark):
    rows = []
    for doc, n, bad in (("a", 100, 0), ("b", 100, 1), ("c", 100, 9), ("d", 100, 30), ("e", 0, 0), ("f", 49, 0)):
        rows += [(doc, f"{doc}{i}", i + 1, f"EPIC{i:04}", "Some Name" if i >= bad else "", 30, "Male", 3) for i in range(n)]
    rows += [("g", "g1", 1, "EPIC1", "Name", 30, "Male", 3), ("g", "g2", 1, "epic1 ", "Name", 17, "x", None), ("g", "g3", None, "EPIC1", "Name", 30, "Male", 3), ("g", "g4", 9, None, None, None, None, 3)]
    electors = spark.createDataFrame(rows, "doc string, record_id string, serial int, epic string, name string, age int, gender string, page_number int")
    totals = spark.createDataFrame([("a", 100, 100), ("b", 100, 100), ("c", 100, 100), ("d", 100, 100), ("e", 5, 0), ("f", 50, 49), ("g", 2, 4), ("h", 0, 0)], "doc string, expected long, extracted long")
    marked = audit.marked_electors(electors, totals)
    reports = audit.report(marked, totals)
    got = {r.doc: (r.matched, r.missing, r.extra, r.incorrect, r.duplicates, r.pass_rate, r.status) for r in reports.collect()}
    assert got["a"] == (100, 0, 0, 0, 0, 100.0, "PASS") and got["b"] == (99, 0, 0, 1, 0, 99.0, "PASS")
    assert got["c"][5:] == (91.0, "PARTIAL") and got["d"][5:] == (70.0, "FAIL") and got["e"] == (0, 5, 0, 0, 0, 0.0, "FAIL")
    assert got["f"] == (49, 1, 0, 0, 0, 98.0, "PARTIAL") and got["h"] == (0, 0, 0, 0, 0, 0.0, "FAIL")
    assert got["g"] == (0, 1, 1, 3, 2, 0.0, "FAIL")  # a repeated number and a repeated identifier of one row both count
    found = sorted((r.serial_number, r.field_name) for r in audit.mismatches(marked, totals).filter("doc = 'g'").collect())
    assert found == sorted([(0, "serial_number"), (1, "serial_duplicate"), (1, "epic_duplicate"), (1, "age"), (1, "gender"), (2, "record_presence"), (9, "record_presence"), (9, "epic"), (9, "name"), (9, "age"), (9, "gender")])
    whole = audit.summary(reports).first()
    assert (whole.documents, whole.passed, whole.failed, whole.matched, whole.pass_rate, whole.status) == (8, 2, 6, 409, 89.5, "FAIL")
    assert {r.doc for r in audit.listed(reports, status="FAIL", search="G").collect()} == {"g"}


def test_documents_find_files_and_electors(spark):
    docs = spark.createDataFrame([("AC001-PART-2.pdf",), ("AC001-PART-286.pdf",), ("AC003-PART-7.pdf",)], "doc string")
    files = spark.createDataFrame([("F1", "AC001-PART-2.pdf"), ("F2", "AC001-PART-286 v2.pdf")], "file_id string, name string")
    found = audit.matched_documents(docs, files)
    assert {r.doc: (r.file_id, r.matched_by) for r in found.collect()} == {"AC001-PART-2.pdf": ("F1", "name"), "AC001-PART-286.pdf": ("F2", "pattern"), "AC003-PART-7.pdf": (None, None)}
    people = spark.createDataFrame([("x", "F1", "9", ""), ("y", None, "7", "003 - North"), ("z", None, "7", "5 - South"), ("w", None, "2", "1")], "record_id string, file_id string, part_number string, constituency string")
    assert sorted((r.doc, r.record_id) for r in audit.electors_of(found, people).collect()) == [("AC001-PART-2.pdf", "x"), ("AC003-PART-7.pdf", "y")]
