"""Queries over promotion in full and over the audit of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.operators import audit as A
from registra.operators import promotion as P
from registra.operators.storage import stored

from .bindings import bound, twin

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = twin(sql, *names)
        return f

    return add


RAW = ("raw_records", "raw_pages", "raw_files", "raw_stations", "raw_current")
PLACED = """r AS (
      SELECT r.* REPLACE (upper(regexp_replace(coalesce(r.epic, ''), '[^A-Za-z0-9]', '', 'g')) AS epic, coalesce(relation_name, '') AS relation_name), r.error_count = 0 AS clean, r.is_deleted = 'Yes' AS struck, coalesce(p.page_type = 'supplement_page', false) AS is_supplement,
        coalesce(try_cast(regexp_extract(f.file_name, '(?i)revision\\s*(\\d+)', 1) AS INT), 0) AS revision, f.file_name, s.station_id,
        coalesce(s.part_number, '') AS part_number, CASE WHEN coalesce(s.ac_name, '') <> '' THEN CASE WHEN coalesce(s.ac_number, '') <> '' THEN s.ac_number || '-' || s.ac_name ELSE s.ac_name END ELSE coalesce(p.header_text, '') END AS constituency,
        coalesce(nullif(r.section_name, ''), s.address) AS section
      FROM raw_records r LEFT JOIN raw_pages p USING (page_id) LEFT JOIN raw_files f USING (file_id) LEFT JOIN raw_stations s USING (file_id){where}),
    top AS (SELECT epic, max(revision) AS top FROM r WHERE epic <> '' GROUP BY 1),
    won AS (SELECT epic, record_id AS winner FROM r WHERE epic <> '' QUALIFY row_number() OVER (PARTITION BY epic ORDER BY revision DESC, clean DESC, struck DESC, is_supplement DESC, page_number, idx, record_id) = 1),
    struck AS (SELECT epic, deletion_reason AS stated FROM r JOIN top USING (epic) WHERE struck AND revision = top QUALIFY row_number() OVER (PARTITION BY epic ORDER BY deletion_reason = '', page_number, idx, record_id) = 1),
    d AS (
      SELECT r.*, winner, struck.epic IS NOT NULL AS gone, stated, c.voter_id, c.name AS old_name, CASE WHEN r.epic = '' THEN 'No EPIC number on this record' WHEN r.record_id <> winner THEN 'Superseded by another record for this elector' {skip} END AS refused
      FROM r LEFT JOIN won USING (epic) LEFT JOIN struck USING (epic) LEFT JOIN raw_current c USING (epic)),
    t AS (
      SELECT d.*, try_cast(CASE WHEN regexp_full_match(d.serial, '[0-9]+') THEN d.serial END AS INT) AS n_serial, try_cast(CASE WHEN regexp_full_match(d.age, '[0-9]+') THEN d.age END AS INT) AS n_age,
        CASE WHEN coalesce(stated, '') <> '' THEN stated ELSE d.deletion_reason END AS why FROM d WHERE refused IS NULL)"""
OVERWRITE = PLACED.format(where="", skip="")
SKIP = PLACED.format(where=" WHERE r.error_count = 0 OR r.is_deleted = 'Yes'", skip="WHEN c.epic IS NOT NULL THEN 'EPIC already exists in the voter database'")


def _promotion(spark, sf_dir, only_clean=False, on_conflict="overwrite"):
    records, pages, files, stations, current = (bound(spark, sf_dir, n) for n in RAW)
    rows = P.own_values(P.scoped(records, all_documents=True), only_clean)
    return P.promotion(rows, current, on_conflict, places=(pages, files, stations))


@query(
    f"""WITH {OVERWRITE} SELECT t.epic, t.voter_id, coalesce(n_serial, c.serial) AS serial, t.name, t.relation_type, t.relation_name, t.house_number, coalesce(n_age, c.age) AS age, t.gender, t.part_number, t.constituency, t.gone AS is_deleted, t.why AS deletion_reason,
      coalesce(t.station_id, c.polling_station_id) AS polling_station_id, t.is_supplement, coalesce(t.section, c.section_name) AS section_name, t.record_id AS source_record_id, t.page_id AS source_page_id, t.file_id AS source_file_id, t.file_name AS source_file_name, t.page_number,
      CASE WHEN t.voter_id IS NULL THEN 'created' ELSE 'updated' END AS status FROM t LEFT JOIN raw_current c USING (epic)""",
    *RAW,
)
def r12_promoted_rows(spark, sf_dir):
    return _promotion(spark, sf_dir)["curated"]


CONFLICTS = "SELECT record_id, nullif(epic, '') AS epic, refused AS reason, CASE WHEN refused LIKE 'EPIC already%' THEN voter_id END AS existing_voter_id, CASE WHEN refused LIKE 'EPIC already%' THEN old_name END AS existing_name, name AS incoming_name FROM d WHERE refused IS NOT NULL"


@query(f"WITH {SKIP} {CONFLICTS}", *RAW)
def r12_promotion_conflicts(spark, sf_dir):
    return _promotion(spark, sf_dir, only_clean=True, on_conflict="skip")["conflicts"]


@query(f"WITH {OVERWRITE} SELECT count(*) FILTER (WHERE refused IS NULL AND voter_id IS NULL) AS created, count(*) FILTER (WHERE refused IS NULL AND voter_id IS NOT NULL) AS updated, count(*) FILTER (WHERE refused IS NOT NULL) AS skipped FROM d", *RAW)
def r12_result_counts(spark, sf_dir):
    return _promotion(spark, sf_dir)["counts"]


_CHANGES = {"serial": "n_serial", "name": "t.name", "relation_type": "t.relation_type", "relation_name": "t.relation_name", "house_number": "t.house_number", "age": "n_age", "gender": "t.gender", "part_number": "t.part_number", "constituency": "t.constituency", "is_deleted": "t.gone", "deletion_reason": "t.why"}


@query(
    f"""WITH {OVERWRITE}, ch AS (
      {" UNION ALL ".join(f"SELECT t.epic, t.voter_id, '{c}' AS field_name, c.{c}::VARCHAR AS old_value, ({new})::VARCHAR AS new_value, t.file_id, t.page_id FROM t JOIN raw_current c USING (epic) WHERE {new} IS NOT NULL AND {new} IS DISTINCT FROM c.{c}" for c, new in _CHANGES.items())}
      UNION ALL SELECT epic, NULL, NULL, NULL, trim(epic || ' ' || name), file_id, page_id FROM t WHERE voter_id IS NULL)
    SELECT epic, voter_id, 'promoted' AS action, field_name, old_value, new_value, 'system' AS user, file_id, page_id FROM ch""",
    *RAW,
)
def r12_promotion_audit_rows(spark, sf_dir):
    return _promotion(spark, sf_dir)["audit"]


ROLL = ("roll_documents", "roll_files", "roll_stations", "roll_summaries", "roll_electors")
#: counted one by one in SQL, from the list of mismatches and not from marks
AUDIT = """docs AS (
      SELECT doc, ac, part, coalesce(a.file_id, b.file_id) AS file_id, CASE WHEN a.file_id IS NOT NULL THEN 'name' WHEN b.file_id IS NOT NULL THEN 'pattern' END AS matched_by
      FROM (SELECT doc, regexp_extract(doc, 'AC0*(\\d+)', 1)::INT AS ac, regexp_extract(doc, 'PART-0*(\\d+)', 1)::INT AS part FROM roll_documents) d
      LEFT JOIN roll_files a ON a.name = d.doc LEFT JOIN roll_files b ON regexp_extract(b.name, 'AC0*(\\d+)', 1)::INT = ac AND regexp_extract(b.name, 'PART-0*(\\d+)', 1)::INT = part),
    own AS (SELECT doc, e.* FROM docs JOIN roll_electors e USING (file_id)),
    rows AS (SELECT * FROM own UNION ALL SELECT doc, e.* FROM docs JOIN roll_electors e ON e.part_number = part::VARCHAR AND contains(constituency, ac::VARCHAR) WHERE doc NOT IN (SELECT doc FROM own)),
    n AS (SELECT doc, count(*) AS extracted FROM rows GROUP BY 1),
    totals AS (
      SELECT docs.*, coalesce(extracted, 0) AS extracted, coalesce(CASE WHEN total_electors > 0 THEN total_electors END, CASE WHEN total_voters > 0 THEN total_voters END, CASE WHEN extracted_records > 0 THEN extracted_records END, CASE WHEN serial_end > 0 THEN serial_end END, extracted, 0)::BIGINT AS expected
      FROM docs LEFT JOIN roll_stations USING (file_id) LEFT JOIN roll_summaries USING (file_id) LEFT JOIN n USING (doc)),
    e AS (SELECT *, upper(trim(coalesce(epic, ''))) AS id, row_number() OVER (PARTITION BY doc, serial ORDER BY record_id) AS s FROM rows WHERE serial IS NOT NULL),
    u AS (SELECT record_id, row_number() OVER (PARTITION BY doc, id ORDER BY serial, record_id) AS k FROM e WHERE id NOT IN ('', 'NO_EPIC') AND NOT starts_with(id, 'UNKNOWN')),
    listed AS (
      SELECT doc, page_number, 0 AS serial, 'serial_number' AS field_name, 'NULL' AS db_value, 'Serial number is missing or NULL in DB' AS difference, record_id FROM rows WHERE serial IS NULL
      UNION ALL SELECT doc, page_number, serial, 'serial_duplicate', 'Duplicate Serial #' || serial, 'Duplicate Serial Number found in database', record_id FROM e WHERE s > 1
      UNION ALL SELECT doc, page_number, serial, 'epic_duplicate', 'Duplicate EPIC ' || id, 'Duplicate Voter EPIC Card ID found in part', record_id FROM e JOIN u USING (record_id) WHERE k > 1
      UNION ALL SELECT doc, page_number, serial, 'epic', CASE WHEN coalesce(epic, '') = '' THEN 'EMPTY' ELSE epic END, 'Invalid or unread EPIC format', record_id FROM e WHERE id = '' OR starts_with(id, 'UNKNOWN') OR length(id) < 5
      UNION ALL SELECT doc, page_number, serial, 'name', CASE WHEN coalesce(name, '') = '' THEN 'EMPTY' ELSE name END, 'Empty or missing voter name', record_id FROM e WHERE length(trim(coalesce(name, ''))) < 2
      UNION ALL SELECT doc, page_number, serial, 'age', coalesce(age::VARCHAR, 'NULL'), 'Invalid age: ' || coalesce(age::VARCHAR, 'None'), record_id FROM e WHERE age IS NULL OR age < 18 OR age > 125
      UNION ALL SELECT doc, page_number, serial, 'gender', CASE WHEN coalesce(gender, '') = '' THEN 'EMPTY' ELSE gender END, 'Unrecognized gender: ' || coalesce(gender, 'None'), record_id FROM e WHERE gender IS NULL OR gender NOT IN ('ஆண்', 'பெண்', 'மூன்றாம் பாலினம்', 'Male', 'Female', 'Third Gender')
      UNION ALL SELECT doc, (i - 1) // 30 + 3, i, 'record_presence', 'MISSING IN DATABASE', 'Serial #' || i || ' was printed in PDF roll but is missing in DB', NULL FROM (SELECT doc, unnest(range(1, expected + 1)) AS i FROM totals) x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc = x.doc AND e.serial = i)
      UNION ALL SELECT doc, 0, serial, 'record_presence', 'Serial #' || serial || ' Present in DB', 'Serial #' || serial || ' exceeds summary sheet total count ' || expected, NULL FROM (SELECT DISTINCT doc, serial FROM e) z JOIN totals USING (doc) WHERE expected > 0 AND serial NOT BETWEEN 1 AND expected),
    c AS (
      SELECT doc, count(*) FILTER (WHERE db_value = 'MISSING IN DATABASE') AS missing, count(*) FILTER (WHERE field_name = 'record_presence' AND db_value <> 'MISSING IN DATABASE') AS extra,
        count(DISTINCT record_id) FILTER (WHERE field_name IN ('serial_number', 'epic', 'name', 'age', 'gender')) AS incorrect, count(*) FILTER (WHERE field_name LIKE '%duplicate') AS duplicates FROM listed GROUP BY 1),
    m AS (SELECT t.*, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra, coalesce(incorrect, 0) AS incorrect, coalesce(duplicates, 0) AS duplicates, greatest(0, extracted - coalesce(extra, 0) - coalesce(duplicates, 0) - coalesce(incorrect, 0)) AS matched FROM totals t LEFT JOIN c USING (doc)),
    rated AS (SELECT *, CASE WHEN expected > 0 THEN round(least(100.0::DOUBLE, matched::DOUBLE / expected * 100.0), 2) WHEN extracted > 0 THEN 100.0 ELSE 0.0 END AS pass_rate FROM m),
    report AS (SELECT doc, ac, part, file_id, matched_by, expected, extracted, matched, missing, extra, incorrect, duplicates, pass_rate, CASE WHEN pass_rate >= 98 AND missing = 0 THEN 'PASS' WHEN pass_rate >= 90 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM rated)"""


def _audited(spark, sf_dir):
    documents, files, stations, summaries, electors = (bound(spark, sf_dir, n) for n in ROLL)
    docs = stored(A.printed_totals(A.matched_documents(documents, files), stations, summaries), "matched", large=True)
    return A.audited(docs, electors), docs


@query(f"WITH {AUDIT} SELECT doc, page_number::BIGINT AS page_number, serial::BIGINT AS serial_number, field_name, db_value, difference FROM listed", *ROLL)
def r13_audit_findings(spark, sf_dir):
    marked, docs = _audited(spark, sf_dir)
    # the list reads the marks three times
    return A.mismatches(stored(marked.drop("record_id"), "marked", large=True), docs)


@query(f"WITH {AUDIT} SELECT * FROM report", *ROLL)
def g16_audit_report(spark, sf_dir):
    return A.report(*_audited(spark, sf_dir))


@query(
    f"""WITH {AUDIT}, s AS (SELECT count(*) AS documents, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status <> 'PASS') AS failed, sum(expected)::BIGINT AS expected, sum(extracted)::BIGINT AS extracted, sum(matched)::BIGINT AS matched, sum(missing)::BIGINT AS missing, sum(extra)::BIGINT AS extra, sum(incorrect)::BIGINT AS incorrect, sum(duplicates)::BIGINT AS duplicates FROM report),
    r AS (SELECT *, CASE WHEN expected > 0 THEN round(matched::DOUBLE / expected * 100.0, 2) ELSE 0.0 END AS pass_rate FROM s)
    SELECT *, CASE WHEN pass_rate >= 98 AND missing = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""",
    *ROLL,
)
def g17_audit_summary(spark, sf_dir):
    return A.summary(A.report(*_audited(spark, sf_dir)))


@query(f"WITH {AUDIT} SELECT * FROM report WHERE ac = 12 AND status = 'FAIL'", *ROLL)
def p13_audit_reports_listed(spark, sf_dir):
    return A.listed(A.report(*_audited(spark, sf_dir)), ac=12, status="FAIL")


@query(f"WITH {AUDIT} SELECT doc, ac, part, file_id, matched_by FROM docs", *ROLL)
def j18_documents_to_files(spark, sf_dir):
    return A.matched_documents(bound(spark, sf_dir, "roll_documents"), bound(spark, sf_dir, "roll_files")).select("doc", "ac", "part", "file_id", "matched_by")


@query(
    """SELECT record_id FROM raw_records r JOIN (SELECT DISTINCT page_id FROM raw_pages WHERE page_type = 'supplement_page') USING (page_id)""", "raw_records", "raw_pages"
)
def p20_promotion_scope(spark, sf_dir):
    records, pages = bound(spark, sf_dir, "raw_records"), bound(spark, sf_dir, "raw_pages").filter("page_type = 'supplement_page'")
    wanted = records.join(pages, "page_id", "left_semi").select("record_id")
    return P.scoped(records, record_ids=wanted).select("record_id")
