"""Queries over exports in full, folders, identifiers and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.functions import text as X
from registra.operators import storage
from registra.sources import sinks as K
from registra.sources import tables as T
from registra.streaming import pages as P

from . import roll as R
from .bindings import bound, table, twin
from .storage import RESULTS, _fields, _page_results

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = twin(sql, *names)
        return f

    return add


@query(
    """SELECT l_orderkey AS page, l_linenumber AS idx, l_suppkey AS supp, CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END AS error_count,
    CASE WHEN l_orderkey % 5 = 0 THEN 'e' || l_partkey ELSE l_partkey::VARCHAR END AS part, l_partkey::VARCHAR AS part_ocr, round(1 - l_discount, 4) AS part_confidence,
    CASE WHEN l_orderkey % 5 = 0 THEN 'e' || l_suppkey ELSE l_suppkey::VARCHAR END AS supplier, l_suppkey::VARCHAR AS supplier_ocr, round(1 - l_discount, 4) AS supplier_confidence FROM lineitem"""
)
def k1_export_audit(spark, sf_dir):
    return K.export_table(_fields(spark, sf_dir), ["part", "supplier"], "audit")


@query(
    """SELECT l_orderkey AS page, l_linenumber AS idx, l_partkey AS part, concat_ws('; ', CASE WHEN l_tax > 0.05 THEN 'tax: too high' END, CASE WHEN l_discount > 0.07 THEN 'unusual discount' END,
    CASE WHEN l_quantity < 3 THEN 'quantity: ' || l_returnflag END) AS issues FROM lineitem"""
)
def k2_issue_texts(spark, sf_dir):
    def issue(when, field, message):
        return F.when(when, F.struct(F.lit(field).cast("string").alias("field"), message.alias("message")))

    found = [
        issue(F.col("l_tax") > 0.05, "tax", F.lit("too high")),
        issue(F.col("l_discount") > 0.07, None, F.lit("unusual discount")),
        issue(F.col("l_quantity") < 3, "quantity", F.col("l_returnflag")),
    ]
    issues = K.issue_text(F.filter(F.array(*found), lambda i: i.isNotNull()))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("part"), issues.alias("issues"))


def _relational(spark, sf_dir, name):
    stations = bound(spark, sf_dir, "stations").withColumn("revision", F.lit("final"))
    rows = K.relational_tables(stations, bound(spark, sf_dir, "records"), bound(spark, sf_dir, "electors"))[name]
    return storage.stored(rows, f"export-{name.lower()}")


@query("SELECT file_id AS \"Document_ID\", district AS \"District\", ac_name AS \"Assembly\", part_number AS \"Part\", name AS \"Polling_Station\", 'final' AS \"Revision\" FROM stations", "stations")
def k11_documents(spark, sf_dir):
    return _relational(spark, sf_dir, "Documents")


@query(
    """SELECT file_id AS "Document_ID", page_number AS "Page_No", 'Voter Record Pages' AS "Page_Type", round(avg(mean_confidence), 6) AS "Confidence", file_id || '_P' || page_number AS "Page_ID" FROM records GROUP BY file_id, page_number""",
    "records",
)
def k11_pages(spark, sf_dir):
    return _relational(spark, sf_dir, "Pages")


@query(
    """SELECT id AS "Voter_ID", file_id AS "Document_ID", page_number AS "Page_No", serial::BIGINT AS "Serial_No", epic AS "EPIC", coalesce(name, '') AS "Name", coalesce(relation_name, '') AS "Relative_Name",
    coalesce(relation_type, '') AS "Relation", coalesce(gender, '') AS "Gender", age::BIGINT AS "Age", coalesce(house_number, '') AS "House_No" FROM electors""",
    "electors",
)
def k11_voters(spark, sf_dir):
    return _relational(spark, sf_dir, "Voters")


@query(
    """SELECT file_id AS "Document_ID", count(*) FILTER (WHERE gender = 'Male') AS "Male", count(*) FILTER (WHERE gender = 'Female') AS "Female", count(*) AS "Total",
    count(*) FILTER (WHERE gender IS NULL) AS "Third_Gender" FROM electors GROUP BY 1""",
    "electors",
)
def k11_summary(spark, sf_dir):
    return _relational(spark, sf_dir, "Summary")


@query(
    """SELECT e.page_number::VARCHAR AS "Page_No", e.part_number AS "Part_No", e.serial::VARCHAR AS "Serial_No", e.epic AS "EPIC_ID", coalesce(e.name, '') AS "Name", coalesce(e.relation_type, '') AS "Relation",
    coalesce(e.relation_name, '') AS "Relative_Name", coalesce(e.house_number, '') AS "House_No", coalesce(e.age::VARCHAR, '') AS "Age", coalesce(e.gender, '') AS "Gender", e.constituency AS "Section",
    coalesce(s.name, '') AS "Polling_Station", '0.95' AS "Confidence" FROM electors e LEFT JOIN stations s USING (part_number)""",
    "electors", "stations",
)
def k12_dataset_of_thirteen(spark, sf_dir):
    return K.dataset_columns(bound(spark, sf_dir, "electors"), bound(spark, sf_dir, "stations"))


@query(
    f"""SELECT doc AS "PDF File", ac::VARCHAR AS "AC Number", part AS "Part Number", expected AS "Total PDF Records", extracted AS "Total DB Records", matched AS "Matched",
    missing AS "Missing in DB", extra AS "Extra in DB", incorrect AS "Incorrect", duplicates AS "Duplicates", printf('%.1f', pass_rate) || '%' AS "Pass %", status AS "Status"
    FROM ({R.ORACLE["g16_audit_report"]}) r"""
)
def k14_validation_report(spark, sf_dir):
    report = R.g16_audit_report(spark, sf_dir)
    return K.report_columns(report.select("*", F.col("doc").alias("pdf_file"), F.col("ac").cast("string").alias("ac_number"), F.col("part").alias("part_number"), F.col("status").alias("verdict")))


FILES = """WITH listing AS (SELECT '/in/' || o_custkey % 10 || '/order ' || o_orderkey || '.pdf' AS path, 'order ' || o_orderkey || '.pdf' AS name, round(o_totalprice)::BIGINT AS size_bytes FROM orders),
registered AS (SELECT 'F' || o_orderkey AS file_id, CASE WHEN o_orderkey % 3 = 0 THEN '/in/' || o_custkey % 10 ELSE '/moved' END || '/order ' || o_orderkey || '.pdf' AS stored_path, 'order ' || o_orderkey || '.pdf' AS name,
  o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 2),
counts AS (SELECT 'F' || l_orderkey AS file_id, count(*) AS records, sum(l_quantity) AS ocr_s FROM lineitem GROUP BY 1)"""


def _files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.format_string("order %d.pdf", "o_orderkey")
    folder = F.format_string("/in/%d", F.col("o_custkey") % 10)
    listing = o.select(F.concat_ws("/", folder, name).alias("path"), name.alias("name"), F.round("o_totalprice").cast("long").alias("size_bytes"))
    known = o.filter("o_orderkey % 3 <> 2")
    place = F.concat_ws("/", F.when(F.col("o_orderkey") % 3 == 0, folder).otherwise("/moved"), name)
    registered = known.select(F.format_string("F%d", "o_orderkey").alias("file_id"), place.alias("stored_path"), name.alias("name"), F.col("o_orderstatus").alias("status"))
    return listing, registered


@query(
    f"""{FILES} SELECT l.path, l.name, l.size_bytes, coalesce(p.file_id, n.file_id) AS file_id, coalesce(p.status, n.status, 'new') AS status, coalesce(c.records, 0) AS records, coalesce(c.ocr_s, 0)::DOUBLE AS ocr_s
    FROM listing l LEFT JOIN registered p ON l.path = p.stored_path LEFT JOIN registered n ON l.name = n.name LEFT JOIN counts c ON c.file_id = coalesce(p.file_id, n.file_id)"""
)
def s4_folder_scan(spark, sf_dir):
    listing, registered = _files(spark, sf_dir)
    counts = table(spark, sf_dir, "lineitem").groupBy(F.format_string("F%d", "l_orderkey").alias("file_id")).agg(F.count(F.lit(1)).alias("records"), F.sum("l_quantity").alias("ocr_s"))
    return T.scanned_files(listing, registered, counts)


@query(f"{FILES} SELECT path, l.name, coalesce(file_id, 'F' || md5(path)[1:12]) AS file_id, file_id IS NULL AS is_new FROM listing l LEFT JOIN registered r ON path = stored_path")
def s5_folder_import(spark, sf_dir):
    return T.imported(*_files(spark, sf_dir))


@query(
    """WITH raw AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'a8c-' || lpad(c_custkey::VARCHAR, 7, '0') WHEN 1 THEN 'ABC O' || lpad(c_custkey::VARCHAR, 6, '0') WHEN 2 THEN 'XABC' || lpad(c_custkey::VARCHAR, 7, '0')
      ELSE 'AB' || lpad(c_custkey::VARCHAR, 6, '0') END AS t FROM customer),
    n AS (SELECT id, t, upper(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) AS u FROM raw),
    f AS (SELECT *, translate(u[1:3], '0158', 'OISB') || translate(u[4:10], 'OOIL|SB', '0011158') AS a, translate(u[2:4], '0158', 'OISB') || translate(u[5:11], 'OOIL|SB', '0011158') AS b FROM n),
    ok AS (SELECT *, CASE WHEN regexp_full_match(a, '[A-Z]{3}[0-9]{7}') THEN a END AS x, CASE WHEN regexp_full_match(b, '[A-Z]{3}[0-9]{7}') THEN b END AS y FROM f)
    SELECT id, t AS raw, CASE length(u) WHEN 10 THEN x WHEN 11 THEN coalesce(x, y) END AS repaired, regexp_matches(upper(t), '[A-Z]{2,4}[0-9]{6,9}') AS looks_like_id, regexp_full_match(upper(t), '[A-Z]{3}[0-9]{7}') AS is_canonical FROM ok"""
)
def x6_x8_identifiers(spark, sf_dir):
    k = F.col("c_custkey")
    padded = lambda n: F.lpad(k.cast("string"), n, "0")
    raw = F.when(k % 4 == 0, F.concat(F.lit("a8c-"), padded(7))).when(k % 4 == 1, F.concat(F.lit("ABC O"), padded(6))).when(k % 4 == 2, F.concat(F.lit("XABC"), padded(7))).otherwise(F.concat(F.lit("AB"), padded(6)))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), raw.alias("raw"))
    return rows.withColumns({"repaired": X.identifier(F.col("raw")), "looks_like_id": X.looks_like_id(F.col("raw")), "is_canonical": X.is_canonical_id(F.col("raw"))})


@query(
    """WITH w AS (SELECT id, CASE id % 7 WHEN 0 THEN replace(house_number, '/', ' _ ') || 'b' WHEN 1 THEN house_number || '/3' WHEN 2 THEN ' nil ' ELSE house_number END AS h, house_number AS n FROM electors)
    SELECT id, CASE WHEN id % 7 = 2 THEN 'NIL' WHEN n IS NULL THEN '' ELSE replace(n, '/', '-') || CASE id % 7 WHEN 0 THEN 'B' WHEN 1 THEN '-3' ELSE '' END END AS house,
    n IS NULL OR id % 7 = 2 AS missing, CASE WHEN id % 7 <> 2 THEN replace(n, '/', '-') END AS building FROM w""",
    "electors",
)
def x14_house_numbers(spark, sf_dir):
    n, k = F.col("house_number"), F.col("id") % 7
    written = F.when(k == 0, F.concat(F.regexp_replace(n, "/", " _ "), F.lit("b"))).when(k == 1, F.concat(n, F.lit("/3"))).when(k == 2, F.lit(" nil ")).otherwise(n)
    rows = bound(spark, sf_dir, "electors").select("id", written.alias("h"))
    return rows.select("id", X.normal_house(F.col("h")).alias("house"), X.is_missing_house(F.col("h")).alias("missing"), X.building_key(F.col("h")).alias("building"))


@query(
    f"""WITH {RESULTS}, c AS (SELECT job_id, file_id, sum((status = 'completed')::INT)::BIGINT AS completed, sum((status = 'failed')::INT)::BIGINT AS failed, count(*) AS total, epoch(max(ts)) - epoch(min(ts)) AS spent FROM p GROUP BY 1, 2)
    SELECT job_id, file_id, completed, failed, CASE WHEN spent > 0 THEN round(total / spent, 8) END AS pages_per_s, CASE WHEN spent > 0 THEN round(greatest(150 - total, 0) / (total / spent), 3) END AS eta_s FROM c"""
)
def g26_run_report(spark, sf_dir):
    counts = P.rate(P.progress(_page_results(spark, sf_dir)).withColumn("page_count", F.lit(150)), "page_count")
    return counts.select("job_id", "file_id", "completed", "failed", F.round("pages_per_s", 8).alias("pages_per_s"), F.round("eta_s", 3).alias("eta_s"))
