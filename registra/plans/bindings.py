"""Bindings of the register's tables to the driver's tables.

Each binding is one SQL text in the dialect that Spark and DuckDB share, so that a query and its SQL
twin read the same rows; the operators themselves are written with the DataFrame API.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    # one curated elector a customer
    "electors": """
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 97 = 0 THEN concat('X', CAST(c_custkey AS VARCHAR(20))) ELSE concat('ABC', lpad(CAST(c_custkey AS VARCHAR(20)), 7, '0')) END AS epic,
       CAST(c_custkey % 400 + 1 AS INT) AS serial, CASE WHEN c_custkey % 83 = 0 THEN '' ELSE c_name END AS name,
       CASE c_custkey % 4 WHEN 0 THEN 'Father' WHEN 1 THEN 'Mother' WHEN 2 THEN 'Husband' END AS relation_type,
       concat('Customer#', lpad(CAST(c_custkey % 60 AS VARCHAR(20)), 9, '0')) AS relation_name,
       CASE WHEN c_custkey % 71 = 0 THEN NULL ELSE concat(CAST(c_custkey % 50 AS VARCHAR(20)), '/', CAST(c_custkey % 3 AS VARCHAR(20))) END AS house_number,
       CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE CAST(14 + c_custkey % 90 AS INT) END AS age,
       CASE WHEN c_custkey % 53 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
       CAST(c_nationkey AS VARCHAR(20)) AS part_number,
       concat(CAST(n_regionkey AS VARCHAR(20)), ' - ', r_name) AS constituency,
       c_acctbal > 0 AS verified, c_custkey % 7 = 0 AS is_supplement, c_custkey % 11 = 0 AS is_deleted,
       CAST(floor(c_custkey / 30.0) AS INT) AS page_number, concat('F', CAST(c_nationkey AS VARCHAR(20))) AS file_id, c_acctbal AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    # eight residents a house: two old, their son with his wife, three of the next generations and one more;
    # spelling of house and names, ages and sexes are damaged here and there
    "residents": """
SELECT id, part_number, serial, name, relation_type,
       CASE WHEN m = 0 AND hh % 7 <> 3 THEN 'Someone Elsewhere' WHEN m = 7 AND hh % 2 = 1 THEN NULL
            WHEN hh % 5 = 0 THEN concat('Father Name : ', replace(rel, 'a', 'e')) WHEN hh % 5 = 1 THEN substr(rel, 1, length(rel) - 2) WHEN hh % 5 = 2 THEN concat(rel, ' .') ELSE rel END AS relation_name,
       CASE WHEN hh % 7 = 3 THEN NULL WHEN hh % 19 = 5 AND m = 2 THEN 80 ELSE CAST(CASE m WHEN 0 THEN 76 + hh % 9 WHEN 1 THEN 70 + hh % 5 WHEN 2 THEN 55 + hh % 5 WHEN 3 THEN 50 WHEN 4 THEN 36 + hh % 4 WHEN 5 THEN 30 WHEN 6 THEN 18 + hh % 5 ELSE 44 END AS INT) END AS age,
       CASE WHEN hh % 11 = 5 THEN NULL WHEN hh % 13 = 2 AND m = 3 THEN 'Male' WHEN m = 7 AND hh % 3 = 0 THEN 'Third Gender' WHEN m % 2 = 0 THEN 'M' ELSE 'Female' END AS gender,
       CASE WHEN hh % 9 = 4 THEN CASE m % 3 WHEN 0 THEN NULL WHEN 1 THEN ' 0 ' ELSE 'Na' END
            ELSE concat(CAST(hh % 50 + 1 AS VARCHAR(20)), CASE m % 3 WHEN 0 THEN '-' WHEN 1 THEN ' / ' ELSE '.' END, CAST(hh % 4 + 1 AS VARCHAR(20)), CASE WHEN m = 5 THEN 'a' WHEN m = 6 THEN '/2' ELSE '' END) END AS house_number
FROM (
  SELECT id, hh, m, part_number, serial, concat(substr(stems, first + 1, 4), substr(ends, first % 9 * 3 + 1, 3), ' ', substr(stems, last + 1, 5)) AS name,
         CASE m WHEN 0 THEN 'father' WHEN 1 THEN 'Husband' WHEN 2 THEN 'Father' WHEN 3 THEN 'husband' WHEN 4 THEN 'Father' WHEN 5 THEN 'Mother' WHEN 6 THEN 'Father' ELSE CASE WHEN hh % 2 = 0 THEN 'Husband' ELSE 'Other' END END AS relation_type,
         concat(substr(stems, rel_first + 1, 4), substr(ends, rel_first % 9 * 3 + 1, 3), ' ', substr(stems, last + 1, 5)) AS rel
  FROM (
    SELECT c_custkey AS id, CAST(floor((c_custkey - 1) / 8) AS INT) AS hh, CAST((c_custkey - 1) % 8 AS INT) AS m, CAST(CAST(floor((c_custkey - 1) / 400) AS INT) AS VARCHAR(20)) AS part_number, CAST((c_custkey - 1) % 400 + 1 AS INT) AS serial,
           'arulbalachitdevaelangopiharikalajayakumamaniselvravivaluyogasathpoonmeenvijanandnila' AS stems, 'an iahoma rajlinsamvel' AS ends,
           CAST((floor((c_custkey - 1) / 8) * 5 + (c_custkey - 1) % 8 * 11) % 76 AS INT) AS first, CAST(floor((c_custkey - 1) / 8) * 3 % 70 AS INT) AS last,
           CAST((floor((c_custkey - 1) / 8) * 5 + CASE (c_custkey - 1) % 8 WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 6 THEN 4 ELSE 2 END * 11) % 76 AS INT) AS rel_first
    FROM customer) k) r""",
    # a document an order; some files are named a little otherwise, some are not there
    "roll_documents": """SELECT concat('AC', lpad(CAST(o_orderkey % 240 + 1 AS VARCHAR(20)), 3, '0'), '-PART-', CAST(o_orderkey AS VARCHAR(20)), '.pdf') AS doc FROM orders""",
    "roll_files": """SELECT concat('F', CAST(o_orderkey AS VARCHAR(20))) AS file_id, concat('AC', lpad(CAST(o_orderkey % 240 + 1 AS VARCHAR(20)), 3, '0'), '-PART-', CAST(o_orderkey AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN '.pdf' ELSE ' v2.pdf' END) AS name FROM orders WHERE o_orderkey % 5 <> 4""",
    "roll_stations": """SELECT concat('F', CAST(o_orderkey AS VARCHAR(20))) AS file_id, CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN NULL ELSE CAST(3 + o_custkey % 3 AS INT) END AS total_electors, CASE WHEN o_orderkey % 8 = 1 THEN 6 END AS serial_end FROM orders WHERE o_orderkey % 6 <> 5""",
    "roll_summaries": """SELECT concat('F', CAST(o_orderkey AS VARCHAR(20))) AS file_id, CASE WHEN o_orderkey % 12 = 0 THEN 2 ELSE 0 END AS total_voters, CASE WHEN o_orderkey % 12 = 4 THEN 5 END AS extracted_records FROM orders WHERE o_orderkey % 3 <> 2""",
    "roll_electors": """
SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(l_quantity AS VARCHAR(20)), '-', CAST(l_extendedprice AS VARCHAR(30))) AS record_id,
       CASE WHEN l_orderkey % 7 <> 3 THEN concat('F', CAST(l_orderkey AS VARCHAR(20))) END AS file_id, CAST(l_orderkey AS VARCHAR(20)) AS part_number, concat('no ', CAST(l_orderkey % 240 + 1 AS VARCHAR(20)), ' north') AS constituency,
       CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST(l_linenumber AS INT) END AS serial,
       CASE WHEN l_partkey % 23 = 0 THEN '' WHEN l_partkey % 29 = 0 THEN 'unknown 1' WHEN l_partkey % 31 = 0 THEN ' ab1' ELSE concat(' ep', lpad(CAST(l_partkey % 40 AS VARCHAR(20)), 5, '0')) END AS epic,
       CASE WHEN l_suppkey % 37 = 0 THEN NULL WHEN l_suppkey % 41 = 0 THEN ' x ' ELSE concat('N', CAST(l_suppkey AS VARCHAR(20))) END AS name,
       CASE WHEN l_partkey % 43 = 0 THEN NULL ELSE CAST(16 + l_suppkey % 112 AS INT) END AS age,
       CASE WHEN l_partkey % 47 = 0 THEN NULL WHEN l_linenumber = 7 THEN 'male' WHEN l_linenumber % 2 = 0 THEN 'Female' ELSE 'ஆண்' END AS gender, CAST(l_orderkey % 40 AS INT) AS page_number
FROM lineitem""",
    # twelve cells a page in four rows, a little out of place; some pages lack one
    "grid_cells": """
SELECT page_id, cell, CAST(c * (330 + page_id % 9) + page_id % 5 AS DOUBLE) AS x, CAST(r * (36 + page_id % 7) + (page_id + c) % 6 AS DOUBLE) AS y, CAST(310 + page_id % 13 AS DOUBLE) AS w, CAST(30 + page_id % 11 AS DOUBLE) AS h
FROM (SELECT o_orderkey AS page_id, CAST(k.k AS INT) AS cell, CAST(floor(k.k / 3) AS INT) AS r, CAST(k.k % 3 AS INT) AS c FROM orders, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) AS k(k)) x
WHERE NOT (page_id % 10 = 3 AND cell = page_id % 12)""",
    # a page with one record an event; every seventh file never gets its last page
    "stream_records": """
SELECT CAST(event_id AS VARCHAR(20)) AS record_id, event_id AS page_id, concat('F', CAST(user_id AS VARCHAR(20))) AS file_id, CAST(event_id AS INT) AS page_number, 1 AS idx, CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END AS error_count,
       concat('ev ', CAST(user_id AS VARCHAR(20)), 'x', CAST(event_id % 40 AS VARCHAR(20))) AS epic,
       replace(replace(CASE event_id % 3 WHEN 0 THEN 'arulselvi' WHEN 1 THEN 'manikandan' ELSE 'perumal' END, CASE WHEN event_id % 10 = 0 THEN 'a' ELSE '_' END, 'o'), CASE WHEN event_id % 4 = 1 THEN 'e' ELSE '_' END, 'i') AS name,
       CAST(event_id % 17 AS VARCHAR(20)) AS serial, 'Father' AS relation_type, 'x' AS relation_name, '1' AS house_number, '40' AS age, 'Male' AS gender, CASE WHEN event_id % 13 = 0 THEN 'Yes' ELSE '' END AS is_deleted,
       CASE WHEN event_id % 26 = 0 THEN 'Expired' ELSE '' END AS deletion_reason, CASE WHEN event_type = 'view' THEN '' ELSE concat(CAST(event_id % 5 + 1 AS VARCHAR(20)), ' - ', event_type) END AS section_name, value AS confidence, user_id % 7 = 0 AS unfinished
FROM events""",
    # records to promote, their pages, files and stations, and the register as it is
    "raw_records": """
SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(l_quantity AS VARCHAR(20)), '-', CAST(l_extendedprice AS VARCHAR(30))) AS record_id,
       l_orderkey AS page_id, concat('F', CAST(l_suppkey AS VARCHAR(20))) AS file_id, CAST(l_orderkey % 40 AS INT) AS page_number, CAST(l_linenumber AS INT) AS idx, CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END AS error_count,
       CASE WHEN l_partkey % 53 = 0 THEN NULL WHEN l_partkey % 59 = 0 THEN ' - ' ELSE concat('abc-', lpad(CAST(l_partkey AS VARCHAR(20)), 7, '0')) END AS epic,
       concat('Name ', CAST(l_suppkey AS VARCHAR(20))) AS name, CASE WHEN l_linenumber = 3 THEN concat('S', CAST(l_orderkey AS VARCHAR(20))) ELSE CAST(l_linenumber AS VARCHAR(20)) END AS serial,
       CASE WHEN l_suppkey % 2 = 0 THEN 'Father' ELSE '' END AS relation_type, CASE WHEN l_suppkey % 2 = 0 THEN 'Rel' END AS relation_name, concat(CAST(l_partkey % 90 AS VARCHAR(20)), '/1') AS house_number,
       CASE WHEN l_partkey % 11 = 0 THEN '4O' ELSE CAST(18 + l_suppkey % 80 AS VARCHAR(20)) END AS age, CASE WHEN l_partkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
       CASE WHEN l_returnflag = 'R' THEN 'Yes' ELSE '' END AS is_deleted, CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN concat('reason ', CAST(l_linenumber AS VARCHAR(20))) WHEN l_linenumber = 5 THEN 'stray' ELSE '' END AS deletion_reason,
       CASE WHEN l_linenumber = 4 THEN concat('Section ', CAST(l_suppkey % 5 AS VARCHAR(20))) ELSE '' END AS section_name
FROM lineitem""",
    "raw_pages": """SELECT o_orderkey AS page_id, CASE WHEN o_orderstatus = 'P' THEN 'supplement_page' ELSE 'elector_page' END AS page_type, concat('Header ', o_orderpriority) AS header_text FROM orders""",
    "raw_files": """SELECT concat('F', CAST(s_suppkey AS VARCHAR(20))) AS file_id, concat('part ', CAST(s_suppkey AS VARCHAR(20)), CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat(' Revision', CAST(s_suppkey % 3 AS VARCHAR(20))) END, '.pdf') AS file_name FROM supplier""",
    "raw_stations": """
SELECT concat('F', CAST(s_suppkey AS VARCHAR(20))) AS file_id, concat('S', CAST(s_suppkey AS VARCHAR(20))) AS station_id, CAST(s_suppkey AS VARCHAR(20)) AS part_number, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE CAST(s_nationkey AS VARCHAR(20)) END AS ac_number,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE concat('Town ', CAST(s_nationkey AS VARCHAR(20))) END AS ac_name, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_name END AS address
FROM supplier WHERE s_suppkey % 5 <> 0""",
    "raw_current": """
SELECT concat('ABC', lpad(CAST(p_partkey AS VARCHAR(20)), 7, '0')) AS epic, concat('V', CAST(p_partkey AS VARCHAR(20))) AS voter_id, CAST(p_size AS INT) AS serial, p_name AS name, '' AS relation_type, '' AS relation_name, '9/1' AS house_number, CAST(20 + p_size AS INT) AS age, 'Male' AS gender,
       '1' AS part_number, 'old' AS constituency, p_size % 9 = 0 AS is_deleted, CASE WHEN p_size % 9 = 0 THEN 'gone' ELSE '' END AS deletion_reason, 'S0' AS polling_station_id, false AS is_supplement, 'Old section' AS section_name,
       'old' AS source_record_id, CAST(0 AS BIGINT) AS source_page_id, 'F0' AS source_file_id, '' AS source_file_name, CAST(1 AS INT) AS page_number
FROM part WHERE p_partkey % 3 = 0""",
    # one polling station a nation, with a JSON payload
    "stations": """
SELECT CAST(n_nationkey AS VARCHAR(20)) AS station_id, concat('F', CAST(n_nationkey AS VARCHAR(20))) AS file_id, CAST(n_nationkey AS VARCHAR(20)) AS part_number,
       n_name AS name, concat(n_name, ' School') AS building_name, CAST(n_regionkey AS VARCHAR(20)) AS ac_number, r_name AS ac_name, concat('District ', CAST(n_regionkey AS VARCHAR(20))) AS district,
       CASE WHEN n_nationkey % 6 = 0 THEN 0 WHEN n_nationkey % 5 = 1 THEN CAST(n_nationkey * 3 AS INT) ELSE NULL END AS total_electors,
       concat('{"cover":{"taluk":"T', CAST(n_regionkey AS VARCHAR(20)), '","total":', CAST(n_nationkey * 7 AS VARCHAR(20)), '}}') AS payload
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    # one recognised record a line item; all columns together order the rows
    "records": """
SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS record_id,
       l_orderkey AS page_id, CAST(l_orderkey % 40 AS INT) AS page_number, concat('F', CAST(l_suppkey AS VARCHAR(20))) AS file_id, l_linenumber AS idx,
       1 - l_discount AS mean_confidence, 1 - 2 * l_discount AS min_confidence,
       CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END AS error_count, CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END AS warning_count,
       l_returnflag = 'R' AS reviewed, l_linestatus = 'F' AS edited, concat('part ', CAST(l_partkey AS VARCHAR(20)), ' supp ', CAST(l_suppkey AS VARCHAR(20))) AS search_text,
       l_partkey AS part_key, l_quantity AS quantity
FROM lineitem""",
    # promotion candidates: the identifier is the part, the revision the year of shipping
    "candidates": """
SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(l_quantity AS VARCHAR(20)), '-', CAST(l_extendedprice AS VARCHAR(30))) AS record_id,
       l_partkey AS epic, CAST(year(l_shipdate) AS INT) AS revision, l_tax <= 0.05 AS is_clean, l_returnflag = 'R' AS is_deleted, l_linestatus = 'O' AS is_supplement,
       CAST(l_orderkey % 40 AS INT) AS page_number, l_linenumber AS idx, CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN concat('reason ', CAST(l_linenumber AS VARCHAR(20))) ELSE '' END AS reason,
       l_quantity AS quantity, l_suppkey AS supp
FROM lineitem""",
    # events as pages of a file that may carry a section heading
    "headed": """
SELECT event_id AS record_id, concat('F', CAST(user_id AS VARCHAR(20))) AS file_id, event_id AS page_number, ts,
       CASE WHEN event_type = 'view' THEN '' ELSE concat(CAST(event_id % 5 + 1 AS VARCHAR(20)), ' - ', event_type) END AS section,
       event_type, value, CAST(event_id % 17 AS INT) AS serial
FROM events""",
    # boxes of text lines, on pages of an order
    "boxes": """
SELECT l_orderkey AS page_id, concat(CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(l_quantity AS VARCHAR(20)), '-', CAST(l_extendedprice AS VARCHAR(30))) AS line_id,
       CAST(l_suppkey % 100 * 10 AS DOUBLE) AS x, CAST(l_linenumber * 20 + l_partkey % 7 AS DOUBLE) AS y, CAST(30 + l_quantity AS DOUBLE) AS w, CAST(12 + l_partkey % 5 AS DOUBLE) AS h,
       CASE WHEN l_linenumber = 1 THEN 'label' ELSE CAST(l_partkey AS VARCHAR(20)) END AS text
FROM lineitem""",
}


def _names(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The register table ``name`` over the driver's tables."""
    sql = SQL[name].replace("{", "{{").replace("}", "}}")
    for t in _names(sql):
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in _names(SQL[name])})


def twin(sql: str, *names: str) -> str:
    """A SQL twin that sees the bound tables ``names``."""
    heads = ",\n".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    if not names:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:].strip()}"
    return f"WITH {heads}, {body[5:].strip()}" if body.upper().startswith("WITH ") else f"WITH {heads}\n{body}"
