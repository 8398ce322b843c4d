"""Queries over lines of pages, geometry, citations, reports and the closed SQL catalog."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.functions import geometry as B
from registra.functions import text as X
from registra.operators import listing as L
from registra.operators import pages as P
from registra.registry import Argument, Catalog, run_sql
from registra.sources import sinks as K

from .bindings import bound, table, twin

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = twin(sql, *names)
        return f

    return add


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES = "l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)"


@query(f"WITH {LINES} SELECT doc_id, pos FROM l WHERE NOT (contains(lower(line), 'licensed under') OR contains(lower(line), 'all rights') OR regexp_matches(lower(line), '^the and'))")
def p23_without_furniture(spark, sf_dir):
    return P.without_furniture(_lines(spark, sf_dir), "line", ["licensed under", "all rights"], "^the and").select("doc_id", "pos")


@query(
    f"""WITH {LINES}, p AS (SELECT doc_id, max(contains(lower(line), 'licen')::INT) + max(contains(lower(line), 'rights')::INT) + max(contains(lower(line), 'the')::INT) AS a,
      max(contains(lower(line), 'der ')::INT) + max(contains(lower(line), 'die ')::INT) AS b, sum(len(regexp_extract_all(upper(line), '[A-Z]{{3}}[0-9]{{7}}')))::BIGINT AS ids, count(*) AS lines FROM l GROUP BY 1)
    SELECT doc_id, CASE WHEN a >= 2 THEN 'notice' WHEN b >= 2 THEN 'german' WHEN ids >= 3 THEN 'electors' WHEN lines <= 3 THEN 'blank' ELSE 'other' END AS page_type,
    round(CASE WHEN a >= 2 THEN a / 3 WHEN b >= 2 THEN b / 2 WHEN ids >= 3 THEN least(1.0, ids / 10) ELSE 0.5 END, 4) AS confidence, lines, ids FROM p"""
)
def r1_page_classes(spark, sf_dir):
    return P.classified(_lines(spark, sf_dir), "doc_id", "line", {"notice": ["licen", "rights", "the"], "german": ["der ", "die "]})


@query(
    f"""WITH {LINES}, p AS (SELECT doc_id, (max(contains(lower(line), 'the ')::INT) + max(contains(lower(line), 'and ')::INT)) / 2 AS a, max(contains(lower(line), 'tion')::INT) AS h, sum(len(regexp_extract_all(upper(line), '[A-Z]{{3}}[0-9]{{7}}'))) AS n FROM l GROUP BY 1),
    s AS (SELECT doc_id, round(a * 0.55 + CASE WHEN n >= 3 THEN 0.35 WHEN n >= 1 THEN 0.20 ELSE 0 END + h * 0.10, 4) AS score FROM p) SELECT doc_id, score, CASE WHEN score >= 0.45 THEN 'roll' ELSE 'generic' END AS template FROM s"""
)
def r2_template_detection(spark, sf_dir):
    return P.template_score(_lines(spark, sf_dir), "doc_id", "line", ["the ", "and "], "tion")


@query(
    f"""WITH {LINES} SELECT doc_id, (pos + 1)::INT AS line_number, line AS text, round(1.0 / (1 + pos % 3), 4) AS confidence, CASE WHEN trim(line) = '' THEN 'empty' WHEN 1.0 / (1 + pos % 3) < 0.6 THEN 'low confidence' END AS issue FROM l"""
)
def r3_generic_records(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("c", 1.0 / (1 + F.col("pos") % 3))
    return P.generic_records(rows, "doc_id", [F.col("pos")], "line", "c")


@query(f"WITH {LINES} SELECT doc_id, arg_min(regexp_extract(line, '([A-Z][a-z]+) the ', 1), pos) AS word FROM l WHERE regexp_extract(line, '([A-Z][a-z]+) the ', 1) <> '' GROUP BY 1")
def r7_header_value(spark, sf_dir):
    return P.first_match(_lines(spark, sf_dir), "doc_id", "pos", "line", "([A-Z][a-z]+) the ", "word")


@query(
    f"""WITH {LINES}, a AS (SELECT doc_id, pos, 'licence' AS anchor FROM l WHERE contains(lower(line), 'licensed') OR contains(lower(line), 'license,') UNION ALL SELECT doc_id, pos, 'article' FROM l WHERE contains(lower(line), 'the '))
    SELECT doc_id, anchor, min(pos) AS pos FROM a GROUP BY 1, 2"""
)
def j28_anchor_lines(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("order", F.col("pos"))
    return P.anchors(rows, "doc_id", ["order"], "pos", "line", {"licence": ["licensed", "license,"], "article": ["the "]})


@query(
    """WITH b AS (SELECT page_id, min(y) + 20 AS top, max(y + h) - 20 AS bottom FROM boxes GROUP BY 1),
    r AS (SELECT x.page_id, text, y, line_id, CASE WHEN y + h <= top THEN 'header' WHEN y >= bottom THEN 'footer' END AS part FROM boxes x JOIN b USING (page_id))
    SELECT page_id, coalesce(string_agg(text, ' ' ORDER BY y, line_id) FILTER (part = 'header'), '') AS header_text, coalesce(string_agg(text, ' ' ORDER BY y, line_id) FILTER (part = 'footer'), '') AS footer_text FROM r WHERE part IS NOT NULL GROUP BY 1""",
    "boxes",
)
def r20_head_and_foot(spark, sf_dir):
    rows = bound(spark, sf_dir, "boxes")
    body = rows.groupBy("page_id").agg((F.min("y") + 20).alias("top"), (F.max(F.col("y") + F.col("h")) - 20).alias("bottom"))
    return P.head_and_foot(rows, body, "page_id", "y", "h", "text", "line_id")


@query("WITH b AS (SELECT page_id, min(x) AS x, min(y) AS y, max(w) AS w, max(h) AS h FROM boxes GROUP BY 1) SELECT page_id, (r * 3 + c)::INT AS cell, x + c * w / 3 AS cx, y + r * h / 2 AS cy, w / 3 AS cw, h / 2 AS ch FROM b, range(0, 2) t(r), range(0, 3) u(c)", "boxes")
def r28_proportional_grid(spark, sf_dir):
    body = bound(spark, sf_dir, "boxes").groupBy("page_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("w").alias("w"), F.max("h").alias("h"))
    return P.grid(body, "page_id", 2, 3)


@query(
    """SELECT page_id, line_id, [greatest(0, least(1000, round_even(x * 1000.0 / 1200, 0)::INT)), greatest(0, least(1000, round_even(y * 1000.0 / 300, 0)::INT)),
    greatest(greatest(0, least(1000, round_even((x + w) * 1000.0 / 1200, 0)::INT)), greatest(0, least(1000, round_even(x * 1000.0 / 1200, 0)::INT)) + 1),
    greatest(greatest(0, least(1000, round_even((y + h) * 1000.0 / 300, 0)::INT)), greatest(0, least(1000, round_even(y * 1000.0 / 300, 0)::INT)) + 1)] AS box FROM boxes""",
    "boxes",
)
def x26_r19_grid_boxes(spark, sf_dir):
    c = {k: F.col(k) for k in "xywh"}
    return bound(spark, sf_dir, "boxes").select("page_id", "line_id", B.grid_box(c["x"], c["y"], c["w"], c["h"], F.lit(1200.0), F.lit(300.0)).alias("box"))


@query(
    """WITH a AS (SELECT * FROM boxes), i AS (SELECT a.page_id, a.line_id, b.line_id AS other, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i, a.w * a.h + b.w * b.h AS u FROM a JOIN a b ON a.page_id = b.page_id AND a.line_id <> b.line_id)
    SELECT page_id, line_id, round(max(i / (u - i)), 6) AS best FROM i GROUP BY 1, 2""",
    "boxes",
)
def w12_x27_best_overlap(spark, sf_dir):
    rows = bound(spark, sf_dir, "boxes")
    a = rows.select("page_id", "line_id", *[F.col(c).alias(f"a{c}") for c in "xywh"])
    b = rows.select("page_id", F.col("line_id").alias("other"), *[F.col(c).alias(f"b{c}") for c in "xywh"])
    overlap = B.iou(tuple(F.col(f"a{c}") for c in "xywh"), tuple(F.col(f"b{c}") for c in "xywh"))
    return a.join(b, "page_id").filter("line_id != other").groupBy("page_id", "line_id").agg(F.round(F.max(overlap), 6).alias("best"))


@query(
    """WITH p AS (SELECT o_custkey AS f, o_orderkey AS n, o_orderstatus AS s, (o_orderkey % 9 + 1)::INT AS height, min(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS first FROM orders),
    q AS (SELECT *, sum((s = 'F')::INT) OVER (PARTITION BY f ORDER BY n ROWS UNBOUNDED PRECEDING) AS stop FROM p WHERE n >= first)
    SELECT f, n, coalesce(sum(height) OVER (PARTITION BY f ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM q WHERE stop = 0"""
)
def w13_continued_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("s"), (F.col("o_orderkey") % 9 + 1).cast("int").alias("height"))
    return P.continued_pages(pages, "f", "n", F.col("s") == "O", F.col("s") != "F", "height").select("f", "n", "shift")


@query(
    """WITH r AS (SELECT user_id AS page, event_id AS o, CASE WHEN event_type = 'view' THEN 'total of all' ELSE event_type END AS text FROM events), m AS (SELECT *, CASE WHEN contains(text, 'click') THEN 'a' WHEN contains(text, 'purchase') THEN 'b' END AS own FROM r)
    SELECT page, o, coalesce(own, CASE WHEN contains(text, 'total') THEN last_value(own IGNORE NULLS) OVER (PARTITION BY page ORDER BY o ROWS UNBOUNDED PRECEDING) END) AS category, contains(text, 'total') AS is_total FROM m"""
)
def w16_labelled_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("o"), F.when(F.col("event_type") == "view", "total of all").otherwise(F.col("event_type")).alias("text"))
    return P.labelled_totals(rows, "page", "o", "text", {"a": "click", "b": "purchase"}, "total").select("page", "o", "category", "is_total")


@query(
    """WITH r AS (SELECT o_orderkey AS id, 'See [[v:' || o_custkey || ']] and [[v:x' || o_orderkey % 7 || ']] or [[v:' || o_custkey || ']].' AS text, o_custkey FROM orders)
    SELECT id, 'See ' || CASE WHEN o_custkey % 2 = 0 THEN '[[v:' || o_custkey || ']]' ELSE '' END || ' and  or ' || CASE WHEN o_custkey % 2 = 0 THEN '[[v:' || o_custkey || ']]' ELSE '' END || '.' AS text, CASE WHEN o_custkey % 2 = 0 THEN o_custkey::VARCHAR ELSE '' END AS cited FROM r"""
)
def r25_bound_citations(spark, sf_dir):
    k = F.col("o_custkey").cast("string")
    mark = F.concat(F.lit("[[v:"), k, F.lit("]]"))
    text = F.concat(F.lit("See "), mark, F.lit(" and [[v:x"), (F.col("o_orderkey") % 7).cast("string"), F.lit("]] or "), mark, F.lit("."))
    replies = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))
    known = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("key"))
    out = P.bound_citations(replies, "id", "text", known, "key")
    return out.select("id", "text", F.array_join("cited", ",").alias("cited"))


@query(
    """SELECT c_custkey AS id, 0 AS pos, 'name' AS label, trim(c_name) AS value FROM customer UNION ALL SELECT c_custkey, 1, 'house number', (c_custkey % 50)::VARCHAR FROM customer UNION ALL SELECT c_custkey, 3, 'age', '44' FROM customer"""
)
def r5_key_values(spark, sf_dir):
    line = F.concat(F.lit("Name: "), "c_name", F.lit(" | House Number = "), (F.col("c_custkey") % 50).cast("string"), F.lit(" | noise | the Age:44"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), line.alias("text"))
    return P.key_values(rows, ["id"], "text", ["name", "number", "house number", "age"])


@query("SELECT l_orderkey AS page, min(l_partkey) FILTER (l_suppkey = m) AS serial_key FROM (SELECT *, min(l_suppkey) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) GROUP BY 1")
def w18_leftmost_box(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.min(F.struct("l_suppkey", "l_partkey")).getField("l_partkey").alias("serial_key"))


@query(
    """WITH i AS (SELECT l_orderkey, unnest([CASE WHEN l_tax > 0.05 THEN 'required' END, CASE WHEN l_discount > 0.08 THEN 'low_confidence' END, CASE WHEN l_quantity < 3 THEN 'age' END]) AS code FROM lineitem) SELECT code, count(*) AS n, count(DISTINCT l_orderkey) AS pages FROM i WHERE code IS NOT NULL GROUP BY 1"""
)
def g19_issue_histogram(spark, sf_dir):
    codes = F.array_compact(F.array(F.when(F.col("l_tax") > 0.05, "required"), F.when(F.col("l_discount") > 0.08, "low_confidence"), F.when(F.col("l_quantity") < 3, "age")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("pages"))


@query(
    """SELECT 'name' AS field, round(avg((trim(coalesce(name, '')) <> '')::INT), 6) AS fill_rate FROM electors UNION ALL SELECT 'gender', round(avg((trim(coalesce(gender, '')) <> '')::INT), 6) FROM electors UNION ALL SELECT 'house_number', round(avg((trim(coalesce(house_number, '')) <> '')::INT), 6) FROM electors""",
    "electors",
)
def g20_fill_rates(spark, sf_dir):
    fields = ["name", "gender", "house_number"]
    rows = bound(spark, sf_dir, "electors").select(*[(~X.blank(F.col(c))).cast("int").alias(c) for c in fields])
    return rows.agg(*[F.round(F.avg(c), 6).alias(c) for c in fields]).unpivot([], fields, "field", "fill_rate")


@query("SELECT count(*) AS files, sum(n)::BIGINT AS pages, sum(bytes)::BIGINT AS bytes, sum((n > 5)::INT)::BIGINT AS done FROM (SELECT source, count(*) AS n, sum(n_chars) AS bytes FROM documents GROUP BY 1)")
def g21_folder_totals(spark, sf_dir):
    per = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("bytes"))
    return per.agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("pages"), F.sum("bytes").alias("bytes"), F.count_if(F.col("n") > 5).alias("done"))


@query(
    """WITH x AS (SELECT o_custkey AS file_id, count(*) AS extracted, CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE (o_custkey % 12)::INT END AS net, (o_custkey % 9)::INT AS cover FROM orders GROUP BY 1, 3, 4)
    SELECT file_id, extracted, coalesce(nullif(net, 0), nullif(cover, 0)) AS printed, extracted - coalesce(nullif(net, 0), nullif(cover, 0)) AS difference, CASE WHEN net <> 0 THEN 'summary' WHEN cover <> 0 THEN 'cover' END AS source FROM x"""
)
def g24_reconciliation(spark, sf_dir):
    k = F.col("file_id")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file_id")).agg(F.count(F.lit(1)).alias("extracted"))
    net, cover = F.when(k % 4 == 0, 0).otherwise((k % 12).cast("int")), (k % 9).cast("int")
    printed = F.coalesce(F.nullif(net, F.lit(0)), F.nullif(cover, F.lit(0)))
    return counts.select("file_id", "extracted", printed.alias("printed"), (F.col("extracted") - printed).alias("difference"), F.when(net != 0, "summary").when(cover != 0, "cover").alias("source"))


@query("SELECT n_nationkey, n_nationkey % 3 + 4 + n_nationkey % 2 = 7 AS adds_up, n_nationkey + 3 - 2 + 0 = n_nationkey + 1 AS net_ok FROM nation")
def g25_arithmetic_checks(spark, sf_dir):
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k, ((k % 3 + 4 + k % 2) == 7).alias("adds_up"), ((k + 3 - 2 + 0) == k + 1).alias("net_ok"))


@query(
    """SELECT part_number, count(*) AS electors, sum(is_deleted::INT)::BIGINT AS deleted, sum((age < 18)::INT)::BIGINT AS anomalies, count(DISTINCT page_number) AS pages FROM electors GROUP BY 1""", "electors"
)
def g27_ingest_report(spark, sf_dir):
    return bound(spark, sf_dir, "electors").groupBy("part_number").agg(F.count(F.lit(1)).alias("electors"), F.sum(F.col("is_deleted").cast("int")).alias("deleted"), F.sum((F.col("age") < 18).cast("int")).alias("anomalies"), F.countDistinct("page_number").alias("pages"))


@query(
    """SELECT s.station_id, (SELECT count(*) FROM electors e WHERE e.part_number = s.part_number) AS electors, coalesce(string_agg(x.id::VARCHAR, ',' ORDER BY x.serial, x.id), '') AS sample FROM stations s
    LEFT JOIN (SELECT * FROM electors QUALIFY row_number() OVER (PARTITION BY part_number ORDER BY serial, id) <= 10) x USING (part_number) GROUP BY 1, 2""",
    "electors",
    "stations",
)
def j10_station_detail(spark, sf_dir):
    people = bound(spark, sf_dir, "electors")
    way = Window.partitionBy("part_number").orderBy("serial", "id")
    sample = people.withColumn("_rn", F.row_number().over(way)).filter("_rn <= 10").groupBy("part_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("serial", "id"))), lambda x: x["id"].cast("string")), ",").alias("sample"))
    counts = people.groupBy("part_number").agg(F.count(F.lit(1)).alias("electors"))
    out = bound(spark, sf_dir, "stations").select("station_id", "part_number").join(counts, "part_number", "left").join(sample, "part_number", "left")
    return out.select("station_id", F.coalesce("electors", F.lit(0)).alias("electors"), F.coalesce("sample", F.lit("")).alias("sample"))


@query("SELECT part_number, min(file_id) AS source_file FROM electors GROUP BY 1", "electors")
def j26_source_of_part(spark, sf_dir):
    return bound(spark, sf_dir, "electors").groupBy("part_number").agg(F.min("file_id").alias("source_file"))


@query("WITH j AS (SELECT o_custkey AS job, list(o_orderkey) AS files FROM orders GROUP BY 1) SELECT s_suppkey AS file_id, job FROM supplier JOIN j ON list_contains(files, s_suppkey)")
def j27_jobs_of_file(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("job")).agg(F.collect_list("o_orderkey").alias("files"))
    # exploded to an equi-join: array_contains as a join condition would be a nested loop
    return jobs.select("job", F.explode("files").alias("file_id")).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id")), "file_id")


@query(
    """SELECT e.id, count(o_orderkey) AS blocks, round(avg(CASE WHEN o_totalprice > 1000 THEN o_totalprice END), 7) AS mean_confidence, min(CASE WHEN o_totalprice > 1000 THEN o_totalprice END) AS min_confidence FROM electors e LEFT JOIN orders ON o_custkey = e.id GROUP BY 1""",
    "electors",
)
def j22_blocks_of_elector(spark, sf_dir):
    good = F.when(F.col("o_totalprice") > 1000, F.col("o_totalprice"))
    out = bound(spark, sf_dir, "electors").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("id"), "left").groupBy("id")
    return out.agg(F.count("o_orderkey").alias("blocks"), F.round(F.avg(good), 7).alias("mean_confidence"), F.min(good).alias("min_confidence"))


@query("SELECT o_custkey AS id, o_orderkey AS entry, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey))::INT AS place FROM orders")
def j23_edit_history(spark, sf_dir):
    way = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("entry"), F.row_number().over(way).alias("place"))


@query("SELECT id, CASE lower(trim(g)) WHEN 'm' THEN 'Male' WHEN 'f' THEN 'Female' WHEN 'other' THEN 'Third Gender' ELSE g END AS gender FROM (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN ' f' WHEN 2 THEN 'Other' ELSE '?' END AS g FROM customer)")
def x18_canonical_gender(spark, sf_dir):
    k = F.col("c_custkey") % 4
    g = F.when(k == 0, "M").when(k == 1, " f").when(k == 2, "Other").otherwise("?")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), X.canonical(g, X.GENDERS).alias("gender"))


@query(
    """WITH t AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'E' WHEN 1 THEN 's 12' WHEN 2 THEN '12' WHEN 3 THEN 'R-' || c_custkey ELSE '' END AS t FROM customer), c AS (SELECT id, coalesce(nullif(regexp_extract(upper(trim(t)), '^([ESRQM])$', 1), ''), nullif(regexp_extract(upper(trim(t)), '^([ESRQM])\\s*[-.]?\\s*\\d+$', 1), '')) AS code FROM t)
    SELECT id, code, CASE code WHEN 'E' THEN 'Expired' WHEN 'S' THEN 'Shifted' WHEN 'R' THEN 'Repeated' END AS reason FROM c"""
)
def x19_x20_deletion_codes(spark, sf_dir):
    k = F.col("c_custkey")
    t = F.when(k % 5 == 0, "E").when(k % 5 == 1, "s 12").when(k % 5 == 2, "12").when(k % 5 == 3, F.concat(F.lit("R-"), k.cast("string"))).otherwise("")
    return table(spark, sf_dir, "customer").select(k.alias("id"), X.reason_code(t).alias("code"), X.reason_text(t).alias("reason"))


@query("""SELECT doc_id, n_chars, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE printf('%.1f', n_chars / 1024.0) || ' KB' END AS size, CASE WHEN length(source) <= 4 THEN '****' ELSE '****' || right(source, 4) END AS masked FROM documents WHERE n_chars < 900000""")
def x31_sizes_and_masks(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("n_chars < 900000").select("doc_id", "n_chars", X.size_text(F.col("n_chars")).alias("size"), X.masked_secret(F.col("source")).alias("masked"))


@query("SELECT event_id, (props::JSON ->> '$.k')::INT AS k, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM events")
def x32_x34_json_and_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm").alias("at"))


@query("SELECT id, epic, age FROM electors WHERE gender = 'Female' AND NOT is_deleted ORDER BY age DESC NULLS LAST, id LIMIT 500", "electors")
def k8_filtered_export(spark, sf_dir):
    rows = bound(spark, sf_dir, "electors").filter(L.all_of(L.predicates({"gender": "Female", "is_deleted": False})))
    return L.page(rows.select("id", "epic", "age"), "age", "id", ["age", "epic"], descending=True, limit=min(500, 200_000))


@query("SELECT 'Electors' AS title, count(*) AS total_records FROM electors", "electors")
def k10_envelope(spark, sf_dir):
    return K.envelope(bound(spark, sf_dir, "electors"), "Electors")


@query("SELECT p_partkey AS a, NULL::VARCHAR AS b, p_size AS c FROM part UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def u2_union_of_columns(spark, sf_dir):
    one = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("a"), F.col("p_size").alias("c"))
    two = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_name").alias("b"))
    return one.unionByName(two, allowMissingColumns=True).select("a", "b", "c")


@query("SELECT n_regionkey, count(*) AS n, count(*) > 200 AS _truncated FROM nation GROUP BY 1 EXCEPT SELECT 0, 0, true")
def e3_u5_read_only_sql(spark, sf_dir):
    return run_sql(spark, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey EXCEPT SELECT 0, 0L", {"nation": table(spark, sf_dir, "nation")}).select("n_regionkey", "n", "_truncated")


@query("SELECT id, serial FROM electors WHERE part_number = '7' AND serial <= 90", "electors")
def e1_named_query(spark, sf_dir):
    catalog = Catalog()
    catalog.add("serials", "Electors of a part up to a serial", lambda t, part, most: t["electors"].filter((F.col("part_number") == part) & (F.col("serial") <= most)).select("id", "serial"), part=Argument(str), most=Argument(int, 50, 1, 100))
    return catalog.run("serials", {"electors": bound(spark, sf_dir, "electors")}, part="7", most=90)
