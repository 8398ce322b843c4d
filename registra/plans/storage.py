"""Queries over sources, sinks, changes, streams, text functions and households."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.functions import similarity as S
from registra.functions import text as X
from registra.operators import filejobs as J
from registra.operators import mutations as M
from registra.operators import storage
from registra.sources import sinks as K
from registra.sources import tables as T
from registra.streaming import completion as C
from registra.streaming import pages as P

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


@query(
    """SELECT id, epic, coalesce(name, '') AS name, coalesce(gender, '') AS gender, CASE WHEN verified THEN 'Yes' ELSE 'No' END AS verified, coalesce(age::VARCHAR, '') AS age FROM electors""", "electors"
)
def k7_k3_curated_csv_round_trip(spark, sf_dir):
    rows = bound(spark, sf_dir, "electors").select("id", "epic", "name", "gender", "verified", "age")
    path = storage.new_path(spark, "csv")
    K.write_csv(K.shown(rows), path)
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("id").cast("long").alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("epic", "name", "gender", "verified", "age")])


@query("SELECT id, epic, age, verified FROM electors WHERE age IS NOT NULL", "electors")
def k4_s6_json_round_trip(spark, sf_dir):
    path = storage.new_path(spark, "json")
    K.write_json(bound(spark, sf_dir, "electors").filter("age is not null").select("id", "epic", "age", "verified"), path)
    return spark.read.schema("id long, epic string, age int, verified boolean").json(path)


@query("SELECT id, epic, part_number::INT AS part_number FROM electors", "electors")
def k9_xml_round_trip(spark, sf_dir):
    path = storage.new_path(spark, "xml")
    K.write_xml(bound(spark, sf_dir, "electors").select("id", "epic", "part_number"), path)
    return spark.read.format("xml").option("rowTag", "VoterRecord").schema("id long, epic string, part_number int").load(path)


@query(
    """SELECT page_number AS page, -1::BIGINT AS place, '--- page ' || page_number AS value FROM electors GROUP BY page_number
    UNION ALL SELECT page_number, serial::BIGINT, 'epic: ' || epic || ' | gender: ' || coalesce(gender, '') FROM electors""",
    "electors",
)
def k5_text_lines(spark, sf_dir):
    rows = bound(spark, sf_dir, "electors")
    return K.text_lines(rows, "page_number", "serial", ["epic", "gender"]).withColumnRenamed("page_number", "page")


@query("SELECT '| ' || p_partkey || ' | ' || replace(p_name, '|', '\\|') || ' | ' || p_brand || ' |' AS value FROM part")
def k6_markdown(spark, sf_dir):
    return K.markdown_lines(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"))


@query("SELECT id, CASE WHEN regexp_full_match(epic, '[0-9]+') THEN epic::BIGINT END AS epic_number, CASE WHEN regexp_full_match(part_number, '[0-9]+') THEN part_number::BIGINT END AS part FROM electors", "electors")
def k11_numeric_casts(spark, sf_dir):
    return bound(spark, sf_dir, "electors").select("id", K.digits_or_null(F.col("epic")).alias("epic_number"), K.digits_or_null(F.col("part_number")).alias("part"))


@query("SELECT id, epic, (SELECT count(*) FROM electors) AS total_rows, (SELECT count(*) FROM electors) > 50 AS truncated FROM electors ORDER BY epic, id LIMIT 50", "electors")
def k13_preview(spark, sf_dir):
    return K.preview(bound(spark, sf_dir, "electors").select("id", "epic"), [F.col("epic"), F.col("id")])


def _fields(spark, sf_dir):
    """Records with a map of fields over the line items."""
    value = lambda c, k: F.struct(F.col(c).cast("string").alias("original_value"), F.when(F.col("l_orderkey") % 5 == 0, F.concat(F.lit("e"), F.col(c).cast("string"))).alias("edited_value"), (1 - F.col("l_discount")).alias("confidence"))
    keys = F.struct(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.col("l_suppkey").alias("supp"))
    fields = F.map_from_arrays(F.array(F.lit("part"), F.lit("supplier")), F.array(value("l_partkey", "part"), value("l_suppkey", "supplier")))
    return table(spark, sf_dir, "lineitem").select(keys.alias("k"), fields.alias("fields"), F.when(F.col("l_tax") > 0.05, 1).otherwise(0).alias("error_count")).select("k.*", "fields", "error_count")


@query(
    """SELECT l_orderkey AS page, l_linenumber AS idx, l_suppkey AS supp, 0 AS error_count, CASE WHEN l_orderkey % 5 = 0 THEN 'e' || l_partkey ELSE l_partkey::VARCHAR END AS part,
    CASE WHEN l_orderkey % 5 = 0 THEN 'e' || l_suppkey ELSE l_suppkey::VARCHAR END AS supplier FROM lineitem WHERE l_tax <= 0.05"""
)
def k1_p1_export_clean(spark, sf_dir):
    return K.export_table(_fields(spark, sf_dir), ["part", "supplier"], "clean")


@query(
    """SELECT l_orderkey AS page, count(*) AS n, sum((l_orderkey % 5 = 0)::INT)::BIGINT AS edited, round(min(1 - l_discount), 6) AS min_confidence, round(avg(1 - l_discount), 6) AS mean_confidence FROM lineitem GROUP BY 1"""
)
def p2_record_summary(spark, sf_dir):
    conf = F.transform(F.map_values("fields"), lambda v: v["confidence"])
    mean = F.aggregate(conf, F.lit(0.0), lambda a, x: a + x) / F.size(conf)
    edited = F.exists(F.map_values("fields"), lambda v: v["edited_value"].isNotNull() & (v["edited_value"] != v["original_value"]))
    rows = _fields(spark, sf_dir).select("page", mean.alias("m"), F.array_min(conf).alias("c"), edited.cast("long").alias("e"))
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("edited"), F.round(F.min("c"), 6).alias("min_confidence"), F.round(F.avg("m"), 6).alias("mean_confidence"))


@query("SELECT l_orderkey AS page, l_linenumber AS idx, l_partkey AS part FROM lineitem")
def s3_nested_pages_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("part"))
    return T.flat_records(T.nested_pages(rows, "page", "idx", ["part"]), "page").drop("pos")


@query(
    """SELECT l_orderkey AS page, trim(l_returnflag) AS text, round(1 - l_tax * 10, 4) AS confidence, l_linenumber * 10.0 / 2 AS x, (l_suppkey % 7)::DOUBLE / 2 AS y, l_quantity / 2 AS w, 4.0 AS h FROM lineitem WHERE 1 - l_tax * 10 >= 0.30"""
)
def s2_normalised_lines(spark, sf_dir):
    n, s, q = (F.col(c).cast("double") for c in ("l_linenumber", "l_suppkey", "l_quantity"))
    y = (F.col("l_suppkey") % 7).cast("double")
    polygon = F.array(F.array(n * 10, y), F.array(n * 10 + q, y), F.array(n * 10 + q, y + 8), F.array(n * 10, y + 8))
    del s
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("text"), (1 - F.col("l_tax") * 10).alias("confidence"), polygon.alias("polygon"))
    return T.normalised_lines(raw, F.lit(2.0)).select("page", "text", "confidence", "bbox.*")


@query("SELECT s_suppkey AS id, s_name AS name, 'unknown' AS city, 0 AS stars FROM supplier")
def s7_copy_with_drift(spark, sf_dir):
    source = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    target = spark.createDataFrame([], "id long, name string, city string, stars int")
    return T.copied(source, target, {"city": "unknown", "stars": 0})


@query(
    """WITH i AS (SELECT l_partkey AS key, l_quantity AS v, l_shipdate AS ts, concat(l_orderkey, '-', l_linenumber, '-', l_suppkey, '-', l_extendedprice) AS t FROM lineitem WHERE l_partkey % 2 = 0),
    f AS (SELECT key, v FROM i QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, t) = 1)
    SELECT p_partkey AS key, p_size::DOUBLE AS v FROM part WHERE p_partkey NOT IN (SELECT key FROM f) UNION ALL SELECT key, v FROM f"""
)
def k15_idempotent_upsert(spark, sf_dir):
    current = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").cast("double").alias("v"))
    incoming = table(spark, sf_dir, "lineitem").filter("l_partkey % 2 = 0").select(F.col("l_partkey").alias("key"), F.col("l_quantity").alias("v"), "l_shipdate", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("t"))
    order = [F.desc("l_shipdate"), F.col("t")]
    once = M.upsert(current.withColumns({"l_shipdate": F.lit(None).cast("timestamp"), "t": F.lit("")}), incoming, ["key"], order)
    return M.upsert(once, incoming, ["key"], order).select("key", "v")  # twice: nothing changes


@query(
    """SELECT o_custkey AS file_id, o_orderkey AS page FROM orders WHERE o_custkey % 10 <> 0 UNION ALL SELECT o_custkey, o_orderkey + 1000000 FROM orders WHERE o_custkey % 10 = 0 AND o_orderkey % 2 = 0
    UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 10 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 10 = 0 AND o_orderkey % 2 = 0)"""
)
def k16_replace_per_file(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("page"))
    fresh = orders.filter("file_id % 10 = 0 and page % 2 = 0").withColumn("page", F.col("page") + 1000000)
    return M.replace_group(orders, fresh, "file_id")


@query(
    """WITH c AS (SELECT c_custkey AS id, c_name, c_mktsegment, c_acctbal FROM customer), n AS (SELECT id, CASE WHEN id % 3 = 0 THEN upper(c_name) END AS c_name, CASE WHEN id % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM c)
    SELECT c.id, 'c_name' AS field, c.c_name AS old_value, n.c_name AS new_value FROM c JOIN n USING (id) WHERE n.c_name IS NOT NULL AND c.c_name IS DISTINCT FROM n.c_name
    UNION ALL SELECT c.id, 'c_mktsegment', c.c_mktsegment, n.c_mktsegment FROM c JOIN n USING (id) WHERE c.c_mktsegment IS DISTINCT FROM n.c_mktsegment"""
)
def k17_audit_entries(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_mktsegment")
    new = old.select("id", F.when(F.col("id") % 3 == 0, F.upper("c_name")).alias("c_name"), F.when(F.col("id") % 4 == 0, "NEW").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return M.audit_entries(old, new, "id", ["c_name", "c_mktsegment"])


@query(
    """WITH cur AS (SELECT s_suppkey AS id, 'E' || s_suppkey AS epic, s_name AS name FROM supplier),
    ch AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'E' || (s_suppkey - 1) END AS epic, CASE WHEN s_suppkey % 3 = 0 THEN lower(s_name) END AS name, CASE WHEN s_suppkey % 10 = 5 THEN 'delete' ELSE 'update' END AS op FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 10 = 5
      UNION ALL SELECT s_suppkey + 1000000, CASE WHEN s_suppkey % 4 = 0 THEN 'E' || s_suppkey ELSE 'N' || s_suppkey END, s_name, 'create' FROM supplier WHERE s_suppkey % 4 < 2),
    m AS (SELECT id, cur.epic AS oe, cur.name AS o_n, CASE WHEN op IS NULL THEN cur.epic ELSE coalesce(ch.epic, cur.epic) END AS epic, CASE WHEN op IS NULL THEN cur.name ELSE coalesce(ch.name, cur.name) END AS name, op FROM cur FULL JOIN ch USING (id)),
    h AS (SELECT epic, count(*) AS n FROM m WHERE op IS NULL OR op <> 'delete' GROUP BY 1)
    SELECT id, CASE WHEN op IS NOT NULL AND n > 1 THEN oe ELSE epic END AS epic, CASE WHEN op IS NOT NULL AND n > 1 THEN o_n ELSE name END AS name, CASE WHEN op IS NULL THEN 'kept' WHEN n > 1 THEN 'clash' WHEN op = 'create' THEN 'created' ELSE 'updated' END AS status
    FROM m LEFT JOIN h USING (epic) WHERE op IS NULL OR op <> 'delete'"""
)
def b1_merge_changes(spark, sf_dir):
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier")
    current = rows.select(s.alias("id"), F.concat(F.lit("E"), s.cast("string")).alias("epic"), F.col("s_name").alias("name"))
    changes = rows.filter("s_suppkey % 3 = 0 or s_suppkey % 10 = 5").select(
        s.alias("id"), F.when(s % 9 == 0, F.concat(F.lit("E"), (s - 1).cast("string"))).alias("epic"), F.when(s % 3 == 0, F.lower("s_name")).alias("name"), F.when(s % 10 == 5, "delete").otherwise("update").alias("op")
    )
    new = rows.filter("s_suppkey % 4 < 2").select((s + 1000000).alias("id"), F.concat(F.when(s % 4 == 0, "E").otherwise("N"), s.cast("string")).alias("epic"), F.col("s_name").alias("name"), F.lit("create").alias("op"))
    return M.merge_changes(current, changes.unionByName(new), "id", "epic")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)")
def b3_delete_files(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_nationkey = 5").select(F.col("c_custkey").alias("o_custkey"))
    return M.delete_group({"orders": table(spark, sf_dir, "orders")}, gone, "o_custkey")["orders"].select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5) THEN 'pending' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def b4_mark_for_reprocessing(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").filter("c_nationkey = 5").select(F.col("c_custkey").alias("o_custkey"))
    return M.marked(table(spark, sf_dir, "orders"), ids, "o_custkey", {"o_orderstatus": F.lit("pending")}).select("o_orderkey", "o_orderstatus")


@query(
    """WITH j AS (SELECT o_orderkey AS file_id, (3 + o_orderkey % 3)::INT AS page_count, CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'running' ELSE 'completed' END AS status FROM orders), p AS (SELECT l_orderkey AS file_id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT j.file_id, page_count, CASE WHEN status = 'processing' THEN CASE WHEN coalesce(n, 0) >= page_count THEN 'completed' ELSE 'pending' END WHEN status = 'running' THEN 'failed' ELSE status END AS status FROM j LEFT JOIN p USING (file_id)"""
)
def r26_interrupted_work(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "processing").when(F.col("o_orderstatus") == "F", "running").otherwise("completed")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), (3 + F.col("o_orderkey") % 3).cast("int").alias("page_count"), status.alias("status"))
    return M.repaired_jobs(jobs, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id")))


def _page_results(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "failed").otherwise("completed")
    return e.select(
        F.concat(F.lit("J"), (F.col("user_id") % 4).cast("string")).alias("job_id"), F.concat(F.lit("F"), F.col("user_id").cast("string")).alias("file_id"), (F.col("event_id") % 20).cast("int").alias("page_number"), status.alias("status"), F.lit(1).cast("long").alias("records"), F.col("ts").cast("timestamp").alias("ts")
    )


RESULTS = "p AS (SELECT 'J' || user_id % 4 AS job_id, 'F' || user_id AS file_id, (event_id % 20)::INT AS page_number, CASE WHEN event_type = 'view' THEN 'failed' ELSE 'completed' END AS status, 1 AS records, ts FROM events)"


@query(f"WITH {RESULTS} SELECT job_id, file_id, sum((status = 'completed')::INT)::BIGINT AS completed, sum((status = 'failed')::INT)::BIGINT AS failed, count(*) AS total, sum(records)::BIGINT AS records FROM p GROUP BY 1, 2")
def t1_streamed_progress(spark, sf_dir):
    rows = _page_results(spark, sf_dir)
    folder = storage.new_path(spark, "results")
    rows.repartition(3, "page_number").write.parquet(folder)
    out = P.run_available(spark, folder, rows.schema, P.progress, "progress")
    last = out.groupBy("job_id", "file_id").agg(F.max(F.struct("batch", "completed", "failed", "total", "records")).alias("x"))
    return last.select("job_id", "file_id", "x.completed", "x.failed", "x.total", "x.records")


@query(f"WITH {RESULTS} SELECT DISTINCT file_id, page_number FROM p")
def t5_streamed_without_repeats(spark, sf_dir):
    rows = _page_results(spark, sf_dir)
    folder = storage.new_path(spark, "results")
    rows.repartition(2, "page_number").write.parquet(folder)
    out = P.run_available(spark, folder, rows.schema, lambda s: P.without_repeats(s, "4000 days"), "once", mode="append")
    return out.select("file_id", "page_number")


@query(f"WITH {RESULTS} SELECT file_id, page_number, max(ts) AS ts FROM p GROUP BY 1, 2")
def t2_streamed_page_sink(spark, sf_dir):
    rows = _page_results(spark, sf_dir)
    folder = storage.new_path(spark, "results")
    rows.repartition(3, "file_id").write.parquet(folder)
    out = P.run_available(spark, folder, rows.schema, lambda s: s, "sink", mode="append")
    return P.latest_pages(out).select("file_id", "page_number", "ts")


@query(f"WITH {RESULTS} SELECT file_id, count(*) AS pages_in FROM p GROUP BY 1 HAVING count(*) >= 60")
def t3_completed_files(spark, sf_dir):
    counts = P.progress(_page_results(spark, sf_dir))
    files = counts.select("file_id", F.lit(60).alias("page_count")).distinct()
    return P.files_with_all_pages(counts, files)


@query(
    """WITH w AS (SELECT * FROM stream_records WHERE NOT unfinished),
    g0 AS (SELECT file_id, name, count(*) AS votes, sum(confidence) AS conf FROM w GROUP BY ALL),
    g AS (SELECT *, regexp_replace(name, '[aeiou]', '', 'g') AS skeleton, votes * (1 + 0.25 * (length(name) - length(replace(name, 'o', '')))) AS score FROM g0),
    r AS (SELECT *, row_number() OVER v AS rn, lead(name) OVER v AS second, lead(votes) OVER v AS next, sum(votes) OVER (PARTITION BY file_id, skeleton) AS total FROM g WINDOW v AS (PARTITION BY file_id, skeleton ORDER BY score DESC, votes DESC, conf DESC, name DESC)),
    won AS (SELECT file_id, skeleton, name AS winner FROM r WHERE rn = 1 AND total >= 3 AND second IS NOT NULL AND CASE WHEN contains(second, 'a') AND contains(name, 'o') THEN votes >= 0.8 * next ELSE votes > next AND votes >= 3.0 * next END),
    n AS (SELECT file_id, regexp_extract(section_name, '^\\s*(\\d+)', 1) AS number, section_name, count(*) AS n FROM w WHERE trim(section_name) <> '' GROUP BY ALL),
    c AS (SELECT file_id, number, section_name AS canonical FROM n WHERE number <> '' QUALIFY row_number() OVER (PARTITION BY file_id, number ORDER BY n DESC, length(section_name) DESC, section_name DESC) = 1),
    o AS (SELECT w.*, coalesce(winner, w.name) AS said, coalesce(canonical, section_name) AS own FROM w LEFT JOIN c ON w.file_id = c.file_id AND regexp_extract(w.section_name, '^\\s*(\\d+)', 1) = c.number LEFT JOIN won ON won.file_id = w.file_id AND won.skeleton = regexp_replace(w.name, '[aeiou]', '', 'g')),
    s AS (SELECT *, last_value(nullif(trim(own), '') IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY page_number ROWS UNBOUNDED PRECEDING) AS section FROM o),
    p AS (SELECT *, row_number() OVER (PARTITION BY epic ORDER BY error_count, is_deleted DESC, page_number, record_id) AS rn, max(is_deleted) OVER (PARTITION BY epic) AS gone, first_value(deletion_reason) OVER (PARTITION BY epic ORDER BY is_deleted DESC, deletion_reason = '', page_number, record_id) AS stated FROM s)
    SELECT upper(replace(epic, ' ', '')) AS epic, said AS name, section AS section_name, file_id, record_id, gone = 'Yes' AS is_deleted, CASE WHEN gone = 'Yes' AND stated <> '' THEN stated ELSE deletion_reason END AS deletion_reason FROM p WHERE rn = 1""",
    "stream_records",
)
def t3_jobs_on_completion(spark, sf_dir):
    records = storage.stored(bound(spark, sf_dir, "stream_records"), "records")
    placed = records.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("page_number")) - 1).alias("place"), "unfinished")
    files = storage.stored(placed.groupBy("file_id").agg((F.count(F.lit(1)) + F.max("unfinished").cast("int")).alias("page_count")), "files")
    folder = storage.new_path(spark, "arriving")
    arriving = placed.select("file_id", "place")
    arriving.repartition(3, "place").write.parquet(folder)
    arriving.filter("place % 5 = 0").coalesce(1).write.mode("append").parquet(folder)  # delivered again
    pages = records.select("page_id", F.lit("elector_page").alias("page_type"), F.lit("").alias("header_text"))
    names = files.select("file_id", F.col("file_id").alias("file_name"))
    stations = spark.createDataFrame([], "file_id string, station_id string, part_number string, ac_number string, ac_name string, address string")
    current = bound(spark, sf_dir, "raw_current").limit(0)

    def job(done):
        own = records.join(done, "file_id", "left_semi")
        return J.run_file_jobs(own, pages.join(own, "page_id", "left_semi"), names, stations, current, "aeiou", "a", "o")["curated"]

    out = C.run_on_completion(spark, folder, arriving.schema, files, job, "completed")
    return out.select("epic", "name", "section_name", F.col("source_file_id").alias("file_id"), F.col("source_record_id").alias("record_id"), "is_deleted", "deletion_reason")


@query("SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g')) AS text FROM documents")
def x1_nfc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.nfc("text").alias("text"))


@query(
    """SELECT c_custkey, regexp_replace(translate(c_name, 'OoIl|SB', '0011158'), '[^0-9]', '', 'g') AS digits, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS normal,
    coalesce(try_cast(regexp_extract('Roll revision ' || c_custkey % 7 || ' x', '(?i)revision\\s*[-_ ]?\\s*(\\d+)', 1) AS INT), 0) AS revision, regexp_extract(c_custkey || ' - ' || c_name, '^\\s*(\\d+)', 1) AS section,
    trim(regexp_replace(c_name || ' (x)', '\\s*\\([^()]*\\)\\s*$', '')) AS plain FROM customer"""
)
def x5_x7_x15_x17_x23_text_columns(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", X.digits(n).alias("digits"), X.normal_id(n).alias("normal"), X.revision(F.concat(F.lit("Roll revision "), (k % 7).cast("string"), F.lit(" x"))).alias("revision"),
        X.section_number(F.concat(k.cast("string"), F.lit(" - "), n)).alias("section"), X.without_bracket(F.concat(n, F.lit(" (x)"))).alias("plain"),
    )


@query(
    """WITH r AS (SELECT 'AC' || lpad((c_custkey % 90)::VARCHAR, 3, '0') || '-PART-' || c_custkey % 300 || '.pdf' AS f, c_custkey AS k FROM customer)
    SELECT k, try_cast(regexp_extract(f, '(?i)ac[-_ ]?0*(\\d+)', 1) AS INT) AS ac, try_cast(regexp_extract(f, '(?i)part[-_ ]?0*(\\d+)', 1) AS INT) AS part FROM r"""
)
def x16_x36_file_parts(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.concat(F.lit("AC"), F.lpad((k % 90).cast("string"), 3, "0"), F.lit("-PART-"), (k % 300).cast("string"), F.lit(".pdf"))
    ac, part = X.file_parts(F.col("f"))
    return table(spark, sf_dir, "customer").select(k.alias("k"), name.alias("f")).select("k", ac.alias("ac"), part.alias("part"))
