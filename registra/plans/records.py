"""Queries over recognised records, their pages and promotion, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.functions import text as X
from registra.operators import jobs as J
from registra.operators import joins as JN
from registra.operators import layout as LY
from registra.operators import listing as L
from registra.operators import windows as WN
from registra.operators.storage import stored

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


PICK = """latest AS (SELECT *, max(revision) OVER (PARTITION BY epic) AS top FROM candidates),
l AS (SELECT * FROM latest WHERE revision = top),
m AS (SELECT *, max(is_deleted) OVER (PARTITION BY epic) AS deleted,
  first_value(reason) OVER (PARTITION BY epic ORDER BY reason = '', page_number, idx, record_id) AS first_reason,
  row_number() OVER (PARTITION BY epic ORDER BY is_clean DESC, is_deleted DESC, is_supplement DESC, page_number, idx, record_id) AS rn FROM l),
picked AS (SELECT * FROM m WHERE rn = 1)"""


@query(f"WITH {PICK} SELECT epic, record_id, revision, deleted, first_reason FROM picked", "candidates")
def w1_w2_pick_per_identifier(spark, sf_dir):
    return WN.pick_candidates(bound(spark, sf_dir, "candidates")).select("epic", "record_id", "revision", "deleted", "first_reason")


def _current(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_partkey % 3 = 0")
    return p.select(F.col("p_partkey").alias("epic"), F.col("p_size").cast("double").alias("quantity"))


@query(
    f"""WITH {PICK}, cur AS (SELECT p_partkey AS epic, p_size::DOUBLE AS old FROM part WHERE p_partkey % 3 = 0)
    SELECT p.epic, record_id, CASE WHEN cur.epic IS NULL THEN quantity ELSE coalesce(quantity, old) END AS quantity, deleted, CASE WHEN deleted THEN first_reason ELSE '' END AS reason,
    CASE WHEN cur.epic IS NULL THEN 'inserted' WHEN coalesce(quantity, old) IS NOT DISTINCT FROM old THEN 'unchanged' ELSE 'updated' END AS status
    FROM picked p LEFT JOIN cur ON p.epic = cur.epic""",
    "candidates",
)
def r12_promotion_overwrite(spark, sf_dir):
    return J.promote(bound(spark, sf_dir, "candidates"), _current(spark, sf_dir))


@query(
    f"""WITH {PICK.replace("FROM candidates", "FROM candidates WHERE is_clean OR is_deleted")}, cur AS (SELECT p_partkey AS epic, p_size::DOUBLE AS old FROM part WHERE p_partkey % 3 = 0),
    o AS (SELECT CASE WHEN cur.epic IS NULL THEN 'inserted' ELSE 'skipped' END AS status, deleted FROM picked p LEFT JOIN cur ON p.epic = cur.epic)
    SELECT status, deleted, count(*) AS n FROM o GROUP BY ALL""",
    "candidates",
)
def r12_promotion_counts(spark, sf_dir):
    out = J.promote(bound(spark, sf_dir, "candidates"), _current(spark, sf_dir), overwrite=False, only_clean=True)
    return out.groupBy("status", "deleted").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT count(*) AS total, sum((error_count > 0)::INT) AS with_errors, sum((warning_count > 0)::INT) AS with_warnings, sum(edited::INT) AS edited, sum(reviewed::INT) AS reviewed,
    sum((error_count = 0 AND warning_count = 0)::INT) AS clean FROM records""",
    "records",
)
def g3_record_counts(spark, sf_dir):
    n = lambda c, a: F.count_if(c).alias(a)
    e, w = F.col("error_count"), F.col("warning_count")
    return bound(spark, sf_dir, "records").agg(
        F.count(F.lit(1)).alias("total"), n(e > 0, "with_errors"), n(w > 0, "with_warnings"), n(F.col("edited"), "edited"), n(F.col("reviewed"), "reviewed"), n((e == 0) & (w == 0), "clean")
    )


@query(
    """SELECT r.file_id, round(avg(mean_confidence), 6) AS mean_confidence, min(min_confidence) AS min_confidence, sum(error_count)::BIGINT AS errors, count(*) AS records
    FROM records r WHERE r.page_id IN (SELECT page_id FROM records WHERE part_key % 10 = 0) GROUP BY 1""",
    "records",
)
def g13_j7_quality_of_part(spark, sf_dir):
    rows = bound(spark, sf_dir, "records")
    pages = rows.filter("part_key % 10 = 0").select("page_id").distinct()
    out = rows.join(pages, "page_id", "left_semi").groupBy("file_id")
    return out.agg(F.round(F.avg("mean_confidence"), 6).alias("mean_confidence"), F.min("min_confidence").alias("min_confidence"), F.sum("error_count").alias("errors"), F.count(F.lit(1)).alias("records"))


@query("SELECT record_id, page_id FROM records WHERE error_count > 0 AND NOT reviewed AND mean_confidence BETWEEN 0.9 AND 0.95 AND contains(search_text, 'supp 1')", "records")
def p4_record_list(spark, sf_dir):
    wanted = L.predicates({"reviewed": False}, {"mean_confidence": (0.9, 0.95), "error_count": (1, None)}, {"search_text": "supp 1"})
    return bound(spark, sf_dir, "records").filter(L.all_of(wanted)).select("record_id", "page_id")


@query("SELECT record_id, mean_confidence FROM records WHERE mean_confidence < 0.93 ORDER BY mean_confidence, record_id LIMIT 50", "records")
def p9_low_confidence(spark, sf_dir):
    return bound(spark, sf_dir, "records").filter("mean_confidence < 0.93").select("record_id", "mean_confidence").orderBy("mean_confidence", "record_id").limit(50)


@query("SELECT record_id FROM records WHERE NOT reviewed AND error_count = 0 AND warning_count = 0 AND mean_confidence >= 0.85", "records")
def p19_auto_accept(spark, sf_dir):
    return bound(spark, sf_dir, "records").filter("not reviewed and error_count = 0 and warning_count = 0 and mean_confidence >= 0.85").select("record_id")


@query(
    """SELECT file_id, part_key::VARCHAR AS epic, count(*) AS n, array_to_string(list_sort(list(record_id))[1:5], ',') AS first_records FROM records GROUP BY 1, 2 HAVING count(*) > 1""", "records"
)
def g14_j17_duplicate_identifiers(spark, sf_dir):
    # counted first; only the records of repeated identifiers are ranked, and five of each are kept
    rows = bound(spark, sf_dir, "records").select("file_id", F.col("part_key").cast("string").alias("epic"), "record_id")
    many = rows.groupBy("file_id", "epic").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    way = Window.partitionBy("file_id", "epic").orderBy("record_id")
    first = rows.join(many, ["file_id", "epic"]).withColumn("rn", F.row_number().over(way)).filter("rn <= 5")
    return first.groupBy("file_id", "epic", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "record_id"))), lambda x: x["record_id"]), ",").alias("first_records"))


@query(
    """SELECT o_orderkey AS page_id, o_orderstatus AS status, count(l_orderkey) AS records, coalesce(sum((l_tax > 0.05)::INT), 0)::BIGINT AS errors FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2"""
)
def s9_page_index(spark, sf_dir):
    counts = bound(spark, sf_dir, "records").groupBy("page_id").agg(F.count(F.lit(1)).alias("records"), F.sum("error_count").alias("errors"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderstatus").alias("status"))
    return pages.join(counts, "page_id", "left").fillna(0, ["records", "errors"])


@query(
    """SELECT c_custkey AS file_id, count(o_orderkey) AS pages, CASE WHEN coalesce(sum(o_totalprice), 0) > 0 THEN round(sum(o_totalprice) / 1000, 1) END AS ocr_seconds FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
    ORDER BY file_id DESC LIMIT 200"""
)
def s10_file_list(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("file_id")).agg(F.count(F.lit(1)).alias("pages"), F.sum("o_totalprice").alias("ms"))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id")).join(spent, "file_id", "left").fillna(0, ["pages"])
    return files.select("file_id", "pages", F.when(F.col("ms") > 0, F.round(F.col("ms") / 1000, 1)).alias("ocr_seconds")).orderBy(F.desc("file_id")).limit(200)


@query(
    """WITH n AS (SELECT file_id, regexp_extract(section, '^\\s*(\\d+)', 1) AS number, section, count(*) AS n FROM headed WHERE trim(section) <> '' GROUP BY ALL)
    SELECT file_id, number, section AS canonical FROM n WHERE number <> '' QUALIFY row_number() OVER (PARTITION BY file_id, number ORDER BY n DESC, length(section) DESC, section DESC) = 1""",
    "headed",
)
def g23_section_names(spark, sf_dir):
    return J.section_names(bound(spark, sf_dir, "headed"), "file_id", "section", X.section_number(F.col("section")))


@query(
    """WITH n AS (SELECT file_id, regexp_extract(section, '^\\s*(\\d+)', 1) AS number, section, count(*) AS n FROM headed WHERE trim(section) <> '' GROUP BY ALL),
    c AS (SELECT file_id, number, section AS canonical FROM n WHERE number <> '' QUALIFY row_number() OVER (PARTITION BY file_id, number ORDER BY n DESC, length(section) DESC, section DESC) = 1),
    o AS (SELECT h.*, coalesce(canonical, section) AS own FROM headed h LEFT JOIN c ON h.file_id = c.file_id AND regexp_extract(h.section, '^\\s*(\\d+)', 1) = c.number),
    s AS (SELECT *, coalesce(last_value(nullif(trim(own), '') IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY page_number ROWS UNBOUNDED PRECEDING), '') AS reconciled FROM o)
    SELECT record_id, reconciled, trim(section) = '' AND reconciled <> '' AS carried FROM s""",
    "headed",
)
def r16_w3_sections(spark, sf_dir):
    rows = J.reconcile_sections(bound(spark, sf_dir, "headed"), "file_id", "page_number", "section", X.section_number(F.col("section")))
    return rows.select("record_id", "reconciled", "carried")


@query(
    """WITH s AS (SELECT *, lag(serial) OVER (PARTITION BY file_id ORDER BY page_number) AS previous, count(*) OVER (PARTITION BY file_id) AS n FROM headed)
    SELECT record_id, serial, previous FROM s WHERE n >= 3 AND serial <> previous + 1""",
    "headed",
)
def w4_sequence_breaks(spark, sf_dir):
    return WN.sequence_breaks(bound(spark, sf_dir, "headed"), ["file_id"], [F.col("page_number")], "serial").select("record_id", "serial", "previous")


@query(
    """SELECT record_id, first_value(record_id) OVER w AS first_seen FROM headed WINDOW w AS (PARTITION BY file_id, serial ORDER BY page_number) QUALIFY row_number() OVER w > 1""", "headed"
)
def w5_w6_repeats(spark, sf_dir):
    return WN.repeats(bound(spark, sf_dir, "headed"), ["file_id", "serial"], [F.col("page_number")], "record_id").select("record_id", "first_seen")


@query(
    """WITH g AS (SELECT record_id, file_id, page_number, CASE WHEN serial - lag(serial) OVER (PARTITION BY file_id ORDER BY page_number) > 5 THEN 1 ELSE 0 END AS jump FROM headed)
    SELECT record_id, sum(jump) OVER (PARTITION BY file_id ORDER BY page_number ROWS UNBOUNDED PRECEDING)::BIGINT AS chunk FROM g""",
    "headed",
)
def w7_chunks(spark, sf_dir):
    return WN.chunks(bound(spark, sf_dir, "headed"), ["file_id"], [F.col("page_number")], "serial", 5).select("record_id", "chunk")


@query(
    """WITH g AS (SELECT record_id, file_id, value, CASE WHEN value - lag(value) OVER w > 1.5 THEN 1 ELSE 0 END AS jump FROM headed WINDOW w AS (PARTITION BY file_id ORDER BY value, record_id))
    SELECT record_id, sum(jump) OVER (PARTITION BY file_id ORDER BY value, record_id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g""",
    "headed",
)
def w19_clusters(spark, sf_dir):
    return WN.chunks(bound(spark, sf_dir, "headed"), ["file_id"], [F.col("value"), F.col("record_id")], "value", 1.5, "cluster").select("record_id", "cluster")


@query("SELECT file_id, event_type, arg_min(page_number, page_number) AS first_page FROM headed GROUP BY ALL", "headed")
def w14_first_page_of_type(spark, sf_dir):
    return bound(spark, sf_dir, "headed").groupBy("file_id", "event_type").agg(F.min("page_number").alias("first_page"))


@query("SELECT file_id, serial, record_id FROM headed QUALIFY row_number() OVER (PARTITION BY file_id, serial ORDER BY ts DESC NULLS LAST, record_id) = 1", "headed")
def w15_newest_row(spark, sf_dir):
    return J.newest(bound(spark, sf_dir, "headed"), ["file_id", "serial"], "ts", "record_id").select("file_id", "serial", "record_id")


TOKENS = """t AS (SELECT source, unnest(string_split_regex(lower(text), '[^a-zäöüéèíóñ]+')) AS word, n_chars FROM documents)"""
GROUPS = f"""{TOKENS}, g0 AS (SELECT source, word, count(*) AS votes, sum(n_chars)::DOUBLE AS conf FROM t WHERE length(word) > 3 GROUP BY ALL),
    g AS (SELECT *, regexp_replace(word, '[aeiouäöüéèíóñ]', '', 'g') AS skeleton, votes * (1 + 0.25 * (length(word) - length(regexp_replace(word, '[äöüéíó]', '', 'g')))) AS score FROM g0),
    r AS (SELECT *, row_number() OVER w AS rn, lead(word) OVER w AS runner_up, lead(votes) OVER w AS next, sum(votes) OVER (PARTITION BY source, skeleton) AS total FROM g WHERE skeleton <> ''
      WINDOW w AS (PARTITION BY source, skeleton ORDER BY score DESC, votes DESC, conf DESC, word DESC)),
    won AS (SELECT source, skeleton, word AS winner, runner_up, votes, total::BIGINT AS total FROM r WHERE rn = 1 AND total >= 3 AND runner_up IS NOT NULL
      AND CASE WHEN regexp_matches(runner_up, '[aeo]') AND regexp_matches(word, '[äöüéíó]') THEN votes >= 0.8 * next ELSE votes > next AND votes >= 3.0 * next END)"""


def _words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("source", F.explode(F.split(F.lower("text"), "[^a-zäöüéèíóñ]+")).alias("word"), F.col("n_chars").cast("double").alias("conf"))
    return words.filter(F.length("word") > 3)


def _winners(spark, sf_dir):
    return J.consensus(_words(spark, sf_dir), "source", "word", X.skeleton(F.col("word"), "[aeiouäöüéèíóñ]"), "conf", "aeo", "äöüéíó")


@query(f"WITH {GROUPS} SELECT * FROM won")
def r11_w8_spelling_consensus(spark, sf_dir):
    return _winners(spark, sf_dir)


@query(
    f"""WITH {GROUPS}, f AS (SELECT doc_id, source, regexp_extract(lower(text), '^[^a-zäöüéèíóñ]*([a-zäöüéèíóñ]+)', 1) AS first, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE regexp_extract(lower(text), '([a-zäöüéèíóñ]+)[^a-zäöüéèíóñ]*$', 1) END AS last FROM documents),
    e AS (SELECT *, trim(coalesce(last, first, '')) AS v FROM f)
    SELECT doc_id, CASE WHEN v <> '' AND winner <> v THEN winner ELSE last END AS edited_value, CASE WHEN v <> '' AND winner <> v THEN winner END AS suggested_value,
      CASE WHEN v <> '' AND winner <> v THEN 'Spelling harmonised to ' || chr(39) || winner || chr(39) || ' (OCR read ' || chr(39) || first || chr(39) || '); the majority reading across this batch' END AS spelling_issue
    FROM e LEFT JOIN won ON won.source = e.source AND won.skeleton = regexp_replace(e.v, '[aeiouäöüéèíóñ]', '', 'g')"""
)
def r11_suggestions_written_back(spark, sf_dir):
    low, word = F.lower("text"), "[a-zäöüéèíóñ]+"
    first = F.regexp_extract(low, f"^[^a-zäöüéèíóñ]*({word})", 1)
    last = F.when(F.col("doc_id") % 5 != 0, F.regexp_extract(low, f"({word})[^a-zäöüéèíóñ]*$", 1))
    fields = table(spark, sf_dir, "documents").select("doc_id", "source", first.alias("original_value"), last.alias("edited_value"))
    out = J.harmonised(fields, stored(_winners(spark, sf_dir), "winners"), "source", X.skeleton(F.col("_v"), "[aeiouäöüéèíóñ]"))
    return out.select("doc_id", "edited_value", "suggested_value", "spelling_issue")


@query(
    """SELECT l_orderkey, l_linenumber, list_sort(list_filter([CASE WHEN l_tax > 0.05 THEN 'required:error' END, CASE WHEN l_discount > 0.08 THEN 'low_confidence:warning' END, CASE WHEN l_quantity < 3 THEN 'age:error' END], lambda x: x IS NOT NULL)) AS issues
    FROM lineitem WHERE l_tax > 0.05 OR l_discount > 0.08 OR l_quantity < 3"""
)
def r8_validation(spark, sf_dir):
    found = J.issues((F.col("l_tax") > 0.05, "required", "error"), (F.col("l_discount") > 0.08, "low_confidence", "warning"), (F.col("l_quantity") < 3, "age", "error"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found.alias("i")).filter(F.size("i") > 0)
    return rows.select("l_orderkey", "l_linenumber", F.sort_array(F.transform("i", lambda x: F.concat(x["code"], F.lit(":"), x["severity"]))).alias("issues"))


@query(
    """SELECT a.l_partkey AS cell, a.reading FROM (SELECT l_partkey, (15 + l_suppkey % 8)::INT AS reading, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, (15 + l_suppkey % 8)) AS rn FROM lineitem WHERE (15 + l_suppkey % 8) BETWEEN 18 AND 120) a
    JOIN (SELECT l_partkey, (15 + l_suppkey % 8)::INT AS reading, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, (15 + l_suppkey % 8)) AS rn FROM lineitem WHERE (15 + l_suppkey % 8) BETWEEN 18 AND 120) b
    ON a.l_partkey = b.l_partkey AND a.rn = 1 AND b.rn = 2 AND a.reading = b.reading"""
)
def r18_agreed_readings(spark, sf_dir):
    readings = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cell"), F.col("l_orderkey").alias("seq"), (15 + F.col("l_suppkey") % 8).cast("int").alias("reading"))
    return J.agreed_readings(readings, "cell", "seq", "reading")


@query(
    """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'count') OR contains(lower(text), 'total') THEN 'data' WHEN contains(lower(text), 'please') OR contains(lower(text), 'explain') THEN 'howto'
    WHEN len(list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{M}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('hello', 'thanks', 'the', 'and', 'of'))) = 0 THEN 'smalltalk' ELSE 'data' END AS route FROM conversations"""
)
def r22_question_routes(spark, sf_dir):
    route = J.route(F.col("text"), ["please", "explain"], ["count", "total"], ["hello", "thanks", "the", "and", "of"])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", route.alias("route"))


@query(
    """WITH s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s, unnest(range(0, len(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))))) AS pos FROM documents),
    e AS (SELECT DISTINCT user_id, regexp_extract(props, '\\d+') AS n FROM events),
    u AS (SELECT doc_id, pos, unnest(regexp_extract_all(s, '\\d+(?:\\.\\d+)?')) AS n FROM s),
    bad AS (SELECT DISTINCT u.doc_id, pos FROM u LEFT JOIN e ON e.user_id = u.doc_id % 150 AND e.n = u.n WHERE e.n IS NULL)
    SELECT s.doc_id, coalesce(string_agg(CASE WHEN bad.pos IS NULL THEN s.s END, ' ' ORDER BY s.pos), '') AS text, count(bad.pos) AS dropped FROM s LEFT JOIN bad ON s.doc_id = bad.doc_id AND s.pos = bad.pos GROUP BY s.doc_id"""
)
def r24_grounded_replies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "events").select("user_id", F.regexp_extract("props", r"\d+", 0).alias("n")).distinct()
    evidence = docs.select("doc_id", (F.col("doc_id") % 150).alias("user_id")).join(known, "user_id").select("doc_id", "n")
    return J.grounded(docs, "doc_id", "text", evidence, "n")


@query(
    """WITH a AS (SELECT * FROM lineitem)
    SELECT a.l_orderkey, a.l_linenumber, a.l_suppkey, s.s_suppkey FROM a LEFT JOIN supplier s ON a.l_suppkey = s.s_suppkey OR (a.l_linenumber = s.s_nationkey AND a.l_partkey % 10 = s.s_suppkey % 10)"""
)
def j3_either_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") % 10).alias("digit"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 10).alias("s_digit"))
    out = JN.either_join(lines, suppliers, "l_orderkey", "s_suppkey", (["l_suppkey"], ["s_suppkey"]), (["l_linenumber", "digit"], ["s_nationkey", "s_digit"]))
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "s_suppkey")


@query("SELECT a.part_number, a.id AS a, b.id AS b, abs(a.serial - b.serial)::INT AS distance FROM electors a JOIN electors b ON a.part_number = b.part_number AND a.id <> b.id AND abs(a.serial - b.serial) <= 15", "electors")
def j12_serial_range(spark, sf_dir):
    pairs = JN.near_numbers(bound(spark, sf_dir, "electors"), "part_number", "serial", "id", 15)
    return pairs.select("part_number", "a", "b", F.col("distance").cast("int").alias("distance"))


@query(
    r"""WITH k AS (SELECT id, part_number, regexp_extract(regexp_replace(trim(house_number), '[-\s./]+', '-', 'g'), '^(\d+-\d+)', 1) AS b FROM residents)
    SELECT part_number, b AS building, count(*) AS members, min(id) AS first_id FROM k WHERE b <> '' GROUP BY 1, 2 HAVING count(*) > 1""",
    "residents",
)
def j11_buildings(spark, sf_dir):
    keyed = bound(spark, sf_dir, "residents").withColumn("building", X.building_key(F.col("house_number"))).filter("building is not null")
    return keyed.groupBy("part_number", "building").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id")).filter("members > 1")


@query(
    """WITH f AS (SELECT s.station_id, e.id, 'first' AS matched_by FROM stations s JOIN electors e ON s.file_id = e.file_id),
    r AS (SELECT s.station_id, e.id, 'second' FROM stations s JOIN electors e ON s.ac_number = substr(e.constituency, 1, 1) WHERE s.station_id NOT IN (SELECT station_id FROM f))
    SELECT * FROM f UNION ALL SELECT * FROM r""",
    "electors",
    "stations",
)
def j19_match_with_fallback(spark, sf_dir):
    people = bound(spark, sf_dir, "electors")
    first = people.select("file_id", "id")
    second = people.select(F.substring("constituency", 1, 1).alias("ac_number"), "id")
    return JN.with_fallback(bound(spark, sf_dir, "stations"), first, second, ["file_id"], ["ac_number"]).select("station_id", "id", "matched_by")


@query(
    """SELECT part_number, serial FROM (SELECT part_number, unnest(range(1, 41))::INT AS serial FROM stations) ANTI JOIN (SELECT DISTINCT part_number, serial FROM electors) e USING (part_number, serial)""", "electors", "stations"
)
def j21_missing_serials(spark, sf_dir):
    groups = bound(spark, sf_dir, "stations").select("part_number", F.lit(40).alias("upto"))
    return JN.missing_numbers(groups, bound(spark, sf_dir, "electors"), "part_number", "serial", "upto")


@query(
    """SELECT s.station_id, s.name, s.payload::JSON ->> '$.cover.taluk' AS taluk, coalesce(s.total_electors, (s.payload::JSON ->> '$.cover.total')::INT, 0) AS total, coalesce(c.n, 0) AS extracted
    FROM stations s LEFT JOIN (SELECT part_number, count(*) AS n FROM electors GROUP BY 1) c USING (part_number)""",
    "electors",
    "stations",
)
def j1_j2_j9_station_details(spark, sf_dir):
    counts = bound(spark, sf_dir, "electors").groupBy("part_number").agg(F.count(F.lit(1)).alias("extracted"))
    out = bound(spark, sf_dir, "stations").join(counts, "part_number", "left").fillna(0, ["extracted"])
    total = F.coalesce("total_electors", F.get_json_object("payload", "$.cover.total").try_cast("int"), F.lit(0))
    return out.select("station_id", "name", F.get_json_object("payload", "$.cover.taluk").alias("taluk"), total.alias("total"), "extracted")


@query(
    """SELECT s.station_id, s.total_electors AS declared, coalesce(c.n, 0) AS extracted, coalesce(c.n, 0) - s.total_electors AS difference FROM stations s LEFT JOIN (SELECT part_number, count(*) AS n FROM electors GROUP BY 1) c USING (part_number)
    WHERE s.total_electors > 0 AND coalesce(c.n, 0) <> s.total_electors""",
    "electors",
    "stations",
)
def g15_count_mismatch(spark, sf_dir):
    counts = bound(spark, sf_dir, "electors").groupBy("part_number").agg(F.count(F.lit(1)).alias("n"))
    out = bound(spark, sf_dir, "stations").filter("total_electors > 0").join(counts, "part_number", "left").withColumn("extracted", F.coalesce("n", F.lit(0)))
    return out.filter("extracted != total_electors").select("station_id", F.col("total_electors").alias("declared"), "extracted", (F.col("extracted") - F.col("total_electors")).alias("difference"))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) <= 3")
def j25_last_turns(spark, sf_dir):
    from pyspark.sql.window import Window

    way = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return table(spark, sf_dir, "conversations").withColumn("_rn", F.row_number().over(way)).filter("_rn <= 3").drop("_rn")


@query(
    """WITH l AS (SELECT * FROM boxes WHERE text = 'label'), v AS (SELECT * FROM boxes WHERE text <> 'label')
    SELECT l.page_id, l.line_id AS label_id, v.line_id AS value_id, abs(l.y + l.h / 2 - v.y - v.h / 2) AS off FROM l JOIN v ON l.page_id = v.page_id AND v.x >= l.x + l.w AND abs(l.y + l.h / 2 - v.y - v.h / 2) <= 30
    QUALIFY row_number() OVER (PARTITION BY l.page_id, l.line_id ORDER BY off, v.x, v.line_id) = 1""",
    "boxes",
)
def j15_value_right_of_label(spark, sf_dir):
    rows = bound(spark, sf_dir, "boxes")
    return JN.nearest_right(rows.filter("text = 'label'"), rows.filter("text != 'label'"), "page_id", "line_id", F.lit(30.0))


@query(
    """WITH a AS (SELECT page_id, min(y) AS f FROM boxes WHERE contains(text, '1') GROUP BY 1), b AS (SELECT x.page_id, min(y) AS t FROM boxes x JOIN a USING (page_id) WHERE contains(text, '9') AND y > f GROUP BY 1)
    SELECT page_id, line_id FROM boxes JOIN a USING (page_id) JOIN b USING (page_id) WHERE y > f AND y < t""",
    "boxes",
)
def j16_between_anchors(spark, sf_dir):
    return JN.between_anchors(bound(spark, sf_dir, "boxes"), "page_id", "y", "text", "1", "9").select("page_id", "line_id")


CELLS = """cells AS (SELECT DISTINCT l_orderkey AS page_id, l_linenumber AS cell, (l_linenumber % 3) * 300.0 AS cx, floor(l_linenumber / 3.0) * 60.0 AS cy, 250.0 AS cw, 50.0 AS ch FROM lineitem)"""


@query(
    f"""WITH {CELLS}, d AS (SELECT b.page_id, b.line_id, cell, sqrt(pow(greatest(cx - (x + w / 2), x + w / 2 - cx - cw, 0), 2) + pow(greatest(cy - (y + h / 2), y + h / 2 - cy - ch, 0), 2)) AS d FROM boxes b JOIN cells USING (page_id)),
    n AS (SELECT page_id, line_id, cell FROM d WHERE d < 15 QUALIFY row_number() OVER (PARTITION BY page_id, line_id ORDER BY d, cell) = 1)
    SELECT b.page_id, b.line_id, n.cell FROM boxes b LEFT JOIN n ON b.page_id = n.page_id AND b.line_id = n.line_id""",
    "boxes",
)
def r4_j14_lines_to_cells(spark, sf_dir):
    n = F.col("l_linenumber")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), n.alias("cell")).distinct().withColumns(
        {"cx": (F.col("cell") % 3) * 300.0, "cy": F.floor(F.col("cell") / 3.0) * 60.0, "cw": F.lit(250.0), "ch": F.lit(50.0)}
    )
    return JN.lines_to_cells(bound(spark, sf_dir, "boxes"), cells, "page_id", "line_id", "cell")


@query(
    """WITH t AS (SELECT DISTINCT page_id, y FROM boxes), s AS (SELECT page_id, y, y - lag(y) OVER (PARTITION BY page_id ORDER BY y) AS step FROM t), p AS (SELECT page_id, median(step) AS pitch, max(y) - min(y) AS span FROM s GROUP BY 1)
    SELECT page_id, pitch, greatest(1, coalesce(round(span / pitch) + 1, 1))::INT AS n_rows FROM p""",
    "boxes",
)
def w11_median_pitch(spark, sf_dir):
    return WN.median_pitch(bound(spark, sf_dir, "boxes"), ["page_id"], "y")


@query(
    """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, line_id) AS i FROM boxes),
    b AS (SELECT page_id, line_id, i, y, y AS start, 1 AS band FROM o WHERE i = 1
      UNION ALL SELECT o.page_id, o.line_id, o.i, o.y, CASE WHEN o.y - b.start > 10 THEN o.y ELSE b.start END, b.band + CASE WHEN o.y - b.start > 10 THEN 1 ELSE 0 END FROM b JOIN o ON o.page_id = b.page_id AND o.i = b.i + 1)
    SELECT page_id, max(band)::INT AS bands, count(*) AS lines FROM b GROUP BY 1""",
    "boxes",
)
def w9_w10_bands(spark, sf_dir):
    rows = LY.banded(bound(spark, sf_dir, "boxes"), "page_id", "y", "line_id", 10.0)
    return rows.groupBy("page_id").agg(F.max("band").alias("bands"), F.count(F.lit(1)).alias("lines"))


ORDERED = """o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, {id}) AS i FROM {cells}),
    f AS (
      SELECT page_id, {id}, i, x, y, w, h, [{{'m': y + h / 2, 'h': h}}] AS open, 0::BIGINT AS slot FROM o WHERE i = 1
      UNION ALL SELECT page_id, {id}, i, x, y, w, h, CASE WHEN k IS NULL THEN list_append(open, {{'m': y + h / 2, 'h': h}}) ELSE open END, coalesce(k - 1, len(open)) FROM (
        SELECT o.*, f.open, list_filter(range(1, len(f.open) + 1), lambda j: abs(o.y + o.h / 2 - f.open[j].m) < greatest(f.open[j].h, o.h) * 0.5)[1] AS k FROM f JOIN o ON o.page_id = f.page_id AND o.i = f.i + 1)),
    placed AS (SELECT page_id, {id}, x, y, w, h, slot::INT AS row, (row_number() OVER (PARTITION BY page_id ORDER BY slot, x, y, {id}) - 1)::INT AS place FROM f)"""


@query("WITH RECURSIVE " + ORDERED.format(id="line_id", cells="boxes") + " SELECT page_id, line_id, row, place FROM placed", "boxes")
def w10_reading_order(spark, sf_dir):
    return LY.reading_order(bound(spark, sf_dir, "boxes"), "page_id", "line_id").select("page_id", "line_id", "row", "place")


@query(
    "WITH RECURSIVE "
    + ORDERED.format(id="cell", cells="grid_cells")
    + """, g AS (SELECT page_id, grid, r * cols + c AS place, c * (1000.0 / cols) AS gx, r * (160.0 / rows) AS gy, 1000.0 / cols AS gw, 160.0 / rows AS gh
      FROM (SELECT DISTINCT page_id FROM grid_cells), (VALUES ('3x3', 3, 3), ('4x2', 4, 2), ('4x3', 4, 3)) v(grid, rows, cols), range(0, 4) a(r), range(0, 3) b(c) WHERE r < rows AND c < cols),
    n AS (SELECT page_id, count(*) AS n FROM placed GROUP BY 1), m AS (SELECT page_id, grid, count(*) AS m FROM g GROUP BY 1, 2),
    k AS (SELECT page_id, grid, greatest(0, least(x + w, gx + gw) - greatest(x, gx)) * greatest(0, least(y + h, gy + gh) - greatest(y, gy)) AS i, w * h + gw * gh AS u FROM placed JOIN g USING (page_id, place)),
    d AS (SELECT page_id, grid, CASE WHEN n = m THEN 1 - (SELECT avg(i / (u - i)) FROM k WHERE k.page_id = m.page_id AND k.grid = m.grid) ELSE 1.0 END AS deviation FROM m JOIN n USING (page_id))
    SELECT page_id, grid, round(deviation, 6) AS deviation FROM d QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY deviation, grid) = 1""",
    "grid_cells",
)
def w12_best_grid(spark, sf_dir):
    cells = bound(spark, sf_dir, "grid_cells")
    shapes = F.explode(F.array(*[F.struct(F.lit(f"{r}x{c}").alias("grid"), F.lit(r).alias("rows"), F.lit(c).alias("cols")) for r, c in ((3, 3), (4, 2), (4, 3))]))
    grids = spark.range(0, 1, 1, 1).select(shapes.alias("g")).select("g.*").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("rows") * F.col("cols") - 1)))
    w, h = F.lit(1000.0) / F.col("cols"), F.lit(160.0) / F.col("rows")
    grids = grids.select("grid", "place", ((F.col("place") % F.col("cols")) * w).alias("x"), (F.floor(F.col("place") / F.col("cols")) * h).alias("y"), w.alias("w"), h.alias("h"))
    best = LY.best_grids(LY.grid_deviations(cells, grids, "page_id", "cell"), "page_id")
    return best.select("page_id", "grid", F.round("deviation", 6).alias("deviation"))


@query(
    """WITH n AS (SELECT page_id, count(*) AS n FROM grid_cells GROUP BY 1),
    r AS (SELECT page_id, cell // 3 AS i, avg(y + h / 2) AS c FROM grid_cells JOIN n USING (page_id) WHERE n = 12 GROUP BY ALL), c AS (SELECT page_id, cell % 3 AS i, avg(x + w / 2) AS c FROM grid_cells JOIN n USING (page_id) WHERE n = 12 GROUP BY ALL),
    rs AS (SELECT page_id, median(step) AS p, min_by(c, i) AS c0 FROM (SELECT *, c - lag(c) OVER (PARTITION BY page_id ORDER BY i) AS step FROM r) GROUP BY 1), cs AS (SELECT page_id, median(step) AS p, min_by(c, i) AS c0 FROM (SELECT *, c - lag(c) OVER (PARTITION BY page_id ORDER BY i) AS step FROM c) GROUP BY 1),
    whole AS (SELECT b.page_id, line_id, (SELECT min(k) FROM range(0, 4) t(k) WHERE b.y + b.h / 2 >= rs.c0 - rs.p * 0.5 + k * rs.p AND b.y + b.h / 2 < rs.c0 - rs.p * 0.5 + (k + 1) * rs.p) AS i, (SELECT min(k) FROM range(0, 3) t(k) WHERE b.x + b.w / 2 >= cs.c0 - cs.p * 0.5 + k * cs.p AND b.x + b.w / 2 < cs.c0 - cs.p * 0.5 + (k + 1) * cs.p) AS j
      FROM boxes b JOIN rs USING (page_id) JOIN cs USING (page_id)),
    d AS (SELECT b.page_id, b.line_id, g.cell, sqrt(greatest(g.x - (b.x + b.w / 2), 0, b.x + b.w / 2 - g.x - g.w) ** 2 + greatest(g.y - (b.y + b.h / 2), 0, b.y + b.h / 2 - g.y - g.h) ** 2) AS d FROM boxes b JOIN n USING (page_id) JOIN grid_cells g USING (page_id) WHERE n <> 12),
    near AS (SELECT page_id, line_id, cell FROM d WHERE d < 15 QUALIFY row_number() OVER (PARTITION BY page_id, line_id ORDER BY d, cell) = 1)
    SELECT page_id, line_id, (i * 3 + j)::INT AS cell FROM whole UNION ALL SELECT b.page_id, b.line_id, near.cell FROM boxes b LEFT JOIN near USING (page_id, line_id) WHERE b.page_id NOT IN (SELECT page_id FROM n WHERE n = 12)""",
    "boxes",
    "grid_cells",
)
def j13_lines_in_grid(spark, sf_dir):
    return LY.lines_in_grid(bound(spark, sf_dir, "boxes"), bound(spark, sf_dir, "grid_cells"), "page_id", "line_id", "cell", 4, 3)
