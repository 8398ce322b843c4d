"""Queries over the curated table of electors, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from registra.functions import text as X
from registra.operators import infographic as G
from registra.operators import listing as L

from .bindings import bound, table, twin

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str, *names: str):
    """Register a query under its function's name with its SQL twin over the bound ``names``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = twin(sql, *names)
        return f

    return add


BAND = "CASE WHEN age BETWEEN 18 AND 25 THEN '18-25' WHEN age BETWEEN 26 AND 40 THEN '26-40' WHEN age BETWEEN 41 AND 60 THEN '41-60' WHEN age >= 61 THEN '60+' ELSE 'Unknown' END"


@query(
    f"""WITH p AS (SELECT {BAND} AS label, count(*) AS value FROM electors WHERE gender = 'Female' GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rank FROM p),
    f AS (SELECT CASE WHEN rank <= 3 THEN label ELSE 'Other' END AS label, least(rank, 4) AS rank, sum(value) AS value FROM r GROUP BY ALL)
    SELECT label, value::DOUBLE AS value, round(value * 100.0 / sum(value) OVER (), 1) AS share, rank::INT AS rank FROM f""",
    "electors",
)
def g6_infographic(spark, sf_dir):
    return G.infographic(bound(spark, sf_dir, "electors"), G.Spec("voter_count", "age_band", {"gender": "Female", "colour": "red"}, limit=3))


@query(
    """WITH p AS (SELECT coalesce(constituency, '(not recorded)') AS label, round(avg(CASE WHEN age >= 18 THEN age END), 1) AS value FROM electors GROUP BY 1)
    SELECT label, value::DOUBLE AS value, NULL::DOUBLE AS share, (row_number() OVER (ORDER BY value DESC, label))::INT AS rank FROM p QUALIFY rank <= 12""",
    "electors",
)
def g4_average_age(spark, sf_dir):
    return G.infographic(bound(spark, sf_dir, "electors"), G.Spec("average_age", "constituency"))


@query(
    """WITH p AS (SELECT part_number AS label, sum(is_deleted::INT) AS value FROM electors WHERE age >= 30 AND verified GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY value DESC, label) AS rank FROM p),
    f AS (SELECT CASE WHEN rank <= 12 THEN label ELSE 'Other' END AS label, least(rank, 13) AS rank, sum(value) AS value FROM r GROUP BY ALL)
    SELECT label, value::DOUBLE AS value, round(value * 100.0 / sum(value) OVER (), 1) AS share, rank::INT AS rank FROM f""",
    "electors",
)
def g7_top_parts_and_other(spark, sf_dir):
    return G.infographic(bound(spark, sf_dir, "electors"), G.Spec("deleted_count", "part_number", {"min_age": 30, "verified": True}))


@query(
    """WITH p AS (SELECT coalesce(relation_type, '(not recorded)') AS label, sum(verified::INT) AS value FROM electors GROUP BY 1)
    SELECT (SELECT count(*) FROM electors) AS population, (SELECT sum(verified::INT)::DOUBLE FROM electors) AS total, label AS top_label, value::DOUBLE AS top_value
    FROM p ORDER BY value DESC, label DESC LIMIT 1""",
    "electors",
)
def g9_highlights(spark, sf_dir):
    return G.highlights(bound(spark, sf_dir, "electors"), G.Spec("verified_count", "relation_type"))


DECADE = "CASE WHEN age IS NULL THEN NULL WHEN age >= 90 THEN '90+' ELSE (floor(age / 10.0) * 10)::INT || '-' || ((floor(age / 10.0) * 10)::INT + 9) END"


@query(
    f"""WITH e AS (SELECT coalesce(gender, 'Unknown') AS g, coalesce(relation_type, 'Unknown') AS r, {DECADE} AS d, verified, age FROM electors),
    x AS (SELECT 'total' AS facet, '' AS label, * FROM e UNION ALL SELECT 'gender', g, * FROM e UNION ALL SELECT 'relation', r, * FROM e UNION ALL SELECT 'decade', coalesce(d, ''), * FROM e)
    SELECT facet, label, count(*) AS n, sum(verified::INT) AS verified, round(avg(age), 1) AS average_age, sum((age IS NULL)::INT) AS missing_age FROM x GROUP BY facet, label""",
    "electors",
)
def g1_dashboard(spark, sf_dir):
    return G.dashboard(bound(spark, sf_dir, "electors"))


@query("SELECT part_number, count(*) AS n FROM electors GROUP BY 1 ORDER BY n DESC, part_number LIMIT 20", "electors")
def o3_top_parts(spark, sf_dir):
    return bound(spark, sf_dir, "electors").groupBy("part_number").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "part_number").limit(20)


@query(
    """SELECT id, name, gender, age FROM electors WHERE gender = 'Male' AND relation_type = 'Father' AND contains(lower(name), '00') AND age >= 20 AND age <= 60
    AND serial >= 5 AND NOT is_deleted AND contains(lower(house_number), '/1')""",
    "electors",
)
def p3_elector_list(spark, sf_dir):
    wanted = L.predicates({"gender": "Male", "relation_type": "Father", "is_deleted": False, "epic": None}, {"age": (20, 60), "serial": (5, None)}, {"name": "00", "house_number": "/1"})
    return bound(spark, sf_dir, "electors").filter(L.all_of(wanted)).select("id", "name", "gender", "age")


#: a value for each filter of the list, and the same in SQL
ASKED = {
    "search": (" ABC00000 ", "contains(search_text, 'abc00000')"), "gender": ("Male", "gender = 'Male'"), "relation_type": ("Father", "relation_type = 'Father'"), "part_number": ("3", "part_number = '3'"), "constituency": ("1 - AMERICA", "constituency = '1 - AMERICA'"),
    "house_number": (" /1", "contains(house_number, '/1')"), "has_photo": (False, "coalesce(photo_path, '') = ''"), "polling_station_id": ("S2", "polling_station_id = 'S2'"), "is_supplement": (True, "is_supplement"), "is_deleted": (False, "NOT is_deleted"),
    "min_serial": (50, "serial >= 50"), "max_serial": (90, "serial <= 90"), "min_page": (3, "page_number >= 3"), "max_page": (20, "page_number <= 20"), "source_file_name": ("ROLL 1", "contains(lower(source_file_name), 'roll 1')"),
    "source_file_id": ("F7", "source_file_id = 'F7'"), "verified": (True, "verified"), "min_age": (30, "age >= 30"), "max_age": (60, "age <= 60"),
}
WIDE = "SELECT *, lower(concat_ws(' ', epic, nullif(name, ''), relation_name)) AS search_text, CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'p' || id END AS photo_path, 'S' || part_number AS polling_station_id, file_id AS source_file_id, 'Roll ' || part_number || '.pdf' AS source_file_name FROM electors"
_EACH = " UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) AS n FROM w WHERE {sql}" for k, (_, sql) in ASKED.items())
_SOME = ("gender", "has_photo", "min_serial", "min_age", "is_deleted")


def _wide(spark, sf_dir):
    k = F.col("id")
    photo = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("p"), k.cast("string")))
    return bound(spark, sf_dir, "electors").withColumns({"search_text": L.search_text(["epic", "name", "relation_name"]), "photo_path": photo, "polling_station_id": F.concat(F.lit("S"), "part_number"), "source_file_id": F.col("file_id"), "source_file_name": F.concat(F.lit("Roll "), "part_number", F.lit(".pdf"))})


@query(f"WITH w AS ({WIDE}) {_EACH}", "electors")
def p3_every_filter(spark, sf_dir):
    # one scan counts for all filters
    counts = [F.struct(F.lit(k).alias("filter"), F.count_if(L.elector_filter(k, v)).alias("n")) for k, (v, _) in ASKED.items()]
    return _wide(spark, sf_dir).agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query(f"WITH w AS ({WIDE}), f AS (SELECT * FROM w WHERE {' AND '.join(ASKED[k][1] for k in _SOME)}) SELECT id, age, (SELECT count(*) FROM f) AS total FROM f ORDER BY age DESC NULLS LAST, id LIMIT 20 OFFSET 5", "electors")
def p3_filtered_page(spark, sf_dir):
    asked = {k: ASKED[k][0] for k in _SOME}
    return L.elector_list(_wide(spark, sf_dir), "age", ["age", "name"], offset=5, limit=20, **asked).select("id", "age", "total")


@query("SELECT e.id, e.epic FROM electors e WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = e.id AND o_orderpriority LIKE '1%')", "electors")
def j8_with_photo(spark, sf_dir):
    photos = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("id"))
    return bound(spark, sf_dir, "electors").join(photos, "id", "left_semi").select("id", "epic")


@query("SELECT e.id, e.epic FROM electors e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = e.id)", "electors")
def j8_without_photo(spark, sf_dir):
    photos = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return bound(spark, sf_dir, "electors").join(photos, "id", "left_anti").select("id", "epic")


@query(
    """WITH f AS (SELECT id, epic, name FROM electors WHERE epic = 'ABC0000012' OR contains(lower(name), '#00000001'))
    SELECT f.*, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 5 AS truncated FROM f ORDER BY name, id LIMIT 5""",
    "electors",
)
def p5_search_disclosed(spark, sf_dir):
    rows = bound(spark, sf_dir, "electors").filter((F.col("epic") == "ABC0000012") | L.holds(F.col("name"), "#00000001"))
    return L.disclosed(rows.select("id", "epic", "name"), [F.col("name"), F.col("id")], 5)


@query("SELECT * FROM part WHERE contains(lower(concat_ws(chr(1), p_partkey::VARCHAR, p_name, p_brand, p_type, p_size::VARCHAR)), 'brand#1')")
def p6_search_every_column(spark, sf_dir):
    return L.search_everywhere(table(spark, sf_dir, "part"), "brand#1")


@query(
    "SELECT station_id, name, district FROM stations WHERE (contains(lower(name), 'an') OR contains(lower(building_name), 'an') OR contains(lower(ac_name), 'an')) AND lower(district) = 'district 2'",
    "stations",
)
def p7_station_list(spark, sf_dir):
    rows = bound(spark, sf_dir, "stations")
    wanted = L.any_of(L.holds(F.col(c), "an") for c in ("name", "building_name", "ac_name")) & (F.lower("district") == "district 2")
    return rows.filter(wanted).select("station_id", "name", "district")


@query(
    """WITH k AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN 'abc' || lpad(c_custkey::VARCHAR, 7, '0') WHEN 2 THEN 'c' || lpad((c_custkey * 9)::VARCHAR, 7, '0') ELSE 'nobody' || c_custkey END AS key FROM customer),
    t AS (SELECT key, 0 AS tier, id FROM k JOIN electors ON lower(key) = lower(id::VARCHAR)
          UNION ALL SELECT key, 1, id FROM k JOIN electors ON lower(key) = lower(epic)
          UNION ALL SELECT key, 2, id FROM k JOIN electors ON contains(lower(epic), lower(key)))
    SELECT key, tier, id FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY tier, id) = 1""",
    "electors",
)
def p8_cascading_lookup(spark, sf_dir):
    k, pad = F.col("c_custkey"), lambda c: F.lpad(c.cast("string"), 7, "0")
    key = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit("abc"), pad(k))).when(k % 4 == 2, F.concat(F.lit("c"), pad(k * 9))).otherwise(F.concat(F.lit("nobody"), k.cast("string")))
    keys = table(spark, sf_dir, "customer").select(key.alias("key")).distinct()
    return L.cascade(keys, bound(spark, sf_dir, "electors"), "key", "id", ["id", "epic"], ["epic"])


@query("SELECT id, age, 'age ' || age || ' is below 18' AS reason FROM electors WHERE age < 18", "electors")
def p10_implausible_age(spark, sf_dir):
    return bound(spark, sf_dir, "electors").filter("age < 18").select("id", "age", F.format_string("age %d is below 18", "age").alias("reason"))


@query(
    """SELECT id, concat_ws(', ', CASE WHEN trim(coalesce(name, '')) = '' THEN 'name' END, CASE WHEN trim(coalesce(gender, '')) = '' THEN 'gender' END, CASE WHEN trim(coalesce(house_number, '')) = '' THEN 'house_number' END) AS missing
    FROM electors WHERE trim(coalesce(name, '')) = '' OR trim(coalesce(gender, '')) = '' OR trim(coalesce(house_number, '')) = ''""",
    "electors",
)
def p11_missing_fields(spark, sf_dir):
    missing = F.array_compact(F.array(*[F.when(X.blank(F.col(c)), c) for c in ("name", "gender", "house_number")]))
    return bound(spark, sf_dir, "electors").filter(F.size(missing) > 0).select("id", F.array_join(missing, ", ").alias("missing"))


@query("SELECT id, epic FROM electors WHERE NOT regexp_full_match(upper(epic), '[A-Z]{3}[0-9]{7}')", "electors")
def p12_bad_identifier(spark, sf_dir):
    return bound(spark, sf_dir, "electors").filter(~X.is_canonical_id(F.col("epic"))).select("id", "epic")


@query("SELECT constituency, count(*) AS n FROM electors WHERE gender = 'Male' AND age BETWEEN 31 AND 50 GROUP BY 1", "electors")
def p17_quick_filters(spark, sf_dir):
    rows = bound(spark, sf_dir, "electors").filter((F.col("gender") == "Male") & F.col("age").between(31, 50))
    return rows.groupBy("constituency").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT id FROM electors WHERE contains(lower(epic), '77') OR contains(lower(name), '77') OR contains(lower(relation_name), '77') OR contains(lower(house_number), '77')", "electors"
)
def p18_live_search(spark, sf_dir):
    columns = ("epic", "name", "relation_name", "house_number")
    return bound(spark, sf_dir, "electors").filter(L.any_of(F.coalesce(L.holds(F.col(c), "77"), F.lit(False)) for c in columns)).select("id")


@query(
    """SELECT id, CASE WHEN regexp_full_match(upper(epic), '[A-Z]{3}[0-9]{7}') THEN upper(epic) END AS epic, CASE WHEN age BETWEEN 18 AND 120 THEN age END AS age,
    concat_ws('; ', CASE WHEN NOT regexp_full_match(upper(epic), '[A-Z]{3}[0-9]{7}') THEN 'epic' END, CASE WHEN trim(coalesce(name, '')) = '' THEN 'name' END,
      CASE WHEN relation_type IS NULL AND trim(coalesce(relation_name, '')) <> '' THEN 'relation_type' END) AS rejected FROM electors""",
    "electors",
)
def p21_validated(spark, sf_dir):
    ok = X.is_canonical_id(F.col("epic"))
    faults = F.array_compact(F.array(F.when(~ok, "epic"), F.when(X.blank(F.col("name")), "name"), F.when(F.col("relation_type").isNull() & ~X.blank(F.col("relation_name")), "relation_type")))
    return bound(spark, sf_dir, "electors").select(
        "id", F.when(ok, F.upper("epic")).alias("epic"), F.when(F.col("age").between(18, 120), F.col("age")).alias("age"), F.array_join(faults, "; ").alias("rejected")
    )


@query(
    "SELECT id, lower(concat_ws(' ', nullif(epic, ''), nullif(name, ''), nullif(relation_name, ''), nullif(house_number, ''), part_number, constituency, serial::VARCHAR)) AS search_text FROM electors", "electors"
)
def p24_search_text(spark, sf_dir):
    columns = ["epic", "name", "relation_name", "house_number", "part_number", "constituency", "serial"]
    return bound(spark, sf_dir, "electors").select("id", L.search_text(columns).alias("search_text"))


@query("SELECT id, age, name FROM electors ORDER BY age DESC NULLS LAST, id LIMIT 25 OFFSET 50", "electors")
def o1_sorted_page(spark, sf_dir):
    return L.page(bound(spark, sf_dir, "electors").select("id", "age", "name"), "age", "id", ["age", "name", "serial"], descending=True, offset=50, limit=25)


@query("SELECT part_number, serial, id FROM electors ORDER BY part_number, serial, name, id LIMIT 40", "electors")
def o2_fixed_order(spark, sf_dir):
    return bound(spark, sf_dir, "electors").orderBy("part_number", "serial", "name", "id").select("part_number", "serial", "id").limit(40)


@query(
    """WITH p AS (SELECT DISTINCT CASE WHEN o_orderkey % 5 = 4 THEN 'x' || o_orderkey ELSE o_orderkey::VARCHAR END AS part FROM orders)
    SELECT part, row_number() OVER (ORDER BY coalesce(try_cast(part AS INT), 0), part) AS place FROM p"""
)
def o4_natural_order(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.when(k % 5 == 4, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("part")).distinct()
    return L.ranked(rows, [L.natural_number(F.col("part")), F.col("part")])


@query("SELECT * FROM supplier ORDER BY s_suppkey LIMIT 10 OFFSET 5")
def o5_table_page(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    wanted = "no such column"
    sort = wanted if wanted in rows.columns else rows.columns[0]
    return L.page(rows, sort, rows.columns[0], rows.columns, offset=5, limit=10)


@query(
    """WITH p AS (SELECT constituency, part_number, count(*) AS n FROM electors GROUP BY 1, 2)
    SELECT constituency, sum(n)::BIGINT AS electors, string_agg(part_number || ':' || n, ' ' ORDER BY part_number::INT) AS parts FROM p GROUP BY 1""",
    "electors",
)
def g11_parts_by_constituency(spark, sf_dir):
    parts = bound(spark, sf_dir, "electors").groupBy("constituency", "part_number").agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct(L.natural_number(F.col("part_number")), "part_number", "n")))
    text = F.array_join(F.transform(listed, lambda p: F.concat(p["part_number"], F.lit(":"), p["n"].cast("string"))), " ")
    return parts.groupBy("constituency").agg(F.sum("n").alias("electors"), text.alias("parts"))


@query(
    """SELECT (SELECT count(*) FROM electors) AS electors, (SELECT count(*) FROM stations) AS stations, (SELECT count(*) FROM lineitem) AS records,
    (SELECT count(DISTINCT part_number) FROM electors) AS parts, (SELECT count(DISTINCT constituency) FROM electors) AS constituencies""",
    "electors",
    "stations",
)
def g12_overview(spark, sf_dir):
    people = bound(spark, sf_dir, "electors").agg(F.count(F.lit(1)).alias("electors"), F.countDistinct("part_number").alias("parts"), F.countDistinct("constituency").alias("constituencies"))
    stations = bound(spark, sf_dir, "stations").agg(F.count(F.lit(1)).alias("stations"))
    records = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("records"))
    return people.join(F.broadcast(stations)).join(F.broadcast(records)).select("electors", "stations", "records", "parts", "constituencies")


@query("SELECT count(*)::VARCHAR AS x, 'f' || (SELECT count(*) FROM stations) || ':r' || (SELECT count(*) FROM lineitem) || ':v' || count(*) AS fingerprint FROM electors", "electors", "stations")
def g18_fingerprint(spark, sf_dir):
    one = lambda df, n: df.agg(F.count(F.lit(1)).cast("string").alias(n))
    counts = one(bound(spark, sf_dir, "electors"), "v").join(F.broadcast(one(bound(spark, sf_dir, "stations"), "f"))).join(F.broadcast(one(table(spark, sf_dir, "lineitem"), "r")))
    return counts.select(F.col("v").alias("x"), F.concat(F.lit("f"), "f", F.lit(":r"), "r", F.lit(":v"), "v").alias("fingerprint"))


@query("SELECT constituency, string_agg(DISTINCT house_number, ' ' ORDER BY house_number) AS variants FROM electors WHERE house_number LIKE '1%' GROUP BY 1", "electors")
def u3_house_variants(spark, sf_dir):
    rows = bound(spark, sf_dir, "electors").filter(F.col("house_number").startswith("1"))
    return rows.groupBy("constituency").agg(F.array_join(F.sort_array(F.collect_set("house_number")), " ").alias("variants"))
