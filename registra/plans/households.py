"""Queries over households, families and matching names.

The SQL twins compare all names of a block with each other and then walk each block's declarations one
by one in a recursive query, keeping what was accepted so far; the operators work on sets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from registra.functions import similarity as S
from registra.functions import text as X
from registra.operators import household as H
from registra.operators.similar import matching_names

from .bindings import bound, twin

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str, *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = twin(sql, *names)
        return f

    return add


def _clean(c: str) -> str:
    first = rf"(?i)^\s*(\d+[.:)\-\s]+)?(({X.NAME_LABELS})[\s.,]+)?({X.NAME_WORDS})[\s:;=\-.,]+"
    lead, trail = r"^(\s*\d+[.:)\s]+\s*|[\s\-–—.,;:])+", r"""[\s\-–—_.,;:"''“”‘’]+$"""
    return rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce({c}, ''), '{first}', ''), '{lead}', ''), '{trail}', ''), '\s+', ' ', 'g')))"


def _score(candidates: str) -> str:
    """CTE ``named`` (block, a, b, score) from the names in ``candidates`` (block, a, b). The built-in Jaro
    rounds half transpositions down, so it serves as an upper bound only."""
    return f"""upper AS (
      SELECT *, CASE WHEN left(a, 1) <> left(b, 1) THEN 0 WHEN least(length(a), length(b)) < 2 OR left(a, 2) <> left(b, 2) THEN 1
        WHEN least(length(a), length(b)) < 3 OR left(a, 3) <> left(b, 3) THEN 2 WHEN least(length(a), length(b)) < 4 OR left(a, 4) <> left(b, 4) THEN 3 ELSE 4 END AS pre,
        length(a) AS la, length(b) AS lb, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS reach, jaro_similarity(a, b) AS most
      FROM {candidates} WHERE a <> '' AND b <> ''),
    easy AS (
      SELECT *, CASE WHEN a = b THEN 1.0 WHEN la >= 3 AND lb >= 3 AND (contains(a, b) OR contains(b, a)) THEN 0.95 END AS known FROM upper),
    met AS (
      SELECT *, list_reduce(list_prepend([]::BIGINT[], [[i] FOR i IN range(1, la + 1)]), lambda s, e: list_append(s, coalesce(
        list_filter(range(greatest(1, e[1] - reach), least(lb, e[1] + reach) + 1), lambda j: b[j] = a[e[1]] AND NOT list_contains(s, j))[1], 0))) AS u
      FROM easy WHERE known IS NULL AND most + 0.1 * pre * (1 - most) >= 0.78 - 1e-9),
    spelt AS (
      SELECT *, [a[i] FOR i IN range(1, la + 1) IF u[i] > 0] AS ma, [b[j] FOR j IN list_sort([x FOR x IN u IF x > 0])] AS mb FROM met),
    jaro AS (
      SELECT *, len(ma)::DOUBLE AS m, list_sum([CASE WHEN ma[k] <> mb[k] THEN 0.5 ELSE 0 END FOR k IN range(1, len(ma) + 1)])::DOUBLE AS t FROM spelt WHERE len(ma) > 0),
    measured AS (SELECT *, (m / la + m / lb + (m - t) / m) / 3 AS j FROM jaro),
    named AS (
      SELECT block, a, b, known::DOUBLE AS score FROM easy WHERE known IS NOT NULL
      UNION ALL SELECT block, a, b, j + 0.1 * pre * (1 - j) AS score FROM measured WHERE j + 0.1 * pre * (1 - j) >= 0.78)"""


_HOUSE = r"regexp_replace(regexp_replace(upper(trim(coalesce(house_number, ''))), '[-\s./\\_,;]+', '-', 'g'), '^-|-$', '', 'g')"

#: people with their blocks; the best relative; the walk; families
LINKS = rf"""h AS (
      SELECT *, {_HOUSE} AS house_key, {_clean("name")} AS own, {_clean("relation_name")} AS wanted, upper(left(coalesce(relation_type, ''), 1)) || lower(substr(coalesce(relation_type, ''), 2)) AS relation,
        lower(trim(coalesce(gender, ''))) IN ('male', 'm') AS he, lower(trim(coalesce(gender, ''))) IN ('female', 'f') AS she, coalesce(age, 0) AS years, coalesce(serial, 1000000000) AS o2
      FROM residents),
    k AS (
      SELECT *, CASE WHEN house_key IN ('', '0', 'NA', 'NIL') THEN NULL ELSE array_to_string(list_transform(string_split(house_key, '-')[1:2], lambda p, i: CASE WHEN i = least(len(string_split(house_key, '-')), 2) THEN regexp_replace(p, '^(\d+)\pL+$', '\1') ELSE p END), '-') END AS building
      FROM h),
    gap AS (SELECT *, CASE WHEN serial - lag(serial) OVER (PARTITION BY part_number ORDER BY serial) > 15 THEN 1 ELSE 0 END AS jump FROM k WHERE building IS NULL),
    p AS (
      SELECT * EXCLUDE (jump), 'serial|' || part_number || '|' || sum(jump) OVER (PARTITION BY part_number ORDER BY serial) AS block FROM gap
      UNION ALL SELECT *, 'house|' || part_number || '|' || building FROM k WHERE building IS NOT NULL),
    cand AS (SELECT DISTINCT s.block, s.wanted AS a, t.own AS b FROM p s JOIN p t ON s.block = t.block AND s.id <> t.id WHERE s.wanted <> ''),
    {_score("cand")},
    best AS (
      SELECT s.block, s.id AS source, t.id AS target, s.relation, n.score AS name_score, s.name AS source_name, t.name AS target_name, s.years AS sy, t.years AS ty, s.he AS s_he, s.she AS s_she, t.he AS t_he, t.she AS t_she,
        CASE WHEN s.house_key <> '' AND s.house_key = t.house_key THEN 30 WHEN s.building = t.building THEN 22 ELSE 15 END AS place, s.o2
      FROM p s JOIN p t ON s.block = t.block AND s.id <> t.id JOIN named n ON n.block = s.block AND n.a = s.wanted AND n.b = t.own
      QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY n.score DESC, t.years DESC, t.o2, t.id) = 1),
    gated AS (
      SELECT *, place + round_even(35 * name_score, 0)::INT + 20 + CASE WHEN sy > 0 AND ty > 0 AND CASE WHEN relation = 'Husband' THEN abs(ty - sy) <= 35 ELSE ty - sy >= 18 END THEN 10 ELSE 0 END
          + CASE WHEN CASE relation WHEN 'Father' THEN t_he WHEN 'Mother' THEN t_she ELSE t_he AND s_she END THEN 5 ELSE 0 END AS score,
        CASE WHEN relation NOT IN ('Father', 'Mother', 'Husband') THEN 'Relation type gives no direction to infer a link from'
          WHEN relation <> 'Husband' AND sy > 0 AND ty > 0 AND ty <= sy THEN target_name || ' (' || ty || ') is not older than ' || source_name || ' (' || sy || '), so cannot be their parent'
          WHEN relation <> 'Husband' AND sy > 0 AND ty > 0 AND ty - sy < 18 THEN target_name || ' (' || ty || ') is only ' || (ty - sy) || CASE WHEN ty - sy = 1 THEN ' year' ELSE ' years' END || ' older than ' || source_name || ' (' || sy || '); a parent must be at least 18 years older'
          WHEN relation = 'Father' AND t_she THEN target_name || ' is recorded as female but named as a father'
          WHEN relation = 'Mother' AND t_he THEN target_name || ' is recorded as male but named as a mother'
          WHEN relation = 'Husband' AND t_she THEN target_name || ' is recorded as female but named as a husband'
          WHEN relation = 'Husband' AND s_he THEN source_name || ' is recorded as male but declares a husband'
          WHEN relation = 'Husband' AND sy > 0 AND ty > 0 AND abs(ty - sy) > 35 THEN 'Spouse age gap of ' || abs(ty - sy) || ' years exceeds the 35-year plausibility limit' END AS gate
      FROM best),
    edge AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY sy DESC, o2, source) AS i FROM gated),
    walk AS (
      SELECT DISTINCT block, 0::BIGINT AS i, [{{'s': -1::BIGINT, 't': -1::BIGINT, 'w': false, 'sn': '', 'tn': ''}}][1:0] AS acc, NULL::VARCHAR AS reason FROM edge
      UNION ALL
      SELECT block, i, CASE WHEN reason IS NULL THEN list_append(acc, {{'s': source, 't': target, 'w': relation = 'Husband', 'sn': source_name, 'tn': target_name}}) ELSE acc END, reason
      FROM (
        SELECT *, CASE WHEN gate IS NOT NULL THEN gate
            WHEN relation <> 'Husband' AND list_contains(ancestors, source) THEN 'Linking ' || target_name || ' as parent would make them their own descendant'
            WHEN relation = 'Husband' AND s_with IS NOT NULL THEN source_name || ' is already recorded as married to ' || s_with || '; a second marriage cannot be inferred from the roll'
            WHEN relation = 'Husband' AND t_with IS NOT NULL THEN target_name || ' is already recorded as married to ' || t_with || '; a second marriage cannot be inferred from the roll'
            WHEN score < 60 THEN 'Evidence scores only ' || score || '/100, below the 60 threshold' END AS reason
        FROM (
          SELECT e.*, w.acc,
            list_reduce(list_prepend([e.target], [[z] FOR z IN range(0, len(w.acc) + 1)]), lambda s, z: CASE WHEN len(list_filter(w.acc, lambda x: x.s = s[-1] AND NOT x.w)) > 0 THEN list_append(s, list_filter(w.acc, lambda x: x.s = s[-1] AND NOT x.w)[1].t) ELSE s END) AS ancestors,
            (SELECT CASE WHEN x.s = e.source THEN x.tn ELSE x.sn END FROM (SELECT unnest(list_filter(w.acc, lambda y: y.w AND (y.s = e.source OR y.t = e.source))) AS x)) AS s_with,
            (SELECT CASE WHEN x.s = e.target THEN x.tn ELSE x.sn END FROM (SELECT unnest(list_filter(w.acc, lambda y: y.w AND (y.s = e.target OR y.t = e.target))) AS x)) AS t_with
          FROM walk w JOIN edge e ON e.block = w.block AND e.i = w.i + 1))),
    link AS (SELECT e.block, e.source, e.target, e.relation, CASE WHEN e.gate IS NULL THEN e.score END AS score, w.reason FROM edge e JOIN walk w ON w.block = e.block AND w.i = e.i)"""

FAMILIES = LINKS + """,
    kept AS (SELECT * FROM link WHERE reason IS NULL),
    near AS (SELECT source AS x, target AS y FROM kept UNION SELECT target, source FROM kept),
    reach AS (SELECT id, id AS r FROM p UNION SELECT reach.id, near.y FROM reach JOIN near ON near.x = reach.r),
    comp AS (SELECT id, min(r) AS family FROM reach GROUP BY id),
    kin AS (
      SELECT p.id, p.block, p.he, p.she, p.years, p.o2, p.wanted, c.family, (SELECT max(target) FROM kept WHERE relation <> 'Husband' AND source = p.id) AS parent_id,
        (SELECT max(CASE WHEN source = p.id THEN target ELSE source END) FROM kept WHERE relation = 'Husband' AND (source = p.id OR target = p.id)) AS spouse_id,
        (SELECT count(*) FROM kept WHERE relation <> 'Husband' AND target = p.id) AS children
      FROM p JOIN comp c USING (id)),
    root AS (SELECT k.* FROM kin k LEFT JOIN kin s ON s.id = k.spouse_id WHERE k.parent_id IS NULL AND s.parent_id IS NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY children DESC, years DESC, o2, id) AS rn FROM root),
    chosen AS (SELECT a.id, a.family, a.spouse_id, a.rn FROM ranked a LEFT JOIN ranked b ON b.id = a.spouse_id AND b.rn < a.rn WHERE b.id IS NULL),
    stand_in AS (SELECT id, family, spouse_id, 1 AS rn FROM kin WHERE family NOT IN (SELECT family FROM chosen) QUALIFY row_number() OVER (PARTITION BY family ORDER BY years DESC, o2, id) = 1),
    top AS (SELECT * FROM chosen UNION ALL SELECT * FROM stand_in),
    level AS (
      SELECT id, 1 AS generation FROM top UNION SELECT spouse_id, 1 FROM top WHERE spouse_id IS NOT NULL
      UNION SELECT CASE WHEN x = 0 THEN c.id ELSE c.spouse_id END, l.generation + 1 FROM level l JOIN kin c ON c.parent_id = l.id, (VALUES (0), (1)) v(x) WHERE l.generation < 12 AND (x = 0 OR c.spouse_id IS NOT NULL)),
    deep AS (SELECT id, min(generation) AS generation FROM level GROUP BY id),
    sure AS (
      SELECT c.family, round_even(avg(l.score) FILTER (WHERE l.reason IS NULL), 0)::INT AS sure, count(*) FILTER (WHERE l.reason IS NOT NULL) > 0 AS bad FROM link l JOIN comp c ON c.id = l.source GROUP BY c.family),
    whole AS (
      SELECT k.*, coalesce(d.generation, 1) AS generation, k.id = (SELECT id FROM top t WHERE t.family = k.family AND t.rn = 1) AS is_head, s.sure, coalesce(s.bad, false) AS bad, max(k.wanted <> '') OVER (PARTITION BY k.family) AS declares
      FROM kin k LEFT JOIN deep d USING (id) LEFT JOIN sure s USING (family)),
    families AS (
      SELECT id, block, family, CASE WHEN parent_id IS NOT NULL THEN CASE WHEN she THEN 'Daughter' WHEN he THEN 'Son' ELSE 'Child' END WHEN children > 0 THEN CASE WHEN she THEN 'Mother' WHEN he THEN 'Father' ELSE 'Parent' END
          WHEN spouse_id IS NOT NULL THEN CASE WHEN she THEN 'Wife' WHEN he THEN 'Husband' ELSE 'Spouse' END ELSE 'Resident' END AS role,
        generation, max(generation) OVER (PARTITION BY family) AS generations, is_head, spouse_id, parent_id, coalesce(sure, 0) AS confidence,
        CASE WHEN sure >= 95 THEN 'Confirmed' WHEN sure >= 80 THEN 'Strong' WHEN sure >= 60 THEN 'Possible' ELSE 'Unverified' END AS level,
        CASE WHEN sure IS NULL THEN CASE WHEN bad THEN 'contradicted' WHEN declares THEN 'relative_not_in_household' ELSE 'no_relation_recorded' END END AS unresolved
      FROM whole)"""


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql


def _people(spark, sf_dir):
    return bound(spark, sf_dir, "residents")


@query(_recursive(LINKS + " SELECT source, target, relation, score, CASE WHEN score >= 95 THEN 'Confirmed' WHEN score >= 80 THEN 'Strong' WHEN score >= 60 THEN 'Possible' WHEN score IS NOT NULL THEN 'Unverified' END AS level, reason FROM link"), "residents")
def x29_j20_links(spark, sf_dir):
    links = H.decided(H.declared_links(H.households(_people(spark, sf_dir))))
    scored = F.when(~F.col("gated"), F.col("score"))
    return links.select("source", "target", "relation", scored.alias("score"), F.when(scored.isNotNull(), H.level(F.col("score"))).alias("level"), "reason")


@query(_recursive(FAMILIES + " SELECT * EXCLUDE (block), regexp_replace(block, '\\|.*', '') AS grouping FROM families"), "residents")
def r14_families(spark, sf_dir):
    return H.families(_people(spark, sf_dir)).withColumn("grouping", F.substring_index("block", "|", 1)).drop("block")


@query(_recursive(FAMILIES + " SELECT family, id AS head, generations FROM families WHERE is_head"), "residents")
def w17_family_roots(spark, sf_dir):
    return H.families(_people(spark, sf_dir)).filter("is_head").select("family", F.col("id").alias("head"), "generations")


@query(
    _recursive(
        FAMILIES
        + """, own AS (SELECT block, family FROM families WHERE id = 101)
    SELECT id, f.family, role, generation, is_head, confidence, level, f.family = own.family AS own_family, (SELECT string_agg(DISTINCT trim(house_number), ', ' ORDER BY trim(house_number)) FROM p WHERE p.block = own.block) AS spellings, false AS truncated
    FROM families f JOIN own ON own.block = f.block"""
    ),
    "residents",
)
def r15_household_of_elector(spark, sf_dir):
    return H.household_of(_people(spark, sf_dir), 101, limit=200)


@query(
    f"""WITH c AS (SELECT part_number AS block, {_clean("name")} AS own, {_clean("relation_name")} AS wanted FROM residents),
    cand AS (SELECT DISTINCT x.block, x.wanted AS a, y.own AS b FROM c x JOIN c y ON x.block = y.block WHERE x.wanted <> '' AND y.own <> ''), {_score("cand")},
    lcs AS (
      SELECT *, list_reduce(list_prepend([0 FOR z IN range(0, length(b) + 1)], [[ascii(a[i])::INT] FOR i IN range(1, length(a) + 1)]), lambda row, e:
        list_reduce(list_prepend([0]::INT[], [[j::INT] FOR j IN range(1, length(b) + 1)]), lambda done, f: list_append(done, CASE WHEN ascii(b[f[1]]) = e[1] THEN row[f[1]] + 1 ELSE greatest(done[-1], row[f[1] + 1]) END)))[-1] AS n
      FROM named)
    SELECT block AS part_number, a, b, round(score, 6) AS score, round(200.0 * n / (length(a) + length(b)), 6) AS ratio FROM lcs""",
    "residents",
)
def x10_x12_name_pairs(spark, sf_dir):
    people = _people(spark, sf_dir)
    wanted = people.select("part_number", X.clean_name(F.col("relation_name")).alias("a")).filter("a != ''").distinct()
    names = people.select("part_number", X.clean_name(F.col("name")).alias("b")).filter("b != ''").distinct()
    found = matching_names(wanted, names, ["part_number"], "a", "b")
    return found.select("part_number", "a", "b", F.round("score", 6).alias("score"), F.round(S.indel_ratio("a", "b"), 6).alias("ratio"))
