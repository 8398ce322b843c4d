"""Merkle manifest of a table by slot pivots.

Rows are leaves; of each group (``lang``) the leaves are ranked by id, every two consecutive nodes
become their hash until one is left, and the subroots of the groups are joined likewise into the
root.

A shuffle deals out blocks of ``SLOTS`` consecutive nodes. Conditional aggregates spread a block's
nodes into slot columns; concatenating neighbouring columns hashes their parent, and the column
beside a node's own one is its sibling. As all levels of a block are columns of one row, a shuffle
climbs ``LEVELS`` levels: ten shuffles reach over 10^12 leaves. Paths come back down from the
root by joining the row of a block (not its nodes) with the path of the block's top.

No step puts a group in one task: ranks come from one range sort over (group, id) and the row counts
of its partitions, and a block is at most SLOTS nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hinted, materialize, release

LEVELS = 4
SLOTS = 1 << LEVELS
BROADCAST_ROWS = 100_000
PATH = "array<struct<left: string, right: string>>"


def measured(value: Column) -> Column:
    """UTF-8 byte count, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(measured, values)), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to along a path of siblings."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def _ranked(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (with a group ``_g``) with the number ``_pos`` of the row in its group and the group's
    size ``_n``; also the written table behind it.

    One range sort, cut wherever it falls; the counts of (partition, group) are as many as partitions
    and groups together.
    """
    spark = rows.sparkSession
    keys = ["_g", *order, "_row"]  # _row parts what is equal otherwise
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = materialize(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).drop("_row"), "ranked")
    runs = rows.groupBy("_g", "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    group = Window.partitionBy("_g")
    before = F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_g", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(group).alias("_n"))
    runs = runs.withColumnsRenamed({"_g": "_g2", "_part": "_part2"})
    # null-safe by a pair of plain keys, so that either side may be large
    on = (F.coalesce("_g", F.lit("")) == F.coalesce("_g2", F.lit(""))) & (F.col("_g").isNull() == F.col("_g2").isNull()) & (F.col("_part") == F.col("_part2"))
    out = rows.join(hinted(runs, BROADCAST_ROWS), on)
    return out.withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_part2", "_g2", "_first", "_before"), rows


def _level(n: Column, nodes: list[Column]) -> list[Column]:
    """Parents of the slot columns; a group of one node is done and stays."""
    pairs = [F.sha2(F.concat(a, F.coalesce(b, F.lit(""))), 256) for a, b in zip(nodes[::2], nodes[1::2], strict=True)]
    return [F.when(n == 1, a).otherwise(h) for a, h in zip(nodes[::2], pairs, strict=True)]


def _block(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """Blocks of (_g, _pos, _n, hash, carry): (_g, _pos, _n, hash) of their tops, ``slots`` with what
    is carried and the siblings of each node up to the top."""
    slot = F.col("_pos") % SLOTS
    kept = F.struct("hash", *carry)
    spread = [F.max(F.when(slot == i, kept)).alias(f"s{i}") for i in range(SLOTS)]
    wide = nodes.withColumn("_up", F.floor(F.col("_pos") / SLOTS)).groupBy("_g", "_up", "_n").agg(*spread)
    wide = wide.withColumns({f"h0_{i}": F.col(f"s{i}.hash") for i in range(SLOTS)})
    for level in range(LEVELS):
        left = F.ceil(F.col("_n") / (1 << level))
        above = _level(left, [F.col(f"h{level}_{i}") for i in range(SLOTS >> level)])
        wide = wide.withColumns({f"h{level + 1}_{i}": h for i, h in enumerate(above)})
    slots = []
    for i in range(SLOTS):
        steps = []
        for level in range(LEVELS):
            own = i >> level
            other = F.coalesce(F.col(f"h{level}_{own ^ 1}"), F.lit(""))
            sides = (other, F.lit("")) if own & 1 else (F.lit(""), other)
            steps.append(F.when(F.ceil(F.col("_n") / (1 << level)) > 1, F.struct(sides[0].alias("left"), sides[1].alias("right"))))
        way = F.filter(F.array(*steps), lambda s: s.isNotNull())
        slots.append(F.when(F.col(f"s{i}").isNotNull(), F.struct(F.lit(i).alias("slot"), F.col(f"s{i}").alias("node"), way.alias("way"))))
    return wide.select("_g", F.col("_up").alias("_pos"), F.ceil(F.col("_n") / SLOTS).alias("_n"), F.col(f"h{LEVELS}_0").alias("hash"), F.filter(F.array(*slots), lambda s: s.isNotNull()).alias("slots"))


def paths_to_root(nodes: DataFrame, carry: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes (_g, _pos, _n, hash, carry) with ``path`` (their siblings up to the root of their group)
    and ``root``; also the written tables behind it.

    Level by level from the node to the root, as structs of what stands left and right of the node.
    """
    tiers, written = [], []
    while True:
        tiers.append(materialize(_block(nodes, carry if not tiers else []), "tier"))
        written.append(tiers[-1])
        nodes = tiers[-1].select("_g", "_pos", "_n", "hash")
        if not nodes.filter("_n > 1").limit(1).count():
            break
    above = nodes.select("_g", "_pos", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"))
    for i, tier in reversed(list(enumerate(tiers))):
        key = [F.coalesce(F.col("_g"), F.lit("")).alias("_g1"), F.col("_g").isNull().alias("_g0"), "_pos"]
        way = above.select(*key, "path", "root")
        blocks = tier.select(*key, "_g", "slots").join(way, ["_g1", "_g0", "_pos"])
        each = blocks.select("_g", "_pos", "path", "root", F.explode("slots").alias("_s"))
        at = F.col("_pos") * SLOTS + F.col("_s.slot")
        more = [F.col(f"_s.node.{c}").alias(c) for c in (["hash", *carry] if i == 0 else [])]
        above = each.select("_g", at.alias("_pos"), F.concat("_s.way", "path").alias("path"), "root", *more)
        if i:
            above = materialize(above, "paths")
            written.append(above)
    return above, written


def merkle_manifest(leaves: DataFrame, group_col: str, id_col: str, hash_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Merkle tree over rows that have their hash.

    Returns ``group_col``, ``id_col``, ``hash_col`` and the columns ``carry`` of each row, with
    ``subroot`` (of its group), ``root`` and ``path``, the siblings from the row to the root: an array
    of structs (left, right) of hex digests, one of which is empty; both are empty where the row's
    node was hashed alone. Groups are ordered as strings by their bytes, rows of a group by id, null
    first in either; rows of one id by their hash, so equal rows may trade places, and no other. An
    empty table gives no rows. Names of the caller's columns do not matter.
    """
    rows = leaves.select(F.col(group_col).cast("string").alias("_g"), F.struct(F.col(id_col).alias("id"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("_c"), F.col(hash_col).alias("hash"))
    rows = materialize(rows.withColumn("_id", F.col("_c.id")), "leaves")
    placed, ranked = _ranked(rows, ["_id", "hash"])
    own, written = paths_to_root(placed.select("_g", "_pos", "_n", "hash", "_c"), ["_c"])
    tops = written[_height(written)].select(F.lit("").alias("_g"), F.col("_g").alias("_lang"), "hash")
    tops, ranked_tops = _ranked(tops, ["_lang"])
    top, more = paths_to_root(tops.select("_g", "_pos", "_n", "hash", "_lang"), ["_lang"])
    top = materialize(top.select(F.coalesce("_lang", F.lit("")).alias("_g1"), F.col("_lang").isNull().alias("_g0"), F.col("path").alias("_rest"), F.col("root").alias("_top")), "subroots")
    release(rows, ranked, ranked_tops, *more)
    own = own.withColumns({"_g1": F.coalesce("_g", F.lit("")), "_g0": F.col("_g").isNull()})
    out = own.join(hinted(top, BROADCAST_ROWS), ["_g1", "_g0"])
    return out.select(
        F.col("_g").alias(group_col),
        F.col("_c.id").alias(id_col),
        F.col("hash").alias(hash_col),
        *[F.col(f"_c.c{i}").alias(c) for i, c in enumerate(carry)],
        F.col("root").alias("subroot"),
        F.col("_top").alias("root"),
        F.concat("path", "_rest").alias("path"),
    )


def _height(written: list[DataFrame]) -> int:
    """Which of the written tables is the last tier: tiers come before paths and alone have hashes."""
    return max(i for i, df in enumerate(written) if "slots" in df.columns)


def document_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """Manifest of ``documents``, checked against a copy in which the rows ``tampered`` have one more
    in n_chars.

    Returns doc_id, lang, leaf, subroot, root, path, proof_sha256 (hash of all the siblings, from the leaf
    up), folded_root (the leaf of the copy led along the path) and verified (it is the root). A null
    n_chars can't be raised, so its row stays verified. Columns beyond the five hashed ones play no part.
    """
    plain = [F.col(c) for c in ("doc_id", "source", "lang")]
    copy = leaf_hash(*plain, F.col("n_chars") + 1, F.col("text"))
    seen = F.when(F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull(), copy)
    leaves = docs.select("doc_id", "lang", leaf_hash(*plain, F.col("n_chars"), F.col("text")).alias("leaf"), seen.alias("seen"))
    out = merkle_manifest(leaves, "lang", "doc_id", "leaf", ("seen",))
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    out = out.withColumn("proof_sha256", F.sha2(siblings, 256)).withColumn("folded_root", fold(F.coalesce("seen", "leaf"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("seen")


#: CRC-32 runs over the digits of the id; trees and folds are recursive over their levels.
ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT doc_id, text, source, lang, n_chars, 0 AS i, 4294967295::UBIGINT AS v, doc_id::VARCHAR AS d, row_number() OVER () AS rid FROM documents
  UNION ALL
  SELECT doc_id, text, source, lang, n_chars, i + 1,
    list_reduce([xor(v, ascii(d[i + 1])::UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda a, z: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)),
    d, rid
  FROM crc WHERE i < length(d)
), docs AS (
  SELECT *, d IS NOT NULL AND xor(v, 4294967295::UBIGINT) % 7 = 0 AND n_chars IS NOT NULL AS bad FROM crc WHERE i = coalesce(length(d), 0)
), spelled AS (
  SELECT rid, doc_id, lang, bad,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS b, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS b1,
    coalesce(strlen(text) || ':' || text, '-') AS c
  FROM docs
), leaves AS (
  SELECT rid, doc_id, lang, sha256(a || b || c) AS leaf, sha256(a || CASE WHEN bad THEN b1 ELSE b END || c) AS seen FROM spelled
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), tree AS (
  SELECT lang, 0 AS lv, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, lv + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, lv, pos // 2, n
), subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), crown AS (
  SELECT 0 AS lv, pos, n, h FROM subroots
  UNION ALL
  SELECT lv + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY lv, pos // 2, n
), low AS (
  SELECT p.rid, p.lang, 0 AS lv, p.pos, p.n, p.seen AS f, '' AS proof FROM placed p
  UNION ALL
  SELECT w.rid, w.lang, w.lv + 1, w.pos // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.pos % 2 = 1 THEN coalesce(t.h, '') || w.f ELSE w.f || coalesce(t.h, '') END), w.proof || coalesce(t.h, '')
  FROM low w LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM w.lang AND t.lv = w.lv AND t.pos = xor(w.pos, 1) WHERE w.n > 1
), high AS (
  SELECT w.rid, 0 AS lv, s.pos, s.n, w.f, w.proof FROM low w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.rid, w.lv + 1, w.pos // 2, (w.n + 1) // 2,
    sha256(CASE WHEN w.pos % 2 = 1 THEN coalesce(t.h, '') || w.f ELSE w.f || coalesce(t.h, '') END), w.proof || coalesce(t.h, '')
  FROM high w LEFT JOIN crown t ON t.lv = w.lv AND t.pos = xor(w.pos, 1) WHERE w.n > 1
)
SELECT p.doc_id, p.leaf, s.h AS subroot, c.h AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = c.h AS verified
FROM placed p JOIN high w ON w.rid = p.rid AND w.n = 1 JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN crown c ON c.n = 1
"""
