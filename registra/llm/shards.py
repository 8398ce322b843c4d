"""Sharding by extendible hashing, in DataFrame functions only.

A directory is indexed by the leading bits of a row's hash. A bucket that holds more bytes than
``limit`` is split on its next bit, and only such buckets, until every shard fits. Sizes are
counted per directory cell ``STEP`` bits at a time, so a round costs one map-side-combined count
of the rows that are still in oversized buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_long, materialize

BITS = 60
STEP = 12


def hash60(id_col: Column, text_col: Column) -> Column:
    """60 bits: 32 from the id, then 28 from the text (rows that share an id still split)."""
    head = hex_long(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 8)
    tail = hex_long(F.md5(F.coalesce(text_col, F.lit("")).cast("binary")), 1, 7)
    return F.shiftleft(head, 28).bitwiseOR(tail)


def extendible_shards(
    docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Assign each row of ``docs`` to a shard of at most ``limit`` bytes of text.

    Returns ``id_col``, the ``carry`` columns, ``n_bytes`` (null text: 0), ``shard`` (the bucket's
    hash prefix as a bit string, '' when one shard holds all), ``depth`` (its number of bits) and
    ``part`` (0, or the number of a cut inside a bucket of rows that are equal in id and text and
    so can't be told apart by hash). A single text above the limit has a shard of its own. Null
    ids and texts count as empty; an empty table gives no rows. Shards depend on ids and texts
    only, never on order or partitioning, but for the ``part`` of equal rows.
    """
    rows = materialize(
        docs.select(
            F.col(id_col),
            *carry,
            F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
            hash60(F.col(id_col), F.col(text_col)).alias("_h"),
        ),
        "shard-rows",
    )
    done, lo = [], 0
    while True:
        hi = min(lo + STEP, BITS)
        cells = rows.groupBy(F.shiftright("_h", BITS - hi).alias("_cell")).agg(F.sum("n_bytes").alias("_b"))
        levels = cells.select(
            "_cell", "_b", F.explode(F.sequence(F.lit(0 if lo == 0 else lo + 1), F.lit(hi))).alias("_d")
        ).withColumn("_p", F.expr(f"shiftright(_cell, {hi} - _d)"))
        fits = levels.groupBy("_d", "_p").agg(F.sum("_b").alias("_b")).filter(F.col("_b") <= limit)
        fits = materialize(fits.select("_d", "_p", F.lit(1).alias("_fit")), "shard-fits")
        # the first level that fits closes the bucket; a cell without one is split further. Levels
        # at which no bucket fits would only bring all cells to a few keys
        least = fits.agg(F.min("_d")).first()[0]
        directory = levels.filter(F.col("_d") >= (hi if least is None else least)).select("_cell", "_d", "_p").join(fits, ["_d", "_p"], "left")
        directory = materialize(directory.groupBy("_cell").agg(F.min(F.when(F.col("_fit") == 1, F.col("_d"))).alias("depth")), "shard-dir")
        placed = rows.withColumn("_cell", F.shiftright("_h", BITS - hi)).join(directory, "_cell")
        last = hi == BITS
        left = last or directory.filter("depth is null").limit(1).count() == 0
        done.append(placed.filter("depth is not null").withColumn("part", F.lit(0).cast("long")))
        if last:
            done.append(_cut_equal(placed.filter("depth is null"), limit))
        if left:
            break
        rows = materialize(placed.filter("depth is null").drop("_cell", "depth"), "shard-open")
        lo = hi
    out = reduce(DataFrame.unionByName, done)
    prefix = F.expr(f"lpad(bin(shiftright(_h, {BITS} - depth)), depth, '0')")
    return out.select(
        id_col,
        *carry,
        "n_bytes",
        F.when(F.col("depth") == 0, F.lit("")).otherwise(prefix).alias("shard"),
        F.col("depth").cast("int").alias("depth"),
        "part",
    )


def _cut_equal(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of full-depth buckets: equal rows, cut into runs that fit, apart for each partition."""
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1)))).cast("long")
    numbered = materialize(rows.withColumn("_n", F.monotonically_increasing_id()), "shard-equal")
    # 2**33 numbers a partition: runs never cross one
    return (
        numbered.withColumn("depth", F.lit(BITS))
        .withColumn("part", F.floor(F.col("_n") / per).cast("long"))
        .drop("_n")
    )


ORACLE = """
WITH r AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8) || substr(md5(coalesce(text, '')), 1, 7))::BIGINT AS h
  FROM documents),
lv AS (
  SELECT d, h >> (60 - d) AS p FROM r, range(0, 61) t(d) GROUP BY ALL HAVING sum(n_bytes) <= {limit}),
x AS (
  SELECT r.doc_id, r.n_bytes, r.h,
         coalesce((SELECT min(lv.d) FROM lv WHERE lv.p = r.h >> (60 - lv.d)), 60) AS depth
  FROM r)
SELECT doc_id, n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(h), 60, '0'), 60)[1:depth] END AS shard,
       depth::INT AS depth, 0::BIGINT AS part
FROM x
"""
