"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised. The exponent is bisected to
the largest one that reaches a target entropy, and never below the one at which some source would
be repeated more often than allowed. Weights are realised as budgeted block permutations: a source
is cut into hash blocks; each epoch takes its blocks in an order of its own; whole epochs take every
row, and in the last epoch only the boundary block is looked at row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hex_long, is_small, materialize

ENTROPY_SHARE = 0.97
MAX_REPEAT = 2.0
BLOCK_ROWS = 256
MAX_BLOCKS = 65_536
#: Sources whose shares are summed on the driver; those of more are summed by Spark, round by round.
DRIVER_SOURCES = 100_000
ROUNDS = 60
SEED = "mix"


def n_tokens(text: Column) -> Column:
    """Whitespace-separated tokens; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


class Shares:
    """Sums over the sources at an exponent. tokens: counts, all above 0."""

    def __init__(self, tokens: list[int]):
        self.tokens, self.total, self.count = tokens, sum(tokens), len(tokens)
        self.shares = [t / self.total for t in tokens]

    def norm(self, a: float) -> float:
        return sum(p**a for p in self.shares)

    def entropy(self, a: float) -> float:
        powers = [p**a for p in self.shares]
        total = sum(powers)
        return -sum(w / total * math.log(w / total) for w in powers)

    def repeat(self, a: float, budget: int) -> float:
        """How often the source that is drawn most often is drawn."""
        powers = [p**a for p in self.shares]
        total = sum(powers)
        return max(budget * w / total / t for w, t in zip(powers, self.tokens, strict=True))


class SparkShares:
    """The same for any number of sources. per: a row for each source, ``t`` its tokens."""

    def __init__(self, per: DataFrame):
        self.per = per.filter("t > 0")
        first = self.per.agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n")).first()
        self.total, self.count = first["t"], first["n"]

    def _sums(self, a: float):
        p = F.col("t") / F.lit(float(self.total))
        w = F.pow(p, F.lit(a))
        return self.per.agg(F.sum(w).alias("norm"), F.sum(w * F.ln(p)).alias("logs"), F.max(w / F.col("t")).alias("most")).first()

    def norm(self, a: float) -> float:
        return self._sums(a)["norm"]

    def entropy(self, a: float) -> float:
        s = self._sums(a)
        return math.log(s["norm"]) - a * s["logs"] / s["norm"]

    def repeat(self, a: float, budget: int) -> float:
        s = self._sums(a)
        return budget * s["most"] / s["norm"]


def temperature(shares: Shares | SparkShares, budget: int, entropy_share: float, max_repeat: float) -> float:
    """Exponent in [0, 1] for the sources' shares, by bisection.

    The largest exponent whose weights have ``entropy_share`` of the highest entropy, or 1 if the
    plain shares have it; raised where needed to the smallest one at which no source is drawn more
    than ``max_repeat`` times. A budget of more than ``max_repeat`` times all tokens is an error.
    """
    if budget > max_repeat * shares.total * (1 + 1e-9):
        raise ValueError(f"{budget} tokens can't be drawn from {shares.total} without drawing some more than {max_repeat} times")

    def bisect(lo_is_true) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(ROUNDS):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if lo_is_true(mid) else (lo, mid)
        return lo

    goal = entropy_share * math.log(shares.count)
    a = 1.0 if shares.entropy(1.0) >= goal else bisect(lambda x: shares.entropy(x) >= goal)
    if shares.repeat(a, budget) > max_repeat:
        a = max(a, bisect(lambda x: shares.repeat(x, budget) > max_repeat))
    return a


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
    budget: int | None = None,
    entropy_share: float = ENTROPY_SHARE,
    max_repeat: float = MAX_REPEAT,
    driver_sources: int = DRIVER_SOURCES,
) -> DataFrame:
    """Rows drawn for the mixture, once for each epoch in which they are drawn.

    Returns ``id_col``, ``source_col``, the ``carry`` columns, ``n_tokens``, ``epoch`` (from 0),
    ``block`` and ``block_rank`` (the block's place in that epoch's permutation, from 1). ``budget``
    is in tokens; by default all tokens of the input. A null source is a source of its own. Rows
    without tokens cost nothing: they come once in each whole epoch, and in the last epoch as the
    permutation has them. A source without tokens is taken once. Rows that share an id fall in one
    block and are ordered by size. An empty table gives no rows. A budget that ``max_repeat`` does
    not allow raises ValueError. The shares of up to ``driver_sources`` sources are summed on the
    driver, those of more by Spark.
    Columns in ``carry`` may not have the name of another column of the result; that raises an error.
    """
    taken = {id_col, source_col, "n_tokens", "epoch", "block", "block_rank"} & set(carry)
    if taken or len(set(carry)) < len(carry):
        raise ValueError(f"carried columns clash with the result's: {sorted(taken) or list(carry)}")
    rows = materialize(
        docs.select(
            F.col(id_col),
            F.col(source_col),
            *[F.col(c) for c in carry],
            n_tokens(F.col(text_col)).alias("n_tokens"),
            F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_md5"),
        ),
        "mix-rows",
    )
    spark = docs.sparkSession
    per = rows.groupBy(source_col).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    per = materialize(per, "mix-sources")
    few = is_small(per, driver_sources)
    if few:  # order matters for the last bits of the sums
        found = sorted(per.collect(), key=lambda r: (r[0] is not None, str(r[0])))
        shares = Shares([r["t"] for r in found if r["t"] > 0])
    else:
        shares = SparkShares(per)
    budget = shares.total if budget is None else budget
    a = temperature(shares, budget, entropy_share, max_repeat) if shares.count else 1.0
    norm = shares.norm(a) if shares.count else 1.0
    kind = rows.schema[source_col].dataType.simpleString()
    if few:
        plan = []
        for r in found:
            want = math.floor((r["t"] / shares.total) ** a / norm * budget + 1e-6) if r["t"] else 0
            epochs, rest = divmod(want, r["t"]) if r["t"] else (1, 0)
            plan.append((r[0], r["n"], epochs, rest, min(MAX_BLOCKS, math.ceil(r["n"] / BLOCK_ROWS))))
        plan = F.broadcast(spark.createDataFrame(plan, f"_s {kind}, _n long, _epochs long, _rest long, _blocks long"))
    else:
        share = F.pow(F.col("t") / F.lit(float(shares.total)), F.lit(a))
        want = F.floor(share / F.lit(norm) * F.lit(float(budget)) + 1e-6).cast("long")
        some = F.col("t") > 0
        plan = per.withColumn("_w", want).select(
            F.col(source_col).alias("_s"),
            F.col("n").alias("_n"),
            F.when(some, F.expr("_w div t")).otherwise(1).cast("long").alias("_epochs"),
            F.when(some, F.expr("_w % t")).otherwise(0).cast("long").alias("_rest"),
            F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("n") / BLOCK_ROWS)).cast("long").alias("_blocks"),
        )
    same = F.col(source_col).eqNullSafe(F.col("_s"))
    placed = rows.join(plan, same).drop("_s").withColumn("block", F.pmod(hex_long(F.col("_md5"), 1, 12), F.col("_blocks")))
    blocks = placed.groupBy(source_col, "block", "_epochs", "_rest").agg(F.sum("n_tokens").alias("_t"))

    def order(epoch: Column, thing: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(SEED), epoch.cast("string"), thing.cast("string")).cast("binary"))

    # every block in every epoch, with the tokens that come before it
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs")))
    drawn = blocks.select("*", epochs.alias("epoch")).filter("epoch < _epochs or _rest > 0")
    way = Window.partitionBy(source_col, "epoch").orderBy(order(F.col("epoch"), F.col("block")), "block")
    drawn = drawn.withColumns(
        {"block_rank": F.row_number().over(way), "_before": F.sum("_t").over(way.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")}
    ).filter("epoch < _epochs or _before < _rest")
    drawn = drawn.withColumn("_cut", F.expr("epoch = _epochs and _before + _t > _rest"))
    right = drawn.select(F.col(source_col).alias("_s"), F.col("block").alias("_b"), "epoch", "block_rank", "_before", "_cut")
    got = placed.drop("_epochs", "_n", "_blocks").join(right, same & (F.col("block") == F.col("_b"))).drop("_s", "_b")
    whole, cut = got.filter("not _cut"), got.filter("_cut")
    inner = Window.partitionBy(source_col, "block").orderBy(order(F.col("epoch"), F.col("_md5")), "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_upto", F.col("_before") + F.sum("n_tokens").over(inner)).filter("_upto <= _rest").drop("_upto")
    columns = [id_col, source_col, *carry, "n_tokens", F.col("epoch").cast("int").alias("epoch"), "block", F.col("block_rank").cast("int").alias("block_rank")]
    return whole.unionByName(cut).select(*columns)


ORACLE = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '\S+'))::BIGINT AS n_tokens,
         md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
per AS (SELECT source, sum(n_tokens)::BIGINT AS t, count(*) AS n FROM r GROUP BY source),
l AS (
  SELECT list(t / tot ORDER BY source NULLS FIRST) AS shares, list(t::DOUBLE ORDER BY source NULLS FIRST) AS toks,
         any_value(tot)::DOUBLE AS budget
  FROM (SELECT *, sum(t) OVER ()::DOUBLE AS tot FROM per WHERE t > 0)),
be(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, mid, -list_sum([w * ln(w) FOR w IN [pow(p, mid) / list_sum([pow(q, mid) FOR q IN shares]) FOR p IN shares]])
                 >= {share} * ln(len(shares)) AS ok
        FROM (SELECT be.*, (lo + hi) / 2 AS mid, l.shares FROM be, l WHERE i < 60))),
br(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, mid, list_max([budget * pow(shares[j], mid) / list_sum([pow(q, mid) FOR q IN shares]) / toks[j] FOR j IN range(1, len(shares) + 1)])
                 > {repeat} AS ok
        FROM (SELECT br.*, (lo + hi) / 2 AS mid, l.* FROM br, l WHERE i < 60))),
e AS (
  SELECT CASE WHEN -list_sum([p * ln(p) FOR p IN shares]) >= {share} * ln(len(shares)) THEN 1.0 ELSE (SELECT lo FROM be WHERE i = 60) END AS a, l.* FROM l),
f AS (
  SELECT CASE WHEN list_max([budget * pow(shares[j], a) / list_sum([pow(q, a) FOR q IN shares]) / toks[j] FOR j IN range(1, len(shares) + 1)]) > {repeat}
              THEN greatest(a, (SELECT lo FROM br WHERE i = 60)) ELSE a END AS a, budget, shares FROM e),
want AS (
  SELECT source, t, n, CASE WHEN t > 0 THEN floor(pow(t / budget, a) / list_sum([pow(q, a) FOR q IN shares]) * budget + 1e-6)::BIGINT ELSE 0 END AS w
  FROM per, f),
plan AS (
  SELECT source, CASE WHEN t > 0 THEN w // t ELSE 1 END AS epochs, CASE WHEN t > 0 THEN w % t ELSE 0 END AS rest,
         least(65536, ceil(n / 256))::BIGINT AS nb FROM want),
placed AS (
  SELECT r.*, epochs, rest, ('0x' || substr(h, 1, 12))::BIGINT % nb AS block FROM r JOIN plan ON r.source IS NOT DISTINCT FROM plan.source),
b AS (SELECT source, block, epochs, rest, sum(n_tokens)::BIGINT AS t FROM placed GROUP BY ALL),
d0 AS (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM b),
d AS (
  SELECT *, row_number() OVER w AS block_rank, sum(t) OVER w - t AS before FROM d0 WHERE epoch < epochs OR rest > 0
  WINDOW w AS (PARTITION BY source, epoch ORDER BY md5('mix:' || epoch || ':' || block), block ROWS UNBOUNDED PRECEDING)),
g AS (
  SELECT p.doc_id, p.source, p.n_tokens, p.h, p.rest, p.epochs, d.epoch, p.block, d.block_rank, d.before, d.epoch = d.epochs AND d.before + d.t > d.rest AS cut
  FROM placed p JOIN d ON p.source IS NOT DISTINCT FROM d.source AND p.block = d.block WHERE d.epoch < d.epochs OR d.before < d.rest),
c AS (
  SELECT *, before + sum(n_tokens) OVER (PARTITION BY source, block ORDER BY md5('mix:' || epoch || ':' || h), n_tokens ROWS UNBOUNDED PRECEDING) AS upto
  FROM g WHERE cut)
SELECT doc_id, source, n_tokens, epoch::INT AS epoch, block, block_rank::INT AS block_rank FROM g WHERE NOT cut
UNION ALL
SELECT doc_id, source, n_tokens, epoch::INT, block, block_rank::INT FROM c WHERE upto <= rest
""".replace("{share}", str(ENTROPY_SHARE)).replace("{repeat}", str(MAX_REPEAT))
