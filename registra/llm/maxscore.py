"""Exact top-k inner-product search by MaxScore.

A term is a dimension with a sign; its posting list holds the rows with a component of that sign,
with the component's size as impact. A query has one term for each of its non-zero components. The
most that a term can add is its weight times the largest impact in the list; rows of the opposite
list only lose. With the terms in falling order of that bound, the last ones whose bounds together
stay under the k-th best score so far are non-essential: a row that occurs in none of the essential
lists can't get in. Rows met in essential lists are probed in the other lists while what they have
plus the bounds to come can still compete.

Rows are dealt to shards and queries to blocks; a task holds one shard and one block, and the best
of the shards are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import finite_vectors, materialize

SHARD_ROWS = 8192
BLOCK_QUERIES = 1024
#: Terms that are probed between two looks at the bounds.
STRIDE = 8
SEEDS = 64


class Shard:
    """Posting lists of integer vectors (rows x dimensions)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.by_dim = np.ascontiguousarray(self.rows.T)
        self.most = {1: np.maximum(self.by_dim.max(1), 0), -1: np.maximum(-self.by_dim.min(1), 0)}
        self.lists = {s: [np.flatnonzero(c * s > 0) for c in self.by_dim] for s in (1, -1)}

    def top(self, query: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` rows, ties to the smaller id."""
        sign = np.sign(query)
        bound = np.abs(query) * np.where(sign > 0, self.most[1], self.most[-1])
        terms = np.argsort(-bound, kind="stable")
        terms = terms[sign[terms] != 0]
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # bounds from the j-th term on
        allowed = self.ids != without
        if allowed.sum() <= k or not len(terms):
            return self._best(np.flatnonzero(allowed), query, k)
        # a first k-th best: whole scores of the rows with the highest impact of the first terms
        seeds = set()
        for t in terms[:4]:
            own = self.lists[int(sign[t])][t]
            seeds.update(own[np.argsort(-np.abs(self.by_dim[t, own]), kind="stable")[:SEEDS]].tolist())
        seeds = np.array(sorted(seeds), int)
        seeds = seeds[allowed[seeds]]
        scores = np.sort(self.rows[seeds] @ query)[::-1]
        kth = scores[k - 1] if len(scores) >= k else None
        # essential terms: as few as keep the bounds of the others under the k-th best
        essential = len(terms) if kth is None else int(np.argmax(rest < kth)) if (rest < kth).any() else len(terms)
        met = np.zeros(len(self.ids), bool)
        for t in terms[:essential]:
            met[self.lists[int(sign[t])][t]] = True
        if kth is None or kth <= 0:
            met[:] = True  # rows in no list score up to 0
        alive = np.flatnonzero(met & allowed)
        have = np.zeros(len(alive), np.int64)
        for j in range(0, len(terms), STRIDE):
            some = terms[j : j + STRIDE]
            have += query[some] @ self.by_dim[some][:, alive]
            if kth is not None:
                stay = have + rest[min(j + STRIDE, len(terms))] >= kth
                if not stay.all():
                    alive, have = alive[stay], have[stay]
        return self._best(alive, query, k)

    def _best(self, at: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self.rows[at] @ query
        order = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[order]], scores[order]


def quantized(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x * scale).cast("long"))


def top_inner_products(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` rows of the highest integer inner product: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Components are turned into floor(scale * x). Ties go to the smaller id; a row with the query's
    id is no candidate of it. Vectors that are null, empty or hold null or non-finite components
    take no part, nor do rows without id; rows of other lengths than the query's are no candidates.
    Of repeated ids the first by vector is the query, and every row is a candidate. Scores must fit
    64 bits: a vector of which the integers have a norm of 2**31 or more raises an error. Empty tables give no rows.
    """

    def ready(x: DataFrame) -> DataFrame:
        x = finite_vectors(x, id_col, vector_col).filter("id is not null")
        square = F.aggregate("v", F.lit(0.0), lambda s, c: s + F.pow(F.floor(c * scale), F.lit(2.0)))
        # floor() of what is beyond a long would be cut without a word
        large = F.exists("v", lambda c: F.abs(c * scale) >= 2.0**31) | (square >= 2.0**62)
        x = x.withColumn("v", F.when(large, F.raise_error(F.lit("components too large for integer scores"))).otherwise(F.col("v")))
        return x.select("id", "dim", quantized(F.col("v"), scale).alias("v"))

    data = materialize(ready(rows), "rows")
    asked = materialize(ready(queries).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), "queries")
    counts = data.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"))
    blocks = asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))
    size = materialize(counts.join(blocks, "dim"), "sizes")  # a row for each length of vectors
    deal = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = data.join(size, "dim").withColumn("shard", deal("shards")).withColumn("block", each("blocks")).withColumn("asked", F.lit(False))
    right = asked.join(size, "dim").withColumn("block", deal("blocks")).withColumn("shard", each("shards")).withColumn("asked", F.lit(True))
    columns = ["dim", "shard", "block", "id", "v", "asked"]
    tasks = left.select(*columns).unionByName(right.select(*columns))

    def search(x: pd.DataFrame) -> pd.DataFrame:
        is_query = x["asked"].to_numpy()
        v, ids = np.stack(x["v"].to_list()), x["id"].to_numpy()
        out = []
        if not is_query.all():
            shard = Shard(ids[~is_query], v[~is_query])
            for q, own in zip(v[is_query], ids[is_query], strict=True):
                for i, s in zip(*shard.top(q, k, own), strict=True):
                    out.append((own, i, s))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")

    best = tasks.groupBy("dim", "shard", "block").applyInPandas(search, "query_id long, vec_id long, score long")
    way = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(way)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
