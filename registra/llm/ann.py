"""Approximate nearest neighbours by cross-polytope hashing.

A table turns a unit vector by a pseudo-rotation, three rounds of random signs and a fast Hadamard
transform, and files it under the nearest signed axis. In a large table of vectors further rotations
divide the buckets by their nearest axes, as many of them as keep a bucket at ``BUCKET`` rows in the
mean, so that a bucket does not grow with the table. A query probes in each table the cells that its
turned vector is nearest to, not only the first. What a probed bucket holds is ranked exactly, by
Euclidean distance on the original vectors, inside the bucket's task; only the best of each bucket
leave it, and vectors in buckets that nobody probes are not moved. Large buckets are cut into chunks
of bounded size, of rows and of queries, and all chunks are ranked with all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import finite_vectors, hinted, materialize

TABLES = 12
PROBES = 8
#: Mean rows of a bucket beyond which a further rotation divides it.
BUCKET = 4096
#: Rows, and queries, of a bucket that meet in one call at most, but for the unevenness of hashing.
CHUNK = 4096
#: Queries of a call that are ranked together, and pairs whose exact distances are taken together.
BLOCK, PAIRS = 256, 1 << 16
SEED = 7
BROADCAST_ROWS = 100_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(unit: np.ndarray, table: int, level: int = 0) -> np.ndarray:
    """A pseudo-rotation of one table; short vectors are filled with zeros to a power of two."""
    d = 1 << max(0, unit.shape[1] - 1).bit_length()
    x = np.zeros((len(unit), d))
    x[:, : unit.shape[1]] = unit
    signs = np.random.default_rng([SEED, table, d, level]).choice([-1.0, 1.0], (3, d))
    for s in signs:
        x = hadamard(x * s)
    return x


def level_axes(rows: int, dim: int, bucket: int) -> list[int]:
    """Axes of each rotation of a table: all of the first, and of further ones what ``rows`` need."""
    d = 1 << max(0, dim - 1).bit_length()
    axes, needed = [d], rows / (2 * d * bucket)
    while needed > 1:
        axes.append(min(d, math.ceil(needed / 2)))
        needed /= 2 * axes[-1]
    return axes


def cells(unit: np.ndarray, table: int, levels: list[int], most: int) -> np.ndarray:
    """The ``most`` nearest cells of each row, nearest first; a cell is a signed axis of each rotation."""
    code, loss = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
    for level, axes in enumerate(levels):
        x = rotated(unit, table, level)[:, :axes]
        signed = np.concatenate([x, -x], 1)
        order = signed.argmax(1)[:, None] if most == 1 else np.argsort(-signed, 1, kind="stable")[:, :most]
        near = np.take_along_axis(signed, order, 1)
        code = (code[:, :, None] * (2 * axes) + order[:, None, :]).reshape(len(unit), -1)
        loss = (loss[:, :, None] + ((near[:, :1] - near) ** 2)[:, None, :]).reshape(len(unit), -1)
        if loss.shape[1] > most:
            best = np.argsort(loss, 1, kind="stable")[:, :most]
            code, loss = np.take_along_axis(code, best, 1), np.take_along_axis(loss, best, 1)
    return code


def packed(v: np.ndarray) -> list[bytes]:
    """The bytes of each vector, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = v.astype("<f4")
    whole = (single == v).all(1)
    return [(single[j] if whole[j] else v[j]).tobytes() for j in range(len(v))]


def unpacked(values: pd.Series, dim: int) -> np.ndarray:
    single = values.map(len).to_numpy() == 4 * dim
    out = np.empty((len(values), dim))
    out[single] = np.frombuffer(b"".join(values[single]), "<f4").reshape(-1, dim)
    out[~single] = np.frombuffer(b"".join(values[~single]), float).reshape(-1, dim)
    return out


def _hashed(tables: int, probes: int, rows: int, bucket: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, asked = batch.column("dim").to_numpy(zero_copy_only=False), np.array(batch.column("asked").to_pylist(), bool)
            flat, ends = batch.column("v").values.to_numpy(zero_copy_only=False), batch.column("v").offsets.to_numpy()
            codes, probed, data = [None] * len(dims), [None] * len(dims), [b""] * len(dims)
            for d in np.unique(dims):
                places = np.flatnonzero(dims == d)
                v = np.stack([flat[ends[i] : ends[i + 1]] for i in places])
                # scaled first, so that very long and very short vectors keep their direction
                unit = v / np.abs(v).max(1, keepdims=True)
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                levels = level_axes(rows, int(d), bucket)
                # a query looks into as many cells as the root of what further rotations divide
                most = probes * math.ceil(math.sqrt(math.prod(2 * a for a in levels[1:])))
                home = np.concatenate([cells(unit, t, levels, 1) for t in range(tables)], 1)
                for i, code, one in zip(places, home.tolist(), packed(v), strict=True):
                    codes[i], data[i] = code, one
                asks = np.flatnonzero(asked[places])
                if len(asks):
                    near = np.stack([cells(unit[asks], t, levels, most) for t in range(tables)], 1)
                    for i, code in zip(places[asks], near.tolist(), strict=True):
                        probed[i] = code
            long = pa.list_(pa.int64())
            columns = [batch.column("id"), batch.column("dim"), pa.array(data, pa.binary()), pa.array(codes, long), pa.array(probed, pa.list_(long))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "dim", "v", "codes", "probes"])

    return run


def _best(q: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, length: np.ndarray, k: int) -> tuple:
    """Positions of queries and rows and the distance of the ``k`` nearest rows of each query."""
    own = row_ids[None, :] == q_ids[:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        # first by the expanded square, then exactly among all that may be in
        rough = length[None, :] - 2 * (q @ rows.T)
        near = ~own
        if len(rows) > k and len(np.unique(row_ids)) == len(rows) and np.isfinite(rough).all():
            rough[own] = np.inf
            kth = np.partition(rough, k - 1, 1)[:, k - 1]
            near &= rough <= (kth + 1e-9 * (1 + np.abs(kth) + (q**2).sum(1)))[:, None]
        at, of = np.nonzero(near)
        cuts = range(0, len(at), PAIRS)
        exact = [np.sqrt(((rows[of[i : i + PAIRS]] - q[at[i : i + PAIRS]]) ** 2).sum(1)) for i in cuts]
    exact = np.concatenate([np.empty(0), *exact])
    order = np.lexsort((row_ids[of], exact, at))
    # of rows with one id the nearest
    repeated = pd.DataFrame({"at": at[order], "id": row_ids[of[order]]}).duplicated().to_numpy()
    order = order[~repeated]
    at, of, exact = at[order], of[order], exact[order]
    first = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[first], of[first], exact[first]


def _nearest(k: int):
    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        asked, ids = x["asked"].to_numpy(bool), x["id"].to_numpy()
        found = [(np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))]
        if asked.any() and not asked.all():
            v = unpacked(x["v"], key[2])
            rows, row_ids, q, q_ids = v[~asked], ids[~asked], v[asked], ids[asked]
            with np.errstate(over="ignore"):
                length = (rows**2).sum(1)
            for i in range(0, len(q), BLOCK):
                at, of, score = _best(q[i : i + BLOCK], q_ids[i : i + BLOCK], rows, row_ids, length, k)
                found.append((q_ids[i : i + BLOCK][at], row_ids[of], score))
        names = ["query_id", "vec_id", "score"]
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def nearest_neighbours(
    rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, bucket: int = BUCKET
) -> DataFrame:
    """The ``k`` nearest rows found for each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``queries`` are rows too, told apart by id. Score: Euclidean distance in double precision; ties
    go to the smaller id. A row with the id of the query is no candidate of it. Vectors that are
    null, empty, zero or hold null or non-finite components take no part; rows of other lengths
    than the query's are no candidates; rows without id take no part. Repeated ids count once in a
    result; of a query's the vector with the fewest and then the smallest bytes is asked for. Ids are
    whole numbers. A query whose probed buckets hold fewer than ``k`` other rows is answered from all
    rows. Empty tables give no rows.
    """
    asked = finite_vectors(queries, id_col, vector_col).select("id", F.lit(True).alias("asked")).distinct()
    every = finite_vectors(rows, id_col, vector_col).filter(F.col("id").isNotNull() & F.exists("v", lambda c: c != 0))
    every = every.join(asked, "id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    schema = "id long, dim int, v binary, codes array<long>, probes array<array<long>>"
    every = every.select(F.col("id").cast("long").alias("id"), "dim", "v", "asked")
    hashed = materialize(every.mapInArrow(_hashed(tables, probes, every.count(), bucket), schema), "hashed")
    queried = hashed.filter("probes is not null").groupBy("id").agg(F.min(F.struct("dim", F.length("v"), "v", "probes")).alias("q"))
    queried = queried.select("id", "q.dim", "q.v", "q.probes")
    filed = hashed.select("id", "dim", "v", F.posexplode("codes").alias("t", "b"))
    probed = queried.select("id", "dim", "v", F.posexplode("probes").alias("t", "bs"))
    probed = probed.select("id", "dim", "v", "t", F.explode("bs").alias("b"))
    found = _ranked(filed, probed, k)
    # too few found: all rows, filed under one bucket a length
    short = queried.select("id").join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), F.col("id") == F.col("query_id"), "left")
    short = materialize(short.filter(F.coalesce("n", F.lit(0)) < k).select("id"), "short")
    if short.limit(1).count():
        whole = hashed.select("id", "dim", "v", F.lit(0).alias("t"), F.lit(0).alias("b"))
        rest = _ranked(whole, queried.join(short, "id", "left_semi").select("id", "dim", "v", F.lit(0).alias("t"), F.lit(0).alias("b")), k)
        found = found.join(short, F.col("query_id") == F.col("id"), "left_anti").unionByName(rest)
    return found.select("query_id", "rank", "vec_id", "score")


def _ranked(filed: DataFrame, probed: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of the filed rows for each probing row; both (id, dim, v, t, b)."""
    keys = ["t", "b", "dim"]

    def chunks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(name))

    def split(name: str) -> Column:
        return F.pmod(F.xxhash64("id", "v"), F.col(name)).cast("int")

    def each(name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    buckets = materialize(chunks(filed, "chunks").join(chunks(probed, "parts"), keys), "buckets")
    buckets = hinted(buckets, BROADCAST_ROWS)
    data = filed.join(buckets, keys).withColumn("c", split("chunks")).withColumns({"p": each("parts"), "asked": F.lit(False)})
    ask = probed.join(buckets, keys).withColumn("p", split("parts")).withColumns({"c": each("chunks"), "asked": F.lit(True)})
    columns = [*keys, "c", "p", "id", "v", "asked"]
    tasks = data.select(*columns).unionByName(ask.select(*columns))
    best = tasks.groupBy(*keys, "c", "p").applyInPandas(_nearest(k), "query_id long, vec_id long, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    way = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return materialize(best.withColumn("rank", F.row_number().over(way)).filter(F.col("rank") <= k), "nearest")
