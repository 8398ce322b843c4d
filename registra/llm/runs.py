"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least ``TIMES`` periods and ``LEAST`` words
long, that no neighbouring word extends. Each scale (a, b] seeks the periods from a + 1 to b:

* every window of b positions selects its smallest hash of b words, the first in a tie. Within a run
  of such a period q, b words agree with others only at multiples of q, and each window holds a
  whole period, so from one selected place the next one lies q further and has the same hash.
  A run has at least 4q - 2b + 2 windows, and b <= (3a + 4) / 2 makes them q + 1 or more, enough for
  two selected places: each run has a seed;
* neighbouring selected places with equal hashes whose distance is in (a, b] are seeds. Of seeds
  in a row at one distance the first is enough; each is extended to both sides by bisecting on prefix
  hashes, and what results is compared word by word.

Periods up to ``DIRECT`` are found by comparing the words with themselves at each lag. A multiple of
a period gives the same stretch as the period, so of equal stretches the smallest period is kept.

Texts are taken together in batches, longest first; a scale reads only texts that can hold its
periods. The work is linear in the words for each scale, and a text is in one task, whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .suffix import first_minima

LEAST = 6
TIMES = 4
DIRECT = 24
#: Words of the texts that are taken together; a longer text is taken alone.
BATCH_WORDS = 1 << 19
#: An odd number, so that it has an inverse modulo 2^64.
MULTIPLIER = 0x9E3779B97F4A7C15


class Prefix:
    """Hashes of any stretch of numbers, from prefix sums in 64-bit arithmetic."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        with np.errstate(over="ignore"):
            x = values.astype(np.uint64) + np.uint64(1)
            for shift, by in ((33, 0xFF51AFD7ED558CCD), (29, 0xC4CEB9FE1A85EC53)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
            power = np.full(n + 1, MULTIPLIER, np.uint64)
            power[0] = 1
            power = np.cumprod(power, dtype=np.uint64)
            # the sum is scaled to the power of its end: inverse powers are those of the inverse
            inverse = np.full(n + 1, pow(MULTIPLIER, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            self.inverse = np.cumprod(inverse, dtype=np.uint64)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[end] - self.sums[start]) * self.inverse[start]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(29))

    def grams(self, k: int) -> np.ndarray:
        at = slice(0, len(self.sums) - k)
        with np.errstate(over="ignore"):
            h = (self.sums[k:] - self.sums[at]) * self.inverse[at]
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return h ^ (h >> np.uint64(29))


def scales(longest: int, direct: int = DIRECT) -> Iterator[tuple[int, int]]:
    """(a, b] until all periods of a run in ``longest`` words are covered."""
    a = direct
    while a < longest // TIMES:
        b = (3 * a + 4) // 2
        yield a, b
        a = b


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of at least ``least`` true values."""
    if len(equal) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(equal[1:] != equal[:-1]) + 1
    edges = np.concatenate([[0], edges, [len(equal)]])
    first = 0 if equal[0] else 1
    lo = edges[first:-1:2]
    hi = edges[first + 1 :: 2][: len(lo)]
    long = hi - lo >= least
    return lo[long], hi[long]


def _reach(values: Prefix, left: np.ndarray, right: np.ndarray, room: np.ndarray, forward: bool) -> np.ndarray:
    """How many words agree from two places on, forward from them or backward before them; at most ``room``."""
    low, high = np.zeros(len(left), np.int64), room.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        if forward:
            same = values.of(left, left + mid) == values.of(right, right + mid)
        else:
            same = values.of(left - mid, left) == values.of(right - mid, right)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _lag(ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = _stretches(ids[:-q] == ids[q:], max(LEAST, TIMES * q) - q)
    return lo, hi + q


def _seeded(ids: np.ndarray, values: Prefix, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Start, end and lag of the stretches that grow from the seeds of a scale."""
    if len(ids) < 2 * b:
        return
    grams = values.grams(b)
    at = first_minima(grams, b)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    lag = np.diff(at)
    seed = (lag > a) & (lag <= b) & (grams[at[1:]] == grams[at[:-1]])
    # a seed that goes on at the distance of the one before it grows to the same stretch
    seed[1:] &= ~(seed[:-1] & (lag[1:] == lag[:-1]))
    left, d = at[:-1][seed], lag[seed]
    if not len(left):
        return
    right = left + d
    lo = left - _reach(values, left, right, left, False)
    hi = right + _reach(values, left, right, len(ids) - right, True)
    long = hi - lo >= np.maximum(LEAST, TIMES * d)
    found = np.unique(np.stack([lo[long], hi[long], d[long]]), axis=1)
    for lo, hi, d in found.T:
        if not (ids[lo : hi - d] == ids[lo + d : hi]).all():  # two hashes collided
            for exact in zip(*_lag(ids, int(d)), strict=True):
                yield (*exact, d)
        else:
            yield lo, hi, d


def runs_of(texts: list[np.ndarray], direct: int = DIRECT) -> list[np.ndarray]:
    """Runs of each text (numbers of its words) as rows (start, length, period), by start and period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    size = np.array([len(texts[i]) for i in order])
    # a number of its own after each text keeps runs from crossing its border
    top = max((int(t.max()) for t in texts if len(t)), default=0) + 1
    ids = np.concatenate([np.concatenate([texts[i], [top + k]]) for k, i in enumerate(order)] or [np.zeros(0, np.int64)])
    begin = np.concatenate([[0], np.cumsum(size + 1)])

    def reading(q: int) -> int:
        """End of the texts that are long enough for runs of period q."""
        return int(begin[np.searchsorted(-size, -max(LEAST, TIMES * q), side="right")])

    found: list[np.ndarray] = []
    for q in range(1, direct + 1):
        some = ids[: reading(q)]
        if len(some) > q:
            lo, hi = _lag(some, q)
            found.append(np.stack([lo, hi, np.full(len(lo), q)]))
    longest = int(size[0]) if len(size) else 0
    if longest // TIMES > direct:
        values = Prefix(ids[: reading(direct + 1)])
        for a, b in scales(longest, direct):
            n = reading(a + 1)
            part = Prefix.__new__(Prefix)
            part.inverse, part.sums = values.inverse[: n + 1], values.sums[: n + 1]
            rows = list(_seeded(ids[:n], part, a, b))
            if rows:
                found.append(np.array(rows, np.int64).T)
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    rows = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    if not rows.shape[1]:
        return out
    rows = rows[:, np.lexsort((rows[2], rows[1], rows[0]))]
    fresh = np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
    lo, hi, q = rows[:, fresh]
    owner = np.searchsorted(begin, lo, side="right") - 1
    rows = np.stack([lo - begin[owner], hi - lo, q], 1)
    order2 = np.lexsort((q, lo))
    rows, owner = rows[order2], owner[order2]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k, i in enumerate(order):
        out[i] = rows[cut[k] : cut[k + 1]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words stay: those in no run after the first period of that run."""
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(gone)[:n] == 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(key: list, words: list[list[bytes]]) -> pa.RecordBatch:
    number = defaultdict(count().__next__)
    texts = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words]
    found = runs_of(texts)
    kept = []
    for w, rows in zip(words, found, strict=True):
        if len(rows):
            w = [w[i] for i in np.flatnonzero(kept_words(len(w), rows))]
        kept.append(b" ".join(w).decode("utf-8", "surrogatepass"))
    flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in found])])
    spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i], pa.int64()) for i in range(3)], fields=list(RUN)))
    return pa.RecordBatch.from_arrays([pa.concat_arrays(key), pa.array([len(w) for w in words], pa.int64()), spans, pa.array(kept, pa.string())], names=["_id", "n_words", "runs", "collapsed"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, words, size = [], [], 0
    for batch in batches:
        for i, text in enumerate(batch.column(1)):
            # exactly space and the controls from tab to carriage return part words of bytes
            w = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            if words and size + len(w) > BATCH_WORDS:
                yield _batch(key, words)
                key, words, size = [], [], 0
            key.append(batch.column(0).slice(i, 1))
            words.append(w)
            size += len(w) + 1
    if words:
        yield _batch(key, words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All runs of each whole text and the text without their repetitions.

    Returns ``id_col``, ``n_words``, ``runs`` (array of start, length and period in words, by start, then
    period) and ``collapsed``: the words in no run after its first period, joined by one space. Words
    are parted by space and the controls 9 to 13, nothing else. A row for each row of ``docs``; a null or empty
    text has no words, no runs and an empty ``collapsed``. Other columns play no part; an empty
    table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    some = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = some.mapInArrow(_runs, f"_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("_id", id_col)


def planted(docs: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) in which ids that the rule picks (h % 10 = 0 for h, the CRC-32 of the
    decimal id) repeat a part of their own words: with g = h // 10, words from g % n on have the period
    1 + (n - g % n) // (3 + g % 8). A null id is never picked."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    picked = docs.withColumns({"_g": F.when(h % 10 == 0, g)}).withColumn("_w", F.when(F.col("_g").isNotNull(), words))
    n = F.size("_w")
    picked = picked.withColumn("_a", F.when(n > 0, F.col("_g") % n)).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i))
    text = F.array_join(F.transform(at, lambda i: F.get(F.col("_w"), i.cast("int"))), " ")
    return picked.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest of ``periodic_runs``: the number of runs, the longest one (ties: smallest start, then
    period; nulls where there is none), and hashes of all runs and of the collapsed text."""
    longest: Column = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    spelled = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("_l", longest)
    return out.select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_l.start")).alias("start"),
        F.col("_l.length").alias("length"),
        (-F.col("_l.period")).alias("period"),
        F.floor(1000 * F.col("_l.length") / -F.col("_l.period")).cast("long").alias("exponent_milli"),
        F.sha2(spelled, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
