"""String similarity on pairs, and text repair, as Arrow-batched functions.

Spark has no normaliser, no longest common subsequence and no Jaro-Winkler; these are the only
functions here that leave the JVM. Callers send them only the pairs that cheaper tests leave open.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode normal form C with white-space runs as one space."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()))


@F.pandas_udf(T.StringType())
def one_decimal(numbers: pd.Series) -> pd.Series:
    """A number with one decimal as printf writes it: its exact binary value, ties to even. Spark's
    ``format_string`` rounds decimal digits, ties up."""
    return numbers.map(lambda x: None if pd.isna(x) else f"{x:.1f}").astype(object)


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, by bit-parallel addition."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    s = full = (1 << len(a)) - 1
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - bin(s).count("1")


def indel(a: str, b: str) -> float:
    """200 x common subsequence / both lengths; two empty texts are equal."""
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler with prefix weight 0.1 up to 4 characters, whatever the base similarity."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    m, swaps = len(matched), sum(x != y for x, y in zip(matched, other, strict=True)) / 2
    base = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return base + 0.1 * prefix * (1 - base)


def _scored(measure):
    @F.pandas_udf(T.DoubleType())
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in pairs:
            yield pd.Series([None if x is None or y is None else measure(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


indel_ratio = _scored(indel)
jaro_winkler_ratio = _scored(jaro_winkler)


def name_scores(pairs: DataFrame, a: str, b: str, out: str = "score", least: float = 0.78) -> DataFrame:
    """Score of two names: 1 if equal, .95 if one holds the other (3 letters or more), else
    Jaro-Winkler if it reaches ``least``, else 0. Only pairs that need it leave the JVM."""
    x, y = F.col(a), F.col(b)
    easy = F.when(F.coalesce(x, F.lit("")) == "", 0.0).when(F.coalesce(y, F.lit("")) == "", 0.0).when(x == y, 1.0)
    easy = easy.when((F.least(F.length(x), F.length(y)) >= 3) & (x.contains(y) | y.contains(x)), 0.95)
    marked = pairs.withColumn("_easy", easy)
    hard = marked.filter("_easy is null").withColumn("_jw", jaro_winkler_ratio(x, y))
    hard = hard.withColumn(out, F.when(F.col("_jw") >= least, F.col("_jw")).otherwise(0.0)).drop("_jw", "_easy")
    return marked.filter("_easy is not null").withColumnRenamed("_easy", out).unionByName(hard)


def enum_match(rows: DataFrame, text: str, options: list[str], out: str = "match", least: float = 70.0) -> DataFrame:
    """The first option contained in a text, else the one with the best indel ratio from ``least``."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit: Column | None = None
    for o in options:
        has = low.contains(o.lower())
        hit = F.when(has, o) if hit is None else hit.when(has, o)
    marked = rows.withColumn(out, hit)
    rest = marked.filter(F.col(out).isNull()).drop(out)
    scores = F.array(*[F.struct(indel_ratio(low, F.lit(o.lower())).alias("s"), F.lit(-i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(options)])
    best = F.array_max(scores)
    rest = rest.withColumn("_b", best).withColumn(out, F.when(F.col("_b.s") >= least, F.col("_b.o"))).drop("_b")
    return marked.filter(F.col(out).isNotNull()).unionByName(rest)
