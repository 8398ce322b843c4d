"""Similarity and containment joins of short texts by inverted indexes; no step makes all pairs.

Texts are compared within a group. Two indexes find candidates, an exact test follows:

* containment: a text that holds another holds its rarest gram; the one to be found gives that gram,
  the others all of theirs;
* Jaro-Winkler from a bound on: the bound asks for a number of common characters. Each text is the
  set of its characters, numbered where they repeat, in the order of their rarity; two sets that
  share m of their characters share one of the first ``n - m + 1`` of either. The shorter text of a pair
  gives the few that a longer one asks for, the longer one a few more. Texts with a common beginning
  may share less, so those of three letters have an index of their own.

Any order of characters or grams gives the same result, so frequencies are kept for the most common ones only.

The indexes are far larger than the files they are made of, by which Spark would broadcast them: their joins
are merges of sorted rows (``SORTED``), whatever the sizes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions.similarity import name_scores
from registra.operators.storage import dropped, stored

GRAM = 3
#: Characters or grams of which the frequency is known to the order; others count as rare.
COMMON = 4096
#: More often than this no character stands in a text.
TIMES = 1 << 40
#: Hint of a join of which no side may be broadcast.
SORTED = "merge"


def grams(text: Column, size: int) -> Column:
    """Distinct grams of a text; none if it is shorter."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: text.substr(i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def numbered(text: Column) -> Column:
    """Characters of a text, each with how often it has occurred so far, as numbers."""

    def token(i: Column) -> Column:
        c, head = text.substr(i, F.lit(1)), text.substr(F.lit(1), i)
        return F.ascii(c).cast("long") * TIMES + F.length(head) - F.length(F.replace(head, c, F.lit("")))

    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), token)).otherwise(F.array().cast("array<bigint>"))


def frequencies(rows: DataFrame, tokens: Column) -> DataFrame:
    """One row with the map ``_often`` of the COMMON most frequent tokens."""
    often = rows.select(F.explode(tokens).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "t").limit(COMMON)
    return often.agg(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("_often"))


def by_rarity(tokens: Column) -> Column:
    """Tokens from the rarest on, by the map ``_often``."""
    keyed = F.transform(tokens, lambda t: F.struct(F.coalesce(F.try_element_at(F.col("_often"), t), F.lit(0)).alias("n"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda x: x["t"])


def holders(keys: DataFrame, rows: DataFrame, key: str, text: str, group: list[str] | None = None, size: int = GRAM) -> DataFrame:
    """Pairs (group, key, text and what else ``rows`` has) where ``text`` holds ``key``; empty keys are held by none.

    keys and rows: distinct in group and text for a result without repeats.
    """
    group = group or []
    asked = keys.filter(F.length(key) > 0).withColumn("_size", F.least(F.length(key), F.lit(size)))
    sizes = sorted(r[0] for r in asked.select("_size").distinct().collect())  # at most ``size`` numbers
    given = F.concat(*[grams(F.col(text), n) for n in sizes]) if sizes else F.array().cast("array<string>")
    own = F.lit(None).cast("array<string>")
    for n in sizes:
        own = F.when(F.col("_size") == n, grams(F.col(key), n)).otherwise(own)
    asked = asked.join(F.broadcast(frequencies(rows, given))).withColumn("_gram", by_rarity(own)[0]).drop("_often", "_size")
    index = rows.withColumn("_gram", F.explode(given))
    return asked.join(index.hint(SORTED), [*group, "_gram"]).filter(F.col(text).contains(F.col(key))).drop("_gram")


def alike(left: DataFrame, right: DataFrame, group: list[str], a: str, b: str, least: float) -> DataFrame:
    """Candidates (group, a, b): all pairs whose Jaro-Winkler similarity may reach ``least``."""
    # with l equal letters at the beginning, Jaro must reach this, which asks for m with m/|a| + m/|b| >= need
    need = [max(0.0, 3 * (least - 0.1 * n) / (1 - 0.1 * n) - 1) for n in range(5)]
    often = F.broadcast(frequencies(right.select(F.col(b).alias("_n")), numbered(F.col("_n"))))

    def side(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.filter(F.length(name) > 0).select(*group, name).join(often).withColumn("_t", by_rarity(numbered(F.col(name)))).drop("_often")
        return rows.withColumn("_l", F.length(name))

    # each index reads the tokens again, so they are made once
    x = stored(side(left, a).withColumnsRenamed({"_t": "_ta", "_l": "_la"}), "tokens")
    y = stored(side(right, b).withColumnsRenamed({"_t": "_tb", "_l": "_lb"}), "tokens")
    first = lambda rows, name, n: rows.filter(F.length(name) >= n).withColumn("_key", F.substring(name, 1, n))

    def keyed(rows: DataFrame, tokens: str, size: str, name: str, ratio: float, start: int, short: bool) -> DataFrame:
        """Rows by the tokens that a partner at least as long (``short``) or at most as long must meet."""
        share = ratio / 2 if short else max(0.0, ratio - 1)
        must = F.greatest(F.lit(1), F.ceil(F.col(size) * share - 1e-9).cast("int"))
        head = F.slice(tokens, 1, F.greatest(F.lit(1), F.col(size) - must + 1))
        return rows.withColumn("_key", F.explode(F.transform(head, lambda t: F.concat(F.substring(name, 1, start), F.lit("\0"), t.cast("string")))))

    found = [first(x, a, 3).join(first(y, b, 3).hint(SORTED), [*group, "_key"])]
    for ratio, start in ((need[0], 0), (need[2], 1)):
        for short in (True, False):
            pairs = keyed(x, "_ta", "_la", a, ratio, start, short).join(keyed(y, "_tb", "_lb", b, ratio, start, not short).hint(SORTED), [*group, "_key"])
            found.append(pairs.filter("_la <= _lb" if short else "_la > _lb"))
    shared = F.size(F.array_intersect("_ta", "_tb"))
    jaro = (shared / F.col("_la") + shared / F.col("_lb") + 1) / 3
    same = F.lit(0)
    for n in range(1, 5):
        same = F.when((F.least("_la", "_lb") >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n)), n).otherwise(same)
    able = jaro + 0.1 * same * (1 - jaro) >= least - 1e-9
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = stored(out.filter((shared > 0) & able).select(*group, a, b).distinct(), "alike")
    dropped(x, y)
    return out


def matching_names(left: DataFrame, right: DataFrame, group: list[str], a: str, b: str, least: float = 0.78) -> DataFrame:
    """Matching names (group, a, b, score): 1 if equal, .95 if one of three letters or more holds the
    other, else Jaro-Winkler from ``least`` on.

    left: (group, a), right: (group, b), distinct; names are clean and empty ones match nothing.
    """
    left, right = stored(left.select(*group, a), "names"), stored(right.select(*group, b), "names")
    long = lambda rows, name: rows.filter(F.length(name) >= 3)
    found = left.join(right.withColumn(a, F.col(b)).hint(SORTED), [*group, a]).filter(F.length(a) > 0).select(*group, a, b)
    found = found.unionByName(holders(long(left, a), long(right, b), a, b, group).select(*group, a, b))
    found = found.unionByName(holders(long(right, b), long(left, a), b, a, group).select(*group, a, b))
    near = alike(left, right, group, a, b, least)
    found = stored(found.unionByName(near).distinct(), "name-pairs")
    dropped(left, right, near)
    return name_scores(found, a, b, "score", least).filter("score > 0")


def required_overlap(a: int, b: int, prefix: int, least: float) -> int:
    """Fewest common characters of two texts that can reach ``least``; for tests of the index."""
    ratio = max(0.0, 3 * (least - 0.1 * prefix) / (1 - 0.1 * prefix) - 1)
    return math.ceil(ratio * a * b / (a + b) - 1e-9)
