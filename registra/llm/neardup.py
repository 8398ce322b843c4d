"""Near-duplicate classes by DartMinHash on weighted word shingles.

A text is the weighted set of its shingles of five words (weight: how often it occurs). Darts are
thrown by hash into weight x rank regions of each element, at a rate that gives a text about
``K ln K + 2 K`` darts however large its weight is; a signature coordinate is the earliest dart that
falls to it. Equal texts are one class before anything else. Texts that share a band of
coordinates are candidates, weighted Jaccard similarity of the whole texts decides, and classes are
the connected components of the links found.

A band group links its members to two pivots, which is linear in its size. Where links are missing
after that, the rest of the group is compared in blocks: compact signatures tell which members may
have a link to another component, and the texts of those are compared exactly, all with all inside
a task, of which only the links that connect something leave it.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hinted, materialize, release, text_key
from .suffix import RollingHash

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
K = BANDS * ROWS
DARTS = int(K * math.log(K) + 2 * K)
#: Pairs whose signatures agree on a smaller share are not compared exactly. At similarity 0.8 a
#: share this low is five standard deviations away.
POSSIBLE = 0.62
BLOCK = 512
CALL = 2048
#: Bytes of text.
BLOCK_BYTES = 8 << 20
CALL_BYTES = 16 << 20
BROADCAST_ROWS = 500_000

#: Ends of the first rank cells; beyond the last they go on in steps of 1.
CELLS = np.array([0.0, 1 / 64, 1 / 16, 1 / 4, 1.0])

_white = re.compile(rb"[\t-\r ]")
_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class WordHash:
    """64-bit hashes of the words of a text, which white space (of ASCII) parts.

    Words are hashed all at once as polynomials of their bytes, in pieces of about PIECE bytes.
    """

    PIECE = 1 << 18

    def __init__(self):
        self.roller = RollingHash(self.PIECE)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def __call__(self, text: str) -> np.ndarray:
        raw, at, out = text.encode("utf-8", "surrogatepass"), 0, []
        while at < len(raw):
            end = at + self.PIECE
            if end < len(raw):  # up to white space, however far it is
                gap = _white.search(raw, end)
                end = gap.start() if gap else len(raw)
            out.append(self._hashed(np.frombuffer(raw[at:end], np.uint8)))
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def _hashed(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.roller.power[0]):
            self.roller = RollingHash(2 * len(data))
        edge = np.diff(np.concatenate([[True], self.space[data], [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = self.roller.sums(data, 0)
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * self.roller.inverse[0][start] + (end - start).astype(np.uint64) * _G)


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of the runs of ``size`` words; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(size, len(words))):
            out = mix(out + words[i : i + n] + _G)
    return out


def weighted(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(elements, return_counts=True)
    return keys, counts.astype(float)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima; two empty sets are equal."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 1.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    low = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    return float(low / (total - low))


def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... until they reach 1 but for 1e-13."""
    p, out = math.exp(-mean), []
    total, j = 0.0, 0
    while total < 1 - 1e-13:
        total += p
        out.append(total)
        j += 1
        p *= mean / j
    return np.array(out)


_COUNTS = [_poisson(m) for m in [*np.diff(CELLS), 1.0]]


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(float) / 2.0**53


def _darts(owner: np.ndarray, unit: np.ndarray, room: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets, ids and ranks of the darts below the rank limit of their set.

    ``unit``: hash of an element and a unit step of its weight; ``room``: how much of the step the
    weight fills. The plane of weight x rank is cut into these steps times the rank cells; the
    number of darts in a cell and their places are hashes of it, so two sets see the same darts
    wherever their regions overlap.
    """
    own_limit = limit[owner]
    parts = []
    first = len(CELLS) - 1
    with np.errstate(over="ignore"):
        for c in range(first + 1):
            if c < first:
                at = np.flatnonzero(own_limit > CELLS[c])
                number = np.full(len(at), c)
            else:  # cells [1, 2), [2, 3) ... up to the limit
                many = np.maximum(np.ceil(own_limit).astype(np.int64) - 1, 0)
                at = np.repeat(np.arange(len(owner)), many)
                number = first + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            if not len(at):
                continue
            cell = mix(unit[at] ^ ((number.astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)))
            n = np.searchsorted(_COUNTS[c], _uniform(cell), "right")
            which = np.repeat(np.arange(len(at)), n)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix(cell[which] + (nth.astype(np.uint64) + np.uint64(1)) * _G)
            place = mix(dart ^ _M1)
            lo = CELLS[c] if c < first else (number - first + 1.0)[which]
            rank = lo + (CELLS[c + 1] - CELLS[c] if c < first else 1.0) * ((place >> np.uint64(32)).astype(float) / 2.0**32)
            source = at[which]
            ok = (rank < own_limit[source]) & ((place & np.uint64(0xFFFFFFFF)).astype(float) / 2.0**32 < room[source])
            parts.append((owner[source[ok]], dart[ok], rank[ok]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def dart_signatures(owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, sets: int, k: int = K) -> np.ndarray:
    """Earliest dart of each of ``k`` coordinates for each set; a set without elements has zeros.

    owner: number of the set of each element; keys: element hashes, different within a set;
    weights: above 0.
    """
    units = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(keys)), units)
    step = np.arange(len(element)) - np.repeat(np.cumsum(units) - units, units)
    with np.errstate(over="ignore"):
        unit = mix(keys[element] + step.astype(np.uint64) * _G)
    room, owner_of = weights[element] - step, owner[element]
    total = np.bincount(owner, weights, sets)
    limit = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    out, filled = np.zeros((sets, k), np.uint64), np.zeros((sets, k), bool)
    todo = total > 0
    while todo.any():
        mine = todo[owner_of]
        own, ids, ranks = _darts(owner_of[mine], unit[mine], room[mine], limit)
        order = np.argsort(ranks)[::-1]  # the earliest is written last
        own, ids = own[order], ids[order]
        where = (mix(ids ^ _M2) % np.uint64(k)).astype(np.int64)
        out[own, where] = ids
        filled[own, where] = True
        todo &= ~filled.all(1)
        limit = limit * 2
    return out


def dart_signature(keys: np.ndarray, weights: np.ndarray, k: int = K) -> np.ndarray:
    return dart_signatures(np.zeros(len(keys), np.int64), keys, weights, 1, k)[0]


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, bands, compact signature); texts without words have no bands."""
    hashed = WordHash()
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            some = batch.slice(at, 128)
            sets = [np.sort(shingles(hashed(t))) for t in some.column(1).to_pylist()]
            size = np.array([len(x) for x in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(new)
            weight = np.diff(np.append(begin, len(flat))).astype(float)
            s = dart_signatures(owner[begin], flat[begin], weight, len(sets))
            h = np.zeros((len(sets), BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for r in range(ROWS):
                    h = mix(h + s.reshape(len(sets), BANDS, ROWS)[:, :, r] + _G)
            bands = [x if n else [] for x, n in zip(h.view(np.int64).tolist(), size, strict=True)]
            compact = [x.tobytes() if n else b"" for x, n in zip((s >> np.uint64(40)).astype(np.uint8), size, strict=True)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(bands, pa.list_(pa.int64())), pa.array(compact, pa.binary())], names=["_k", "bands", "sig"])


def _compared(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of which the texts reach the similarity ``least``, with that similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        last: tuple[str | None, tuple] = (None, ())
        for batch in batches:
            keep, measured = [], []
            for i, (x, y) in enumerate(zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)):
                if last[0] != y:
                    last = (y, weighted(shingles(hashed(y))))
                alike = weighted_jaccard(weighted(shingles(hashed(x))), last[1])
                if alike >= least:
                    keep.append(i)
                    measured.append(alike)
            pair = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*pair, pa.array(measured, pa.float64())], names=["a", "b", "similarity"])

    one = texts.select(F.col("_k").alias("a"), F.col("_text").alias("ta"))
    two = texts.select(F.col("_k").alias("b"), F.col("_text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long, similarity double")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    return _compared(pairs, texts, SIMILARITY).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(k, comp) for every node of ``links`` (a, b): comp is the smallest node it is linked with.

    Smallest labels go to neighbours and are then followed (pointer jumping) until nothing
    changes; each round is a written table.
    """
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialize(both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.min("a")).alias("comp")), "label")
    while True:
        near = both.join(label, F.col("b") == F.col("k")).groupBy("a").agg(F.min("comp").alias("near"))
        step = label.join(near, F.col("k") == F.col("a")).select("k", F.least("comp", "near").alias("next"), "comp")
        jump = step.select(F.col("k").alias("_j"), F.col("next").alias("_far"))
        step = step.join(jump, F.col("next") == F.col("_j")).select("k", F.least("next", "_far").alias("comp"), F.col("comp").alias("was"))
        step = materialize(step, "label")
        label = step.select("k", "comp")
        if step.filter("comp != was").limit(1).count() == 0:
            return label


def _dealt(members: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of every comparison: group, blocks ``_i`` and ``_j``, own block ``_own``, call ``_call``.

    A group of at most a block is compared as a whole. In a larger one, the members of its largest
    component are linked already and are not compared with each other: their blocks meet those of
    the others only, and those of the others meet all. Blocks and calls are bounded in rows and in
    bytes of text (a longer text is a block of its own), whatever a group holds.
    """
    n_bytes = F.octet_length("_text") if "_text" in columns else F.lit(0)
    by_comp = members.groupBy("group", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(n_bytes).alias("b"))
    main = F.max(F.struct("n", "comp", "b"))
    size = by_comp.groupBy("group").agg(F.sum("n").alias("_n"), F.sum("b").alias("_b"), main.alias("_m"))

    def blocks(n: Column, b: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(b / BLOCK_BYTES)).cast("int")

    whole = (F.col("_n") <= BLOCK) & (F.col("_b") <= BLOCK_BYTES)
    size = size.select(
        "group",
        F.when(~whole, F.col("_m.comp")).alias("_main"),
        F.when(whole, 1).otherwise(blocks(F.col("_n") - F.col("_m.n"), F.col("_b") - F.col("_m.b"))).alias("_others"),
        F.when(whole, 0).otherwise(blocks(F.col("_m.n"), F.col("_m.b"))).alias("_mains"),
        *[F.col(c).cast("long").alias(c) for c in ("_n", "_b")],
        *[F.when(whole, 0).otherwise(F.col(f"_m.{c}")).cast("long").alias(f"_main_{c}") for c in "nb"],
    )
    # a group of one component has nothing to compare
    size = materialize(size.filter("_others > 0"), "open-sizes")

    def sent(c: str) -> Column:
        return F.sum((F.col(f"_{c}") - F.col(f"_main_{c}")) * (F.col("_others") + F.col("_mains")) + F.col(f"_main_{c}") * F.col("_others"))

    rows, total = size.agg(sent("n"), sent("b")).first()
    calls = max(1, -(-(rows or 0) // CALL), -(-(total or 0) // CALL_BYTES))
    dealt = members.join(size.select("group", "_main", "_others", "_mains"), "group")
    is_main, at = F.col("comp").eqNullSafe(F.col("_main")), F.hash("k", F.lit(5))
    own = F.when(is_main, F.col("_others") + F.pmod(at, F.col("_mains"))).otherwise(F.pmod(at, F.col("_others")))
    meets = F.when(is_main, F.col("_others")).otherwise(F.col("_others") + F.col("_mains"))
    other = F.explode(F.sequence(F.lit(0), meets - 1)).alias("_other")
    tasks = dealt.select("group", *columns, own.alias("_own"), other).withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
    return tasks.withColumn("_call", F.pmod(F.xxhash64("group", "_i", "_j"), F.lit(calls)))


def _in_blocks(members: DataFrame, columns: list[str], compare, schema: str) -> DataFrame:
    """``compare`` on the blocks of each group that ``_dealt`` lets meet.

    Most groups are small, so pairs of blocks are dealt to calls of about CALL rows.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["group", "_i", "_j", "_own", "k"])
        data = {c: x[c].to_numpy() for c in ("group", "_i", "_j", "_own", *columns)}
        new = np.any([data[c][1:] != data[c][:-1] for c in ("group", "_i", "_j")], axis=0)
        ends = [0, *(np.flatnonzero(new) + 1).tolist(), len(x)]
        out = []
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            own = data["_own"][lo:hi]
            out += compare({c: v[lo:hi] for c, v in data.items()}, own == data["_i"][lo], own == data["_j"][lo])
        return pd.DataFrame(out, columns=names, dtype="int64")

    return _dealt(members, columns).groupBy("_call").applyInPandas(run, schema)


def _has_partner(x: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Members whose signature leaves a link possible to one of another component."""
    n = len(left)
    sig = np.frombuffer(b"".join(x["sig"]), np.uint8).reshape(n, K)
    comp, hit = x["comp"], np.zeros(n, bool)
    right = np.flatnonzero(right)
    for a in np.flatnonzero(left):
        cand = right[comp[right] != comp[a]]
        if len(cand):
            near = cand[(sig[cand] == sig[a]).mean(1) >= POSSIBLE]
            hit[near] = True
            hit[a] |= len(near) > 0
    return list(zip(x["group"][hit].tolist(), x["k"][hit].tolist(), strict=True))


def _links_between(x: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Enough links of SIMILARITY to connect all members that such links connect.

    Weights are whole numbers, so a text is the set of its (shingle, number) units, and what two
    texts share is a product of two rows of a 0/1 matrix. Units of one text only have no column.
    """
    hashed = WordHash()
    units = []
    for text in x["_text"]:
        keys = np.sort(shingles(hashed(text)))
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        nth = np.arange(len(keys)) - np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
        with np.errstate(over="ignore"):
            units.append(mix(keys + nth.astype(np.uint64) * _G))
    size = np.array([len(u) for u in units], np.float32)
    owner = np.repeat(np.arange(len(units)), size.astype(int))
    _, column, count = np.unique(np.concatenate(units), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    both = np.zeros((len(units), len(units)), np.float32)
    for lo in range(0, len(shared), 4096):
        some = (column >= lo) & (column < lo + 4096)
        m = np.zeros((len(units), min(4096, len(shared) - lo)), np.float32)
        m[owner[some], column[some] - lo] = 1
        both += m @ m.T
    # in whole numbers: both / (a + b - both) >= SIMILARITY
    near = both * (1 + SIMILARITY) >= SIMILARITY * (size[:, None] + size[None, :]) - 1e-3
    near &= (left[:, None] & right[None, :]) | (right[:, None] & left[None, :])
    k, todo, found = x["k"].tolist(), np.ones(len(units), bool), []
    for root in range(len(units)):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            a = front.pop()
            new = np.flatnonzero(near[a] & todo)
            todo[new] = False
            front += new.tolist()
            found += [(min(k[a], k[b]), max(k[a], k[b])) for b in new]
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of every row: ``id_col``, ``class_id`` and ``similarity``, a row for each row of ``docs``.

    ``class_id`` is the smallest id of the rows in the class. ``similarity`` is that of the whole text
    with the text of this row, which is below SIMILARITY where only a chain of other texts
    joins the two; 1 for the text itself. Rows with equal texts are in one class. Equal means equal in a 64-bit
    hash. A null text counts as empty; texts without words are equal only to equal texts. A class of
    which all ids are null has a null ``class_id``. An empty table gives no rows.
    """
    keyed = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_k"))
    return keyed.join(text_classes(docs, id_col, text_col), "_k").select(F.col("_id").alias(id_col), "class_id", "similarity")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates; a row goes only if a kept one is that similar to it.

    Of each class the text with the most links is kept (of two texts alone the one with the smallest
    id, null ids last) and the texts linked with it go; what is left of the class, as in a chain of texts
    that drift apart, is treated likewise until no text is left. Of equal texts the row with the
    smallest id stays. All columns stay. Texts without words are no duplicates of each other and
    all stay.
    """
    wordless = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"\S")
    worded = docs.filter(~wordless)
    texts, links = text_links(worded, id_col, text_col)
    gone = covered(links, texts)
    lead = texts.join(gone, "_k", "left_anti").select(F.col("_k").alias("__k"), F.col("_first").alias("__first"), F.col("_n").alias("__n"))
    found = worded.join(lead, text_key(text_col) == F.col("__k")).filter(F.col(id_col).eqNullSafe(F.col("__first")))
    # only rows that are equal in id and text are left to choose from
    chosen = found.filter("__n = 1").unionByName(found.filter("__n > 1").dropDuplicates(["__k"]))
    return chosen.select(docs.columns).unionByName(docs.filter(wordless))


def covered(links: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts ``_k`` that a kept text has a link with; the others are kept.

    links: (a, b); texts: (``_k``, ``_first``). In each round the texts that come before all their
    open neighbours are kept and their neighbours go. More links come first, then the smaller id of
    two texts alone, else the smaller hash.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy(F.col("a").alias("_k")).agg(F.count(F.lit(1)).alias("_links")).join(texts, "_k")
    # smaller comes first; a hash keeps chains in the order of their ids from taking many rounds
    chance = F.when(F.col("_links") > 1, F.xxhash64("_k")).otherwise(0)
    order = degree.select("_k", F.struct(-F.col("_links"), chance.alias("_h"), F.col("_first").isNull().alias("_null"), "_first", "_k").alias("_o"))
    order = materialize(order, "link-order")
    one = order.select(F.col("_k").alias("a"), F.col("_o").alias("oa"))
    two = order.select(F.col("_k").alias("b"), F.col("_o").alias("ob"))
    left, gone = materialize(both.join(one, "a").join(two, "b"), "open-links"), []
    while left.limit(1).count():
        kept = left.groupBy("a").agg(F.min(F.col("oa") < F.col("ob")).alias("first")).filter("first").select("a")
        kept = materialize(kept, "kept")
        lost = materialize(left.join(kept, "a").select(F.col("b").alias("_k")).distinct(), "lost")
        gone.append(lost)
        done = kept.select(F.col("a").alias("_k")).unionByName(lost)
        rest = left.join(done, F.col("a") == F.col("_k"), "left_anti").join(done, F.col("b") == F.col("_k"), "left_anti")
        rest = materialize(rest, "open-links")
        release(left, kept)
        left = rest
    release(left, order)
    return functools.reduce(DataFrame.unionByName, gone) if gone else texts.select("_k").limit(0)


def text_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each different text its key ``_k``, ``class_id`` and ``similarity`` to the first text of the class."""
    texts, links = text_links(docs, id_col, text_col)
    named = texts.join(components(links), F.col("_k") == F.col("k"), "left").select("_k", "_first", F.coalesce("comp", "_k").alias("comp"))
    named = materialize(named, "named")
    # null ids come last; of texts that share the smallest id one is taken
    least = named.groupBy("comp").agg(F.min("_first").alias("class_id"), F.min(F.struct(F.col("_first").isNull(), "_first", "_k")).getField("_k").alias("lead"))
    least = materialize(least, "leads")
    classed = materialize(named.join(least, "comp").select("_k", "class_id", "lead"), "classes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    pairs = classed.filter("_k != lead").select(F.col("_k").alias("a"), F.col("lead").alias("b"))
    keys = materialize(pairs.select(F.explode(F.array("a", "b")).alias("_k")).distinct(), "lead-keys")
    some = docs.select(text_key(text_col).alias("_k"), text.alias("_text")).join(hinted(keys, BROADCAST_ROWS), "_k", "left_semi")
    some = materialize(some.groupBy("_k").agg(F.min("_text").alias("_text")), "lead-texts")
    measured = materialize(_compared(pairs, some, 0.0), "lead-similarity")
    out = classed.join(measured.select(F.col("a").alias("_k"), "similarity"), "_k", "left")
    out = materialize(out.select("_k", "class_id", F.coalesce("similarity", F.lit(1.0)).alias("similarity")), "text-classes")
    release(texts, links, named, least, classed, keys, some, measured)
    return out


def text_links(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Each different text (key ``_k``, smallest id ``_first``, number of rows ``_n``), and links
    (a, b) of SIMILARITY that connect all texts which such links connect. Written tables."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_k"), text.alias("_text"))
    # equal texts meet on the map side first, however many they are; the texts themselves stay put
    texts = materialize(keyed.groupBy("_k").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")), "texts")
    signed = keyed.select("_k", "_text").mapInArrow(_signatures, "_k long, bands array<long>, sig binary")
    signed = materialize(signed.groupBy("_k").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig")), "signatures")

    def texts_of(keys: DataFrame) -> DataFrame:
        keys = hinted(materialize(keys.distinct(), "wanted"), BROADCAST_ROWS)
        return materialize(keyed.select("_k", "_text").join(keys, "_k", "left_semi").groupBy("_k").agg(F.min("_text").alias("_text")), "wanted-texts")

    banded = signed.select("_k", F.posexplode("bands").alias("band", "h")).select("_k", F.xxhash64("band", "h").alias("group"))
    many = banded.groupBy("group").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("lo"), F.max("_k").alias("hi")).filter("lo != hi")
    grouped = materialize(banded.join(materialize(many.drop("hi"), "many"), "group"), "groups")
    # of each group two pivots: the smallest key, and the member that meets most texts in all its
    # groups, which in a family of copies is the one they come from
    popular = materialize(grouped.groupBy("_k").agg(F.sum("_n").alias("_pop")), "popular")
    centre = grouped.join(popular, "_k").groupBy("group").agg(F.max(F.struct("_pop", "_k")).getField("_k").alias("mid"))
    star = grouped.join(materialize(centre, "centre"), "group").select(F.col("_k").alias("b"), F.explode(F.array("lo", "mid")).alias("a"))
    star = star.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sig = signed.select("_k", "sig")
    star = star.join(sig.select(F.col("_k").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("_k").alias("b"), F.col("sig").alias("sb")), "b")
    star = materialize(_possible(star), "star")
    star_texts = texts_of(star.select(F.explode(F.array("a", "b")).alias("_k")))
    links = materialize(_verified(star, star_texts), "star-links")
    release(star_texts)
    comp = components(links)
    # of a group of two the only pair has been compared
    member = grouped.filter("_n > 2").select("group", "_k").join(comp, F.col("_k") == F.col("k"), "left")
    member = materialize(member.select("group", F.col("_k").alias("k"), F.coalesce("comp", "_k").alias("comp")), "members")
    open_groups = member.groupBy("group").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo != _hi").select("group")
    open_groups = materialize(open_groups, "open-groups")
    rest = materialize(member.join(open_groups, "group").join(sig.withColumnRenamed("_k", "k"), "k"), "open")
    alive = _in_blocks(rest, ["k", "comp", "sig"], _has_partner, "group long, k long").distinct()
    alive_keys = materialize(alive, "alive")
    alive_texts = texts_of(alive_keys.select(F.col("k").alias("_k")))
    alive = alive_keys.join(rest.select("group", "k", "comp"), ["group", "k"]).join(alive_texts.withColumnRenamed("_k", "k"), "k")
    more = materialize(_in_blocks(alive, ["k", "_text"], _links_between, "a long, b long").distinct(), "open-links")
    found = materialize(links.unionByName(more), "all-links")
    release(signed, grouped, popular, star, links, member, open_groups, rest, alive_keys, alive_texts, more)
    return texts, found


def _possible(pairs: DataFrame) -> DataFrame:
    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in ("sa", "sb")]
            keep = pa.array(np.flatnonzero((sides[0] == sides[1]).mean(1) >= POSSIBLE) if batch.num_rows else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")
