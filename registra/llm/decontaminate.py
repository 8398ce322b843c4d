"""Removal of benchmark passages by FM-indexes of the training shards.

The benchmark's phrases are windows of ``WINDOW`` words (a shorter item is one window). A task takes
its documents together in shards. A word that no item holds ends every occurrence, so a shard's
text is its stretches of words of the benchmark, each as long as the shortest window at least and closed
by a terminator. Over it stands an FM-index:

* a suffix array by doubling, in which only places that still tie are sorted again, and the word
  before each suffix in that order;
* a wavelet matrix of those words, which counts any word before any place in one step a bit;
* backward search, all windows side by side from their last words, leaves a range of suffixes for each
  window that occurs;
* each suffix of a range walks back by ranks to the next sampled place (one in ``SAMPLE``, and the
  starts of stretches), whose text position is kept.

Occurrences become word spans of documents and are merged. Nothing is shuffled: the benchmark is
cut into blocks of at most ``BLOCK_BYTES`` (or one item), which are shipped to the tasks, and the documents
are read once a block. Words are told by two 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key
from .suffix import CHUNK, RollingHash

WINDOW = 10
#: Words of stretches under one index, and documents that wait for it, at most.
SHARD_WORDS = 1 << 20
SHARD_DOCS = 1 << 16
SAMPLE = 8
BLOCK_BYTES = 8 << 20
LOCATED = 1 << 20
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def words_of(text: Column) -> Column:
    """Words of a text: digits, a to z and what is beyond ASCII, after A to Z are lower-cased."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, BREAK), lambda w: w != "")


@functools.lru_cache(maxsize=1)
def _hasher(room: int) -> RollingHash:
    return RollingHash(room)


def _split(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start and end of each word of joined texts, and its two hashes."""
    data = LOWER[data]
    inside = IN_WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = borders[(borders > 0) & (borders < len(data))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = CHUNK if len(data) <= CHUNK else len(data)
    hasher = _hasher(size)
    return start, end, [hasher.of(hasher.sums(data, w), start, end, w) for w in (0, 1)]


@dataclass
class Phrases:
    """Windows of a block of items, ready for tasks."""

    hashes: np.ndarray  # of the words, ascending; word i + 1 has the i-th
    checks: np.ndarray
    maybe: np.ndarray  # by the top bits of the hash: whether a word has them
    windows: np.ndarray  # words from the last one back, 0 where the window has no more
    lengths: np.ndarray
    owners: list[np.ndarray]  # sets of items
    owner: np.ndarray  # window to its set
    items: list[str] = field(default_factory=list)

    def known(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Number of each word, 0 for those of no item."""
        out = np.zeros(len(hashes[0]), np.int32)
        some = np.flatnonzero(self.maybe[hashes[0] >> np.uint64(44)])
        h, check = hashes[0][some], hashes[1][some]
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        hit = (self.hashes[at] == h) & (self.checks[at] == check) if len(self.hashes) else np.zeros(len(some), bool)
        out[some[hit]] = at[hit] + 1
        return out


def phrases_of(items: list[tuple[str | None, list[str]]], window: int = WINDOW) -> Phrases:
    """Windows of the items (id, words); a null id has windows but is not named in results."""
    words = sorted({w for _, ws in items for w in ws})
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([0, *map(len, raw)])
    hasher = _hasher(CHUNK if len(data) <= CHUNK else len(data))
    h = [hasher.of(hasher.sums(data, w), ends[:-1], ends[1:], w) for w in (0, 1)]
    order = np.argsort(h[0], kind="stable")
    number = dict(zip([words[i] for i in order], range(1, len(words) + 1), strict=True))
    maybe = np.zeros(1 << 20, bool)
    maybe[h[0] >> np.uint64(44)] = True
    names = sorted({i for i, _ in items if i is not None})
    named = {x: i for i, x in enumerate(names)}
    found: dict[tuple[int, ...], set[int]] = {}
    for item, ws in items:
        ids = [number[w] for w in ws]
        for at in range(max(1, len(ids) - window + 1) if ids else 0):
            found.setdefault(tuple(ids[at : at + window]), set()).update([] if item is None else [named[item]])
    table, sets = np.zeros((len(found), window), np.int32), {}
    owner = np.zeros(len(found), np.int64)
    for i, (key, who) in enumerate(found.items()):
        table[i, : len(key)] = key[::-1]
        owner[i] = sets.setdefault(tuple(sorted(who)), len(sets))
    return Phrases(h[0][order], h[1][order], maybe, table, (table > 0).sum(1), [np.array(s, np.int64) for s in sets], owner, names)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text of words above 0 in which each 0 is a terminator of its own."""
    n = len(text)
    stops = np.flatnonzero(text == 0)
    key = text.astype(np.int64) + len(stops)
    key[stops] = np.arange(len(stops))
    order = np.argsort(key, kind="stable")
    by_key = key[order]
    head = np.concatenate([[True], by_key[1:] != by_key[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # of equal ones the first place
    single = head & np.concatenate([head[1:], [True]])
    tied, step = order[~single], 1
    while len(tied):
        beyond = np.minimum(tied + step, n - 1)  # what ties has not reached its terminator yet
        tied = tied[np.lexsort((rank[beyond], rank[tied]))]
        group, after = rank[tied], rank[np.minimum(tied + step, n - 1)]
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        whole = np.concatenate([[True], group[1:] != group[:-1]])
        at = np.arange(len(tied))
        place = group + at - np.maximum.accumulate(np.where(whole, at, 0))
        new = np.maximum.accumulate(np.where(head, place, 0))
        order[place] = tied
        rank[tied] = new
        single = head & np.concatenate([head[1:], [True]])
        tied = tied[~single]
        step *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        """Index of a text of words above 0, each stretch closed by a 0."""
        n = len(text)
        order = suffix_order(text)
        self.before = text[order - 1]  # the text ends in a terminator, so the first word has one before it
        self.alphabet = np.unique(text)
        symbol = np.searchsorted(self.alphabet, self.before)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbol, minlength=len(self.alphabet)))])
        self.symbol = symbol
        kept = (order % sample == 0) | (self.before == 0)
        self.kept, self.kept_before, self.places = kept, np.cumsum(kept) - kept, order[kept]
        self.levels = []
        for bit in reversed(range(max(1, int(len(self.alphabet) - 1).bit_length()))):
            ones = (symbol >> bit & 1).astype(bool)
            self.levels.append((bit, n - int(ones.sum()), np.concatenate([[0], np.cumsum(ones)]).astype(np.int32)))
            symbol = np.concatenate([symbol[~ones], symbol[ones]])

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, at = np.zeros(len(symbol), np.int64), before.astype(np.int64)
        for bit, zeros, ones in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            lo_ones, at_ones = ones[lo], ones[at]
            lo = np.where(one, zeros + lo_ones, lo - lo_ones)
            at = np.where(one, zeros + at_ones, at - at_ones)
        return at - lo

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the windows that occur and the ranges of their suffixes."""
        symbol = np.minimum(np.searchsorted(self.alphabet, windows), len(self.alphabet) - 1)
        alive = np.flatnonzero(((self.alphabet[symbol] == windows) | (windows == 0)).all(1) & (lengths > 0))
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), len(self.before))
        for step in range(windows.shape[1]):
            going = np.flatnonzero(lengths[alive] > step)
            c = symbol[alive[going], step]
            lo[going] = self.less[c] + self.rank(c, lo[going])
            hi[going] = self.less[c] + self.rank(c, hi[going])
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the suffixes in these rows of the array."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        going = np.flatnonzero(~self.kept[rows])
        while len(going):
            c = self.symbol[rows[going]]
            rows[going] = self.less[c] + self.rank(c, rows[going])
            steps[going] += 1
            going = going[~self.kept[rows[going]]]
        return self.places[self.kept_before[rows]] + steps


def occurrences(text: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, text position) of all occurrences, some at a time."""
    index = FMIndex(text)
    window, lo, hi = index.search(phrases.windows, phrases.lengths)
    first = np.concatenate([[0], np.cumsum(hi - lo)])
    at = 0
    while at < len(window):
        end = max(at + 1, int(np.searchsorted(first, first[at] + LOCATED, side="right")) - 1)
        n = hi[at:end] - lo[at:end]
        which = np.repeat(np.arange(at, end), n)
        rows = lo[which] + np.arange(len(which)) - (first[which] - first[at])
        yield window[which], index.locate(rows)
        at = end


class Shard:
    """Documents of a task that wait for their index."""

    def __init__(self, phrases: Phrases):
        self.phrases, self.shortest = phrases, int(phrases.lengths.min()) if len(phrases.lengths) else 0
        self.key: list[pa.Array] = []
        self.n_words: list[np.ndarray] = []
        self.docs = self.size = 0
        self.text: list[np.ndarray] = []
        self.where: list[np.ndarray] = []  # of each stretch: document, first word, place in the text
        self.bytes: list[np.ndarray] = []  # start and end of each word of the text in its document

    def add(self, key: list[pa.Array], data: np.ndarray, borders: np.ndarray) -> None:
        start, end, hashes = _split(data, borders[:-1])
        first = np.searchsorted(start, borders)
        self.n_words.append(np.diff(first))
        if self.shortest and len(start):
            known = self.phrases.known(hashes)
            doc = np.searchsorted(first, np.arange(len(start)), side="right") - 1
            joined = (known[1:] > 0) & (known[:-1] > 0) & (doc[1:] == doc[:-1])
            lo = np.flatnonzero((known > 0) & np.concatenate([[True], ~joined]))
            hi = np.flatnonzero((known > 0) & np.concatenate([~joined, [True]])) + 1
            long = hi - lo >= self.shortest
            lo, hi = lo[long], hi[long]
            size = hi - lo
            if len(lo):
                begin = np.concatenate([[0], np.cumsum(size + 1)])
                text, spans = np.zeros(begin[-1], np.int32), np.zeros((2, begin[-1]), np.int64)
                which = np.repeat(np.arange(len(lo)), size)
                word = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                at = begin[which] + word - lo[which]
                text[at] = known[word]
                spans[:, at] = np.stack([start[word], end[word]]) - borders[doc[word]]
                self.text.append(text)
                self.bytes.append(spans)
                self.where.append(np.stack([doc[lo] + self.docs, lo - first[doc[lo]], begin[:-1] + self.size]))
                self.size += len(text)
        self.key += key
        self.docs += len(borders) - 1

    def result(self) -> pa.RecordBatch:
        spans: list[list] = [[] for _ in range(self.docs)]
        items: list[list] = [[] for _ in range(self.docs)]
        if self.text:
            text, where, place = np.concatenate(self.text), np.concatenate(self.where, 1), np.concatenate(self.bytes, 1)
            covered, owned = np.zeros(len(text) + 1, np.int64), []
            for window, at in occurrences(text, self.phrases):
                np.add.at(covered, at, 1)
                np.add.at(covered, at + self.phrases.lengths[window], -1)
                doc = where[0, np.searchsorted(where[2], at, side="right") - 1]
                owned.append(np.unique(np.stack([doc, self.phrases.owner[window]]), axis=1))
            hit = np.cumsum(covered)[:-1] > 0
            edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            for lo, hi in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
                doc, word, begin = where[:, np.searchsorted(where[2], lo, side="right") - 1].tolist()
                spans[doc].append({"start": word + lo - begin, "end": word + hi - begin, "first_byte": place[0, lo], "end_byte": place[1, hi - 1]})
            pairs = np.unique(np.concatenate(owned, 1), axis=1) if owned else np.zeros((2, 0), np.int64)
            for doc, some in zip(*np.unique(pairs[0], return_index=True), strict=True):
                sets = pairs[1, some : np.searchsorted(pairs[0], doc, side="right")]
                items[doc] = [self.phrases.items[i] for i in np.unique(np.concatenate([self.phrases.owners[s] for s in sets]))]
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "end", "first_byte", "end_byte")]))
        keys = [pa.concat_arrays([k[i] for k in self.key]) for i in range(len(self.key[0]))]
        columns = [*keys, pa.array(np.concatenate(self.n_words), pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["_id", "_k", "n_words", "spans", "items"])


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """Keys, bytes and borders of some texts of a batch, about CHUNK bytes or one text at a time."""
    text = batch.column(2).cast(pa.large_string()).fill_null("")
    buffers = text.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        end = min(end, len(text))
        yield [batch.column(i).slice(at, end - at) for i in (0, 1)], data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _searching(phrases: Phrases):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(phrases)
        for batch in batches:
            for key, data, borders in _pieces(batch):
                shard.add([key], data, borders)
                if shard.size >= SHARD_WORDS or shard.docs >= SHARD_DOCS:
                    yield shard.result()
                    shard = Shard(phrases)
        if shard.docs:
            yield shard.result()

    return scan


SPAN = "struct<start: long, end: long, first_byte: long, end_byte: long>"


def _merged(spans: Column) -> Column:
    """Overlapping or touching spans joined, in order."""

    def join(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["first_byte"].alias("first_byte"), F.greatest(last["end_byte"], s["end_byte"]).alias("end_byte"))
        touches = (F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"])
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{SPAN}>"), join)


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """(item, words) of the benchmark in blocks of about ``block_bytes``; equal rows count once."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    items = items.select("item", words_of(F.col("text")).alias("words"), F.pmod(F.xxhash64("item", "text"), F.lit(n)).alias("block")).filter(F.size("words") > 0)
    if n == 1:
        return [items]
    items = materialize(items, "benchmark")
    return [items.filter(F.col("block") == i) for i in range(n)]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where benchmark windows occur in each whole text.

    Returns ``id_col``, ``n_words``, ``spans`` (merged; start and end in words, first_byte and end_byte
    in the UTF-8 text) and ``items``: ids, as strings in order, of the items with a window that occurs.
    A row for each row of ``docs``. A null or empty text has no words; an item without words has no
    window, one with a null id is found but not named; ids that repeat are named once. Other
    columns play no part. With no benchmark nothing is hit; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(F.col(id_col).alias("_id"), row_key(id_col, text_col).alias("_k"), F.col(text_col).alias("_text"))
    outs = []
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        phrases = phrases_of([(r.item, r.words) for r in block.collect()], window)
        outs.append(keyed.mapInArrow(_searching(phrases), f"_id {kind}, _k binary, n_words long, spans array<{SPAN}>, items array<string>"))
    out = outs[0]
    if len(outs) > 1:
        hits = functools.reduce(DataFrame.unionByName, [o.filter(F.size("spans") > 0) for o in outs])
        hits = hits.groupBy("_k").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        hits = hits.select("_k", _merged(F.col("spans")).alias("spans"), "items")
        out = outs[0].select("_id", "_k", "n_words").join(hits, "_k", "left")
        out = out.withColumns({"spans": F.coalesce("spans", F.array().cast(f"array<{SPAN}>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.select(F.col("_id").alias(id_col), "n_words", "spans", "items")


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of ``contamination``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), items AS (
  SELECT item_id::VARCHAR AS item,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, array_to_string(w[i : i + 9], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows), grams AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT d.rid, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM docs d, sizes s WHERE len(d.w) >= s.n)
), found AS (
  SELECT x.rid, x.i, x.n, w.item FROM grams x JOIN windows w ON w.n = x.n AND w.g = x.g
), hit AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM found)) GROUP BY rid
), named AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM found GROUP BY rid
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(k.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(k.l, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit h USING (rid) LEFT JOIN named k USING (rid)
"""
