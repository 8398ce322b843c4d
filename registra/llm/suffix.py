"""Exact removal of long repeats by prefix-free parsing.

A rolling hash over ``CORE`` bytes triggers phrase borders: in each string of ``LENGTH`` bytes the
place of the smallest hash (the first, in a tie) is a trigger, so every such string holds one, at
the same place wherever it occurs. All strings with the same trigger start in one run of positions;
the run with all the bytes its strings cover is a phrase. Phrases make the dictionary, their
occurrences the parse:

* a phrase that occurs twice repeats every string in it, wherever it occurs;
* a phrase that occurs once can share strings only with other phrases around an equal trigger.
  Those phrases, each of the dictionary once, meet in one partition. There two suffix arrays are
  built: one of the dictionary (what stands before a trigger, compared backwards, so that the
  suffixes of the phrases that end there lie together) and one of the parse (what follows the
  trigger). With the longest common prefixes of neighbours in both, every start is placed in corpus
  order by its dictionary suffix and the rank of what follows; a start with a neighbour that agrees
  in LENGTH bytes is repeated.

Suffixes around different triggers never share LENGTH bytes, so the arrays need no order across
triggers, and a trigger's phrases are the unit that Spark deals out. Around a trigger with more
than GROUP different phrases no array is built, as a task's memory must not depend on the data:
those phrases are cut into blocks of BLOCK string starts, equal blocks repeat all their strings, and
blocks that agree in the bytes common to all their strings are counted string by string, by the
128-bit hashes of the strings. Nothing larger than a document is in one place.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, is_small, materialize, release, row_key

LENGTH = 400
CORE = 128
BLOCK = 16
#: Different phrases around one trigger for which suffix arrays are built.
GROUP = 1024
BROADCAST_ROWS = 1_000_000
#: Bytes of text that are hashed together; arrays of a few dozen times this size are held.
CHUNK = 1 << 18


class RollingHash:
    """Two independent polynomial hashes of byte strings, in 64-bit arithmetic."""

    def __init__(self, room: int):
        rng = np.random.default_rng(20240229)
        self.tables = rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
        odd = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
        self.power = [self._powers(b, room) for b in odd]
        self.inverse = [self._powers(pow(b, -1, 1 << 64), room) for b in odd]

    @staticmethod
    def _powers(base: int, room: int) -> np.ndarray:
        out = np.ones(room + 1, np.uint64)
        done, step = 1, base
        with np.errstate(over="ignore"):
            while done <= room:
                n = min(done, room + 1 - done)
                out[done : done + n] = out[:n] * np.uint64(step)
                done += n
                step = step * step % (1 << 64)
        return out

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.tables[which][data] * self.power[which][: len(data)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, which: int) -> np.ndarray:
        """Hashes of the strings from start to end (positions)."""
        with np.errstate(over="ignore"):
            x = (sums[end] - sums[start]) * self.inverse[which][: len(sums)][start]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return x ^ (x >> np.uint64(29))


def first_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value, the first in a tie, of each run of ``width`` values."""
    n = len(values)
    bits = np.uint64(max(1, int(n).bit_length()))
    keyed = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = keyed
    table = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, 1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    starts = n - width + 1
    least = np.minimum(back[:starts], ahead[width - 1 : width - 1 + starts])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _groups(raw: list[bytes]) -> Iterator[list[int]]:
    """Numbers of the texts, joined up to about CHUNK bytes."""
    some, size = [], 0
    for i, x in enumerate(raw):
        if some and size + len(x) > CHUNK:
            yield some
            some, size = [], 0
        some.append(i)
        size += len(x)
    if some:
        yield some


def phrases(raw: list[bytes], length: int = LENGTH, core: int = CORE, whole: bool = True) -> dict[str, np.ndarray]:
    """Phrases of the texts: text number, first and last string start, trigger, core hash, and phrase hashes if ``whole``."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("text", "lo", "hi", "trig", "core", "h1", "h2")}
    texts = [i for i, x in enumerate(raw) if len(x) >= length]
    picked = [raw[i] for i in texts]
    hasher = RollingHash(max([CHUNK, *map(len, picked)]))
    for some in _groups(picked):
        data = np.frombuffer(b"".join(picked[i] for i in some), np.uint8)
        sums = [hasher.sums(data, w) for w in ((0, 1) if whole else (0,))]
        grams = hasher.of(sums[0], slice(0, len(data) - core + 1), slice(core, len(data) + 1), 0)
        at = first_minima(grams, length - core + 1)
        begin = 0
        for i in some:
            n = len(picked[i]) - length + 1
            own = at[begin : begin + n]
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            lo, hi = cut + begin, np.concatenate([cut[1:], [n]]) - 1 + begin
            trigger = own[cut]
            out["text"].append(np.full(len(cut), texts[i]))
            out["lo"].append(lo - begin)
            out["hi"].append(hi - begin)
            out["trig"].append(trigger - begin)
            out["core"].append(grams[trigger])
            # the place of the trigger in the phrase is part of what must agree
            place = (trigger - lo).astype(np.uint64)
            with np.errstate(over="ignore"):
                for w, k in ((0, "h1"), (1, "h2")) if whole else ():
                    h = hasher.of(sums[w], lo, hi + length, w)
                    out[k].append((h ^ (place * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9))
            begin += len(picked[i])
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


ROWS = ["_k", "lo", "hi", "trig", "core", "h1", "h2"]
ROWS_SCHEMA = "_k binary, lo long, hi long, trig long, core long, h1 long, h2 long"


def _rows(key: pa.Array, lo: np.ndarray, hi: np.ndarray, trig: np.ndarray, *hashes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key, *[pa.array(x, pa.int64()) for x in (lo, hi, trig)], *map(_signed, hashes)], names=ROWS)


def _encoded(texts: pa.Array) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") if x else b"" for x in texts.to_pylist()]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, 256) for at in range(0, batch.num_rows, 256))


def _triggers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in _slices(batch):
            p = phrases(_encoded(some.column(0)), whole=False)
            yield pa.RecordBatch.from_arrays([_signed(p["core"])], names=["core"])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in _slices(batch):
            p = phrases(_encoded(some.column(1)))
            yield _rows(some.column(0).take(pa.array(p["text"], pa.int64())), p["lo"], p["hi"], p["trig"], p["core"], p["h1"], p["h2"])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(key, text, runs) as key, hasher, sums of both hashes and the columns of the runs."""
    hasher = None
    for batch in batches:
        for some in _slices(batch):
            for key, text, runs in zip(some.column(0).to_pylist(), _encoded(some.column(1)), some.column(2).to_pylist(), strict=True):
                data = np.frombuffer(text, np.uint8)
                if hasher is None or len(data) >= len(hasher.power[0]):
                    hasher = RollingHash(max(CHUNK, len(data)))
                table = np.array([(r["lo"], r["hi"], r["trig"]) for r in runs], np.int64)
                yield key, hasher, [hasher.sums(data, w) for w in (0, 1)], table.T


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the run and value for each value from first to last of each run."""
    n = last - first + 1
    which = np.repeat(np.arange(len(n)), n)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs cut into blocks of starts, aligned by the distance to the trigger.

    The core of a block is the bytes that all its BLOCK strings hold.
    """
    for key, hasher, sums, (lo, hi, trig) in _opened(batches):
        which, q = _spread((trig - hi) // BLOCK, (trig - lo) // BLOCK)
        end = trig[which] - BLOCK * q  # last start of the whole block
        first, last = np.maximum(lo[which], end - BLOCK + 1), np.minimum(hi[which], end)
        with np.errstate(over="ignore"):
            core = hasher.of(sums[0], end, end - BLOCK + 1 + LENGTH, 0) + q.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            cut = ((end - first) * BLOCK + end - last).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
            whole = [hasher.of(sums[w], first, last + LENGTH, w) + cut for w in (0, 1)]
        yield _rows(pa.array([key] * len(q), pa.binary()), first, last, trig[which], core, *whole)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each string that starts in a run."""
    for key, hasher, sums, (lo, hi, trig) in _opened(batches):
        which, start = _spread(lo, hi)
        h = [hasher.of(sums[w], start, start + LENGTH, w) for w in (0, 1)]
        yield _rows(pa.array([key] * len(start), pa.binary()), start, start, trig[which], h[0], *h)


PHRASES_SCHEMA = "core long, _k binary, lo long, hi long, trig long, weight long, bytes binary"


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, runs) to the phrases of the runs with their bytes."""
    kind = pa.schema([("core", pa.int64()), ("_k", pa.binary()), *[(c, pa.int64()) for c in ("lo", "hi", "trig", "weight")], ("bytes", pa.binary())])
    for batch in batches:
        for some in _slices(batch):
            rows = [
                (r["core"], key, r["lo"], r["hi"], r["trig"], r["weight"], text[r["lo"] : r["hi"] + LENGTH])
                for key, text, runs in zip(some.column(0).to_pylist(), _encoded(some.column(1)), some.column(2).to_pylist(), strict=True)
                for r in runs
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)] if rows else [pa.array([], f.type) for f in kind], schema=kind)


def suffix_array(rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (bytes, filled with zeros) within their groups, and the longest common
    prefix of each with the one before it (-1 for the first of a group)."""
    keyed = np.concatenate([groups.astype(">u8").view(np.uint8).reshape(-1, 8), rows], 1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{keyed.shape[1]}").ravel(), kind="stable")
    differ = keyed[order[1:]] != keyed[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1) - 8, rows.shape[1])
    return order, np.concatenate([[-1], np.maximum(common, -1)])


def repeated_starts(groups: np.ndarray, before: list[bytes], after: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Which starts of the phrases are repeated in another phrase of their group.

    A phrase is what stands before its trigger and what follows from it. Row i, column d of the
    result is the start d bytes before the trigger of phrase i. It is placed by the class of its
    dictionary suffix (the last d bytes before the trigger) and of the parse behind it (the next
    ``length - d`` bytes), both read off the suffix arrays.
    """
    n = len(groups)
    left, right = np.array([len(x) for x in before]), np.array([len(x) for x in after])
    back, front = np.zeros((n, max(1, left.max())), np.uint8), np.zeros((n, length), np.uint8)
    for i in range(n):
        back[i, : left[i]] = np.frombuffer(before[i], np.uint8)[::-1]
        front[i, : right[i]] = np.frombuffer(after[i], np.uint8)
    suffixes, common_back = suffix_array(back, groups)
    parse, common_front = suffix_array(front, groups)
    out = np.zeros((n, left.max() + 1), bool)
    suffix_class, parse_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(left.max() + 1):
        active = np.flatnonzero((left >= d) & (right >= length - d))
        if len(active) < 2:
            continue
        suffix_class[suffixes] = np.cumsum(common_back < d)
        parse_class[parse] = np.cumsum(common_front < length - d)
        place = suffix_class[active] * (n + 1) + parse_class[active]
        order = np.argsort(place, kind="stable")
        same = place[order[1:]] == place[order[:-1]]
        out[active[order[1:][same]], d] = True
        out[active[order[:-1][same]], d] = True
    return out


def _array_marks(core: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
    lo, hi, trig, weight = (rows.column(c).to_numpy() for c in ("lo", "hi", "trig", "weight"))
    text = rows.column("bytes").to_pylist()
    cut = trig - lo
    hit = repeated_starts(core, [t[:c] for t, c in zip(text, cut, strict=True)], [t[c:] for t, c in zip(text, cut, strict=True)])
    hit[weight > 1] = False  # their strings are known to be repeated
    edges = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1] - 1
    key = rows.column("_k").combine_chunks().take(pa.array(row, pa.int64()))
    return pa.RecordBatch.from_arrays([key, pa.array(trig[row] - last, pa.int64()), pa.array(trig[row] - first, pa.int64())], names=["_k", "lo", "hi"])


def _arrayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases, sorted by core, to the repeated runs of starts; whole groups are taken together."""
    held: list[pa.RecordBatch] = []

    def ready(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        table = pa.Table.from_batches(held)
        core = table.column("core").to_numpy()
        n = len(core) if last else int(np.searchsorted(core, core[-1]))  # the last group may go on
        ends = np.flatnonzero(np.concatenate([core[1:n] != core[: n - 1], [True]])) + 1 if n else []
        lo = 0
        for i, end in enumerate(ends):
            if i + 1 == len(ends) or ends[i + 1] - lo > 2 * GROUP:
                yield _array_marks(core[lo:end], table.slice(lo, end - lo))
                lo = end
        held = table.slice(n).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= 2 * GROUP:
            yield from ready(False)
    if held:
        yield from ready(True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Take the marked runs out of the texts."""
    for batch in (some for whole in batches for some in _slices(whole)):
        size, gone, spans, kept = [], [], [], []
        for raw, runs in zip(_encoded(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            found: list[list[int]] = []
            for lo, hi in sorted((r["lo"], r["hi"] + LENGTH) for r in runs or ()):
                if found and lo <= found[-1][1]:
                    found[-1][1] = max(found[-1][1], hi)
                else:
                    found.append([lo, hi])
            ends = [0, *[x for span in found for x in span], len(raw)]
            size.append(len(raw))
            gone.append(sum(hi - lo for lo, hi in found))
            spans.append([{"start": lo, "end": hi} for lo, hi in found])
            kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["_id", "n_bytes", "n_removed", "spans", "kept"])


def repeated_runs(docs: DataFrame, id_col: str, text_col: str, group: int = GROUP) -> DataFrame:
    """Runs (lo, hi) of starts of strings that start elsewhere too, by row key ``_k``: a written table.

    Rows equal in id and text share a key and are counted one by one.
    """
    keyed = docs.select(row_key(id_col, text_col).alias("_k"), F.col(text_col).alias("_text"))
    long = keyed.filter(F.octet_length("_text") >= LENGTH)
    # a trigger alone has nothing to be compared with; only hashes move here
    cores = long.select("_text").mapInArrow(_triggers, "core long").groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    cores = materialize(cores.filter("n > 1").select("core"), "cores")
    held = materialize(long.mapInArrow(_parse, ROWS_SCHEMA).join(hinted(cores, BROADCAST_ROWS), "core"), "parse")
    release(cores)
    parse = _placed(held, "phrase")
    marks = [parse.filter("n > 1").select("_k", "lo", "hi")]
    written = [parse]

    small = _texts_of(long, parse.filter(F.col("open") & (F.col("variants") <= group)), "phrase-runs")
    spelled = small[0].mapInArrow(_spelled, PHRASES_SCHEMA).repartition("core").sortWithinPartitions("core")
    written.append(materialize(spelled.mapInArrow(_arrayed, "_k binary, lo long, hi long"), "array-marks"))
    marks.append(written[-1])
    release(small[1])

    rest = parse.filter(F.col("open") & (F.col("variants") > group))
    for cut, name in ((_blocks, "block"), (_strings, "string")):
        if not rest.limit(1).count():
            break
        texts, runs = _texts_of(long, rest, f"{name}-runs")
        rows = materialize(texts.mapInArrow(cut, ROWS_SCHEMA), f"{name}s")
        release(runs)
        # of equal phrases one was cut, so its strings count as often as the phrase occurs: those
        # that occur twice are marked already, and only have to count for the others
        placed = _placed(rows, name)
        written.append(placed)
        marks.append(placed.filter("n > 1").select("_k", "lo", "hi"))
        rest = placed.filter("open")
    runs = functools.reduce(DataFrame.unionByName, marks).groupBy("_k").agg(F.collect_set(F.struct("lo", "hi")).alias("_runs"))
    runs = materialize(runs, "runs")
    release(*written)
    return runs


def _texts_of(long: DataFrame, runs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(_k, _text, runs) of the texts with these runs, and the table of runs that it reads.

    Only these texts move; of rows equal in id and text one is enough.
    """
    runs = materialize(runs.groupBy("_k").agg(F.collect_list(F.struct("lo", "hi", "trig", F.least("n", F.lit(2)).alias("weight"), "core")).alias("runs")), name)
    texts = long.join(hinted(runs.select("_k"), BROADCAST_ROWS), "_k", "left_semi").groupBy("_k").agg(F.first("_text").alias("_text"))
    return texts.join(runs, "_k").select("_k", "_text", "runs"), runs


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """The rows with ``n``, how often their bytes occur, ``variants``, the different bytes around
    their core, and ``open``, whether to compare them more closely. ``rows`` is released.

    rows: as ROWS, of which (h1, h2) stand for all the bytes and core for those that every string
    of the run holds. Of equal runs one is compared (the one of the smallest hash of its place, as a
    minimum of numbers needs no sort), and runs alone around their core are not. Rows that need nothing are left out.
    """
    kind, place = ["core", "h1", "h2"], F.xxhash64("_k", "lo")
    dictionary = materialize(rows.groupBy(*kind).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")), f"{name}-dictionary")
    variants = dictionary.groupBy("core").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1")
    variants = materialize(variants, f"{name}-variants")
    known = dictionary.join(hinted(variants, BROADCAST_ROWS), "core", "left").filter("n > 1 or variants > 1")
    here = rows.join(known, kind).select("_k", "lo", "hi", "trig", "core", "n", F.coalesce("variants", F.lit(1)).alias("variants"), (F.col("variants").isNotNull() & (F.col("first") == place)).alias("open"))
    here = materialize(here.filter("n > 1 or open"), f"{name}-found")
    release(rows, dictionary, variants)
    return here


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte in a LENGTH-byte string that also starts anywhere else in the table.

    Returns ``id_col``, ``n_bytes`` (of the UTF-8 text; null: 0), ``n_removed``, ``spans`` (array
    of start and end of the maximal removed runs, in bytes) and ``kept`` (the other bytes, joined).
    All places of a repeat go, its first one too; overlapping places within a text count; strings
    never cross texts. A row for each row of ``docs``; repeated rows are repeats of each other.
    Texts below LENGTH bytes stay whole. An empty table gives no rows.
    """
    runs = repeated_runs(docs, id_col, text_col)
    keyed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), row_key(id_col, text_col).alias("_k"))
    if is_small(runs, BROADCAST_ROWS):  # texts without runs stay where they are
        keys = F.broadcast(runs.select("_k"))
        touched = keyed.join(keys, "_k", "left_semi").join(runs, "_k")
        whole = keyed.join(keys, "_k", "left_anti").withColumn("_runs", F.lit(None).cast(runs.schema["_runs"].dataType))
        marked = touched.unionByName(whole)
    else:
        marked = keyed.join(runs, "_k", "left")
    kind = docs.schema[id_col].dataType.simpleString()
    out = marked.select("_id", "_text", "_runs").mapInArrow(_cut, f"_id {kind}, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
    return out.withColumnRenamed("_id", id_col)


def digest(kept: bytes) -> str:
    """As the SQL function sha2 gives it; for tests."""
    return hashlib.sha256(kept).hexdigest()
