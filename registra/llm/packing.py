"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Texts are tokenised and cut on the executors. Only the histogram of piece lengths, at most
``capacity`` numbers, goes to the driver. There combinations of one, two or three further lengths
that fill a sequence exactly are looked up by their sums and consumed as often as their counts
allow; what is left is placed best-fit, longest first. The plan is a list of patterns with multiplicities, bounded
by the number of lengths and not by the data, and pieces find their place in it by their rank among
the pieces of their length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import hinted, materialize

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
BROADCAST_ROWS = 200_000

_double_space = re.compile(r"\s\s")


def added_tokens(path: str) -> tuple[str, ...]:
    """Texts of the tokens that a tokenizer file adds to its vocabulary."""
    from tokenizers import Tokenizer

    return tuple(t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values())


def encoder(name: str = TOKENIZER, added: tuple[str, ...] | None = None) -> tuple[Callable[[str], list[int]], str]:
    """Function from text to the ids that ``tokenizers`` gives, and the numpy type that holds them.

    ``name`` is a file of public_tokenizers or a path. For a byte-level BPE that is also there as
    ``.tiktoken`` ranks the same ids are found through those, which is faster. Its pattern has a
    look-ahead that matters only where two white-space characters meet; texts without such a place
    take the same pattern without it. Texts that hold an added token of the file, which has an id of
    its own, go to ``tokenizers`` itself; ``added`` spares reading the file for them.
    """
    import base64
    import functools
    import os

    import public_tokenizers

    path = name if os.path.exists(name) else public_tokenizers.path(name)

    @functools.cache
    def own():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    exact = lambda text: own().encode(text, add_special_tokens=False).ids
    ranks_path = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks_path):
        return exact, "<u2" if own().get_vocab_size() < 65_536 else "<u4"
    import tiktoken

    added = added_tokens(path) if added is None else added
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = public_tokenizers.PATTERN
    plain = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    quick = tiktoken.Encoding("quick", pat_str=pattern.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={})
    slow, fast, search = plain.encode_ordinary, quick.encode_ordinary, _double_space.search

    def encode(text: str) -> list[int]:
        if any(token in text for token in added):
            return exact(text)
        return (slow if search(text) else fast)(text)

    return encode, "<u2" if len(ranks) + len(added) < 65_536 else "<u4"


def _pieces(tokenizer: str, added: tuple[str, ...], capacity: int, end_id: int, schema: pa.Schema):
    """Function for mapInArrow: documents to pieces with their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = encoder(tokenizer, added)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows, piece, start, length, ids, idx = [], [], [], [], [], []
                for i, text in enumerate(some.column(1).to_pylist()):
                    found = encode(text or "")
                    found.append(end_id)
                    raw = np.array(found, kind)
                    first = (len(raw) - 1) % capacity + 1
                    for k, lo in enumerate([0, *range(first, len(raw), capacity)]):
                        own = raw[lo : first if k == 0 else lo + capacity]
                        rows.append(i)
                        piece.append(k)
                        start.append(lo)
                        length.append(len(own))
                        ids.append(own.tobytes())
                        idx.append(seen[len(own)])
                        seen[len(own)] += 1
                columns = [some.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, (piece, start, length, ids, [part] * len(rows), idx))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return cut


#: Shortest piece, as a share of the capacity, that pairs and triples may complete. A combination
#: spends short pieces, which longer ones without a complement need; the longer a piece, the less it
#: spends. All are tried, the largest choice of combinations first.
SHARES = (0.0, 0.5, 0.625, 0.75, 0.875, 0.9375)

Pattern = tuple[list[tuple[int, int]], int]


def complement_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns ``([(length, times), ...], sequences)`` that place every piece once.

    Exact complements of a single length come first, then those of two and of three lengths, then
    best fit. Of the plans for each of SHARES the one with the fewest sequences is kept, in a tie
    the one with the most combinations.
    """
    plans = [_plan(counts, capacity, int(share * capacity)) for share in SHARES]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


class Sums:
    """Available pairs of lengths by their sum, and triples found through them.

    The pairs of a sum are listed when it is first asked for, most available last. Counts only
    fall, so a pair that has run out is dropped for good.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.pairs: dict[int, list[tuple[int, int]]] = {}

    def free(self, *lengths: int) -> bool:
        return all(self.left[x] >= lengths.count(x) for x in lengths)

    def single(self, start: int, total: int) -> tuple[int, ...]:
        return (total,) if self.free(start, total) else ()

    def pair(self, start: int, total: int, *others: int) -> tuple[int, ...]:
        """Two lengths of this sum that are there beside the piece and the others."""
        if total not in self.pairs:
            small = np.arange(1, total // 2 + 1)
            small = small[(self.left[small] > 0) & (self.left[total - small] > 0)]
            most = np.minimum(self.left[small], self.left[total - small])
            self.pairs[total] = [(int(total - x), int(x)) for x in small[np.argsort(most, kind="stable")]]
        listed = self.pairs[total]
        while listed and not self.free(*listed[-1]):
            listed.pop()
        return next((p for p in reversed(listed) if self.free(start, *others, *p)), ())

    def triple(self, start: int, total: int) -> tuple[int, ...]:
        for x in np.flatnonzero(self.left[: max(total - 1, 0)])[::-1].tolist():
            found = self.pair(start, total - x, x)
            if found:
                return (x, *found)
        return ()


def _plan(counts: dict[int, int], capacity: int, shortest: int) -> list[Pattern]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[Pattern] = []
    if left[capacity]:
        plan.append(([(capacity, 1)], int(left[capacity])))
        left[capacity] = 0
    sums = Sums(left)
    for find, least in ((sums.single, 1), (sums.pair, shortest), (sums.triple, shortest)):
        for length in range(capacity - 1, max(least, 1) - 1, -1):
            while left[length] > 0 and (found := find(length, capacity - length)):
                uses = {x: (length, *found).count(x) for x in (length, *found)}
                times = min(int(left[x]) // k for x, k in uses.items())
                plan.append((list(uses.items()), times))
                for x, k in uses.items():
                    left[x] -= k * times
    residual = {length: int(left[length]) for length in np.flatnonzero(left)[::-1].tolist()}
    # best fit: open sequences by the room they have
    room: dict[int, list[list]] = {}
    for length, n in residual.items():  # longest first
        while n:
            fit = next((g for g in range(length, capacity) if room.get(g)), None)
            if fit is None:
                per = capacity // length
                full, rest = divmod(n, per)
                for k, times in ((per, full), (rest, 1)):
                    if k and times:
                        room.setdefault(capacity - k * length, []).append([[(length, k)], times])
                n = 0
                continue
            pattern, times = room[fit].pop()
            used = min(n, times)
            if used < times:
                room[fit].append([pattern, times - used])
            room.setdefault(fit - length, []).append([[*pattern, (length, 1)], used])
            n -= used
    plan += [(pattern, times) for groups in room.values() for pattern, times in groups]
    return plan


def _segments(plan: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """For each length and run of ranks: the first rank, sequence, offset and pieces a sequence."""
    rows, taken, base = [], {}, 0
    for pattern, times in plan:
        at = 0
        for length, per in pattern:
            first = taken.get(length, 0)
            rows.append((length << 40 | first, first, base, at, per))
            taken[length] = first + per * times
            at += per * length
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {k: table[:, i].copy() for i, k in enumerate(("key", "first", "base", "at", "per"))}


def _place(segments: dict[str, np.ndarray], kind: str, schema: pa.Schema):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            s = np.searchsorted(segments["key"], length << 40 | rank, "right") - 1
            within, per = rank - segments["first"][s], segments["per"][s]
            ids = batch.column("ids")
            if kind != "<u4":
                ids = pa.array([np.frombuffer(x.as_buffer(), kind).astype("<u4").tobytes() for x in ids], pa.binary())
            own = {"ids": ids, "sequence_id": segments["base"][s] + within // per, "offset": segments["at"][s] + within % per * length}
            yield pa.RecordBatch.from_arrays([pa.array(own[f.name]) if f.name in own else batch.column(f.name) for f in schema], schema=schema)

    return place


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pack all of ``docs`` into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: ``id_col``, ``piece`` (from 0), ``start`` (ids of its document
    before it), ``length``, ``ids`` (unsigned little-endian 32-bit ids), ``sequence_id`` and
    ``offset`` (its place in the sequence, gapless from 0). Each text gets ``end_id`` after its
    ids. A text of more than ``capacity`` ids is cut so that all pieces but the first are full. A
    null or empty text is the end id alone. Null ids and repeated rows are packed like any others.
    An empty table gives no rows. Sequence ids run from 0 without gaps.
    """
    import os

    import public_tokenizers

    added = () if not tokenizer.endswith(".json") else added_tokens(tokenizer if os.path.exists(tokenizer) else public_tokenizers.path(tokenizer))
    kind = encoder(tokenizer, added)[1]
    id_field = docs.schema[id_col]
    long = T.LongType()
    made = T.StructType(
        [T.StructField(id_col, id_field.dataType)]
        + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", long), ("length", long), ("ids", T.BinaryType()), ("_part", long), ("_idx", long))]
    )
    to_arrow = {"piece": pa.int32(), "ids": pa.binary()}
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([pa.field(id_col, to_arrow_type(id_field.dataType)), *[pa.field(f.name, to_arrow.get(f.name, pa.int64())) for f in made[1:]]])
    pieces = materialize(docs.select(id_col, text_col).mapInArrow(_pieces(tokenizer, added, capacity, end_id, arrow), made), "pieces")
    counts = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    segments = _segments(complement_plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = hinted(counts.withColumn("_n", F.sum("_n").over(before) - F.col("_n")), BROADCAST_ROWS)
    ranked = pieces.join(offsets, ["_part", "length"]).withColumn("_rank", F.col("_n") + F.col("_idx"))
    out = T.StructType([*made.fields[:5], T.StructField("sequence_id", long), T.StructField("offset", long)])
    arrow_out = pa.schema([*list(arrow)[:5], pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])
    return ranked.select(*[f.name for f in made.fields[:5]], "_rank").mapInArrow(_place(segments, kind, arrow_out), out)
