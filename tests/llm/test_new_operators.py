"""Periodic runs, decontamination and the manifest on odd tables and against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from registra.llm import decontaminate, html_extract, manifest, maxscore, mixing, neardup, runs

from .test_llm import odd, prose, table  # noqa: F401

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_runs(words):
    """Compare at every lag; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def patterned(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        letters = rng.choice([1, 2, 3, 50])
        unit = [rng.randrange(letters) for _ in range(rng.randint(1, 70))]
        if rng.random() < 0.3:
            unit = unit * rng.randint(1, 4) + unit[: rng.randint(0, len(unit))]
        out += (unit * 9)[: rng.randint(1, len(unit) * 8)] if rng.random() < 0.6 else unit
    return out


@pytest.mark.parametrize("direct", [1, 3, 24])
def test_runs_against_every_lag(direct):
    rng = random.Random(direct)
    for _ in range(60):
        texts = [patterned(rng) for _ in range(rng.randint(0, 5))]
        got = runs.runs_of([np.array(t, np.int64) for t in texts], direct)
        for text, rows in zip(texts, got, strict=True):
            assert sorted(map(tuple, rows.tolist())) == brute_runs(text)
            assert [tuple(r) for r in rows.tolist()] == sorted(map(tuple, rows.tolist()), key=lambda r: (r[0], r[2]))


def test_scales_leave_no_period_out():
    at = runs.DIRECT
    for a, b in runs.scales(100_000):
        assert a == at and b > a and 4 * (a + 1) - 2 * b + 2 >= a + 2
        at = b
    assert at >= 25_000


def expected_runs(doc_id, text):
    words = WORD.findall((text or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    spelled = "".join(f"{s},{k},{q}\n" for s, k, q in sorted(found, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_runs_of_documents(spark, odd):  # noqa: F811
    rng = random.Random(5)
    extra = [(100 + i, prose(rng, rng.randint(1, 60)), "a") for i in range(60)]
    extra += [(200, "a b " * 9, "b"), (201, "x y x y\x1cz " * 5, "b"), (202, "w\t\n" * 7, "b"), (203, "ha " * 5, "b"), (204, "q\x0b" * 6, None)]
    rows = [r for r in odd if len(r[1] or "") < 5000] + extra
    got = runs.summary(runs.periodic_runs(runs.planted(table(spark, rows, extra=True))))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert got.columns == columns
    assert rows_of(got, *columns) == sorted((expected_runs(i, t) for i, t, _ in rows), key=repr)
    assert runs.periodic_runs(table(spark, [])).count() == 0


def test_runs_in_small_batches(monkeypatch):
    monkeypatch.setattr(runs, "BATCH_WORDS", 20)
    texts = ["a " * 9, "a", None, "", "a b " * 6, "c " * 90, "d"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["_id", "_text"])
    got = [r for some in runs._runs(iter([batch])) for r in some.to_pylist()]
    assert [r["_id"] for r in got] == list(range(7))
    assert [[tuple(x.values()) for x in r["runs"]] for r in got] == [[(0, 9, 1)], [], [], [], [(0, 12, 2)], [(0, 90, 1)], []]
    assert [r["collapsed"] for r in got] == ["a", "a", "", "", "a b", "c", "d"]


def brute_contamination(docs, items):
    out = []
    for doc_id, text in docs:
        words = PLAIN.findall(lowered(text))
        hit, named = set(), set()
        for item, passage in items:
            ws = PLAIN.findall(lowered(passage))
            for at in range(max(1, len(ws) - 9) if ws else 0):
                window = ws[at : at + 10]
                for i in range(len(words) - len(window) + 1):
                    if words[i : i + len(window)] == window:
                        hit |= set(range(i, i + len(window)))
                        named |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(named), digest, bool(hit)))
    return sorted(out, key=repr)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


SUMMARY = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 3))) for _ in range(12)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, text(rng.choice([3, 9, 10, 11, 25]))) for i in range(12)]
    items += [(3, items[5][1]), (50, items[2][1]), (None, text(12)), (60, None), (61, " .,; "), (62, items[3][1].upper())]
    docs = []
    for i in range(40):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            planted = rng.choice(items)[1] or ""
            parts += [planted[rng.randint(0, 5) :], rng.choice([",", "Q", "\n", "zz yy"]), text(rng.randint(0, 5))]
        docs.append((i, " ".join(parts)))
    docs += [(None, items[0][1]), (7, None), (8, ""), (9, items[1][1]), (9, items[1][1]), (70, (items[4][1] + " ") * 300)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_contamination(spark, leaky, block_bytes):
    docs, items = leaky
    frame = table(spark, [(i, t, None) for i, t in docs], extra=True)
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    found = decontaminate.contamination(frame, bench, block_bytes=block_bytes).cache()
    assert rows_of(decontaminate.summary(found), *SUMMARY) == brute_contamination(docs, items)
    texts = dict(docs)
    repeated = {i for i, _ in docs if sum(j == i for j, _ in docs) > 1}
    for r in found.filter(~F.coalesce("doc_id", F.lit(-1)).isin(repeated)).collect():
        raw = (texts[r.doc_id] or "").encode()
        words = PLAIN.findall(lowered(texts[r.doc_id]))
        for s in r.spans:
            assert PLAIN.findall(lowered(raw[s.first_byte : s.end_byte].decode())) == words[s.start : s.end]
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_contamination_without_rows(spark, leaky):
    docs, items = leaky
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(table(spark, []), bench).count() == 0
    frame = table(spark, [(i, t, None) for i, t in docs])
    clean = decontaminate.contamination(frame, bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.spans or r["items"] for r in clean)


def test_one_word_items(spark):
    bench = spark.createDataFrame([("x", "Zebra"), ("y", "one two")], "item_id string, text string")
    frame = table(spark, [(1, "a zebra, zebra one", None), (2, "two one TWO", None), (3, "zebras", None)])
    got = {r.doc_id: ([(s.start, s.end) for s in r.spans], r["items"]) for r in decontaminate.contamination(frame, bench).collect()}
    assert got == {1: ([(1, 3)], ["x"]), 2: ([(1, 3)], ["y"]), 3: ([], [])}


def test_index_against_plain_search():
    rng = np.random.default_rng(3)
    for letters in (1, 2, 5, 40):
        parts = [rng.integers(1, letters + 1, rng.integers(1, 60)) for _ in range(8)]
        parts += [parts[0], parts[0]]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int32)
        order = decontaminate.suffix_order(text)
        stops = np.cumsum(text == 0)
        plain = sorted(range(len(text)), key=lambda i: [(int(x), 0) if x else (0, int(s)) for x, s in zip(text[i : i + 70], stops[i : i + 70], strict=True)])
        assert [x for x in order.tolist() if text[x]] == [x for x in plain if text[x]]
        index = decontaminate.FMIndex(text, sample=3)
        windows = np.zeros((50, 4), np.int32)
        lengths = rng.integers(1, 5, 50)
        for i, n in enumerate(lengths):
            windows[i, :n] = rng.integers(1, letters + 2, n)
        which, lo, hi = index.search(windows, lengths)
        for i, (row, n) in enumerate(zip(windows, lengths, strict=True)):
            want = [p for p in range(len(text) - n + 1) if (text[p : p + n] == row[:n][::-1]).all()]
            at = np.flatnonzero(which == i)
            got = sorted(index.locate(np.arange(lo[at[0]], hi[at[0]])).tolist()) if len(at) else []
            assert got == want


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def spelled(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def merkle(leaves):
    """Root and the siblings of every leaf, left and right of it."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            other = nodes[i ^ 1] if i ^ 1 < len(nodes) else ""
            path.append((other, "") if i & 1 else ("", other))
        at = [i // 2 for i in at]
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    none_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, sha(*map(spelled, r))))
    tops, below = [], {}
    for lang in sorted(groups, key=none_first):
        groups[lang].sort(key=lambda x: (none_first(x[0][0]), x[1]))
        root, below[lang] = merkle([leaf for _, leaf in groups[lang]])
        tops.append(root)
    root, above = merkle(tops)
    out = []
    for top, way, lang in zip(tops, above, sorted(groups, key=none_first), strict=True):
        for (r, leaf), path in zip(groups[lang], below[lang], strict=True):
            seen = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                seen = sha(*map(spelled, (*r[:3], r[3] + 1, r[4])))
            for left, right in [*path, *way]:
                seen = sha(left, seen, right)
            proof = sha(*[a + b for a, b in [*path, *way]])
            out.append((r[0], leaf, top, root, proof, seen, seen == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, "": 1}, {"en": 75, "de": 16, "é": 17, None: 33, "z": 1}])
def test_manifest(spark, sizes):
    rng = random.Random(6)
    rows = []
    for lang, n in sizes.items():
        rows += [(rng.randint(0, 10_000), rng.choice(["a", None, ""]), lang, rng.choice([None, 5, 12]), rng.choice(["é x", "", None, "long " * 3000])) for _ in range(n)]
    if len(rows) > 9:
        rows += [rows[3], rows[3], (None, "s", "en", 1, "t"), (None, None, "en", None, None), (rows[0][0], "other", rows[0][2], 1, "tie")]
    frame = spark.createDataFrame([(i, t, g, s, n, "x", "y", 1) for i, s, g, n, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _g string, path string, _pos int")
    got = manifest.document_manifest(frame, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    assert rows_of(got, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest.document_manifest(table(spark, []), F.lit(True)).count() == 0


def test_named_parts_by_consensus(spark):
    """A part named like a notice or a menu is an article only where its text differs and nothing else is there."""
    rng = random.Random(2)
    long, short = prose(rng, 150), prose(rng, 40)
    rows = [("http://one.example/a", f"<div class='share-price'><p>{short}</p></div>", short), ("http://two.example/a", f"<div class='share-price'><p>{long}</p></div>", long)]
    rows += [("http://three.example/a", f"<div class='search-results-article'>{short}</div>", short), ("http://four.example/", f"<div class=notice>{short}</div><nav>menu</nav>", short)]
    rows += [("http://five.example/a", f"<div id='reply-to-critics'>{short}</div><p>x</p>", short)]
    for i in range(8):  # each with a text of its own under such a name
        own = prose(rng, 30)
        rows.append((f"http://six.example/{i}", f"<div class='related'><p>{own}</p></div><footer>foot</footer>", own))
        # the same notice on every page, two of which have nothing else
        body = f"<div class=story><p>{own}</p></div>" if i > 1 else ""
        rows.append((f"http://seven.example/{i}", f"<div class='cookie-notice'>{short}</div>{body}", own if i > 1 else ""))
        # comments are longer than the article and differ from page to page
        rows.append((f"http://eight.example/{i}", f"<article><p>{own}</p></article><div class=comments>{prose(rng, 120)}</div>", own))
    frame = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_main_text(frame).collect()}
    assert [got[i] for i in range(len(rows))] == [r[2] for r in rows]


def test_boilerplate_of_marked_pages(spark):
    """Hand-marked pages: what belongs to the article is in capitals, all else is not."""
    parts = ["<nav><a href=/>home</a></nav>", "<div class='sidebar'>latest news</div>", "<div class='cookie-banner'>we use cookies</div>", "<section id='comments'><p>first!</p></section>", "<form>mail <input></form>", "<footer>imprint</footer>", "<div class='ad'>buy now</div>", "<header><h1>site</h1></header>"]
    rng = random.Random(4)
    rows = []
    for i in range(24):
        around = rng.sample(parts, 5)
        text = [prose(rng, rng.randint(8, 60)).upper() for _ in range(rng.randint(1, 4))]
        body = "".join(f"<p>{t}</p>" for t in text)
        body = f"<div class='c{i % 3} post-body'>{body}</div>" if i % 2 else f"<main><article><h2>T{i}</h2>{body}</article></main>"
        rows.append((i, f"https://h{i % 4}.example/{i}", "<body>" + "".join(around[:2]) + body + "".join(around[2:]) + "</body>", "\n".join(([] if i % 2 else [f"T{i}"]) + text)))
    got = html_extract.extract_main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {r[0]: r[3] for r in rows}


def test_large_components_raise(spark):
    rows = spark.createDataFrame([(0, [1e30, 1.0]), (50, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        maxscore.top_inner_products(rows, rows, 5).collect()
    rows = spark.createDataFrame([(0, [5e6, 6e6]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert {r.score for r in maxscore.top_inner_products(rows, rows, 5).collect()} == {256 * 256 * 17_000_000}


def test_similarity_to_the_first_text_of_a_class(spark):
    rng = random.Random(9)
    words = prose(rng, 120).split()
    rows = []
    for i in range(8):  # each differs a little from the one before it
        rows.append((10 + i, " ".join(words), "a"))
        words[12 * i + 6] = f"new{i}"
    rows += [(30, rows[0][1], "a"), (31, None, "a"), (32, "", "a")]
    got = {r.doc_id: r for r in neardup.near_duplicates(table(spark, rows)).collect()}
    hashed = neardup.WordHash()
    sets = {i: neardup.weighted(neardup.shingles(hashed(t or ""))) for i, t, _ in rows}
    for i in range(10, 18):
        assert got[i].class_id == 10 and got[i].similarity == pytest.approx(neardup.weighted_jaccard(sets[10], sets[i]))
    assert got[30].class_id == 10 and got[30].similarity == 1.0 and got[17].similarity < 0.8
    assert got[31].class_id == got[32].class_id == 31 and got[32].similarity == 1.0


def test_carried_columns_keep_their_names(spark):
    docs = table(spark, [(1, "a b c", "x"), (2, "d e", "y")], extra=True)
    for clash in (("block",), ("text", "text"), ("doc_id",)):
        with pytest.raises(ValueError, match="clash"):
            mixing.mix_sources(docs, carry=clash)
    assert mixing.mix_sources(docs, carry=("text", "depth")).columns.count("text") == 1
