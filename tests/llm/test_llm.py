"""The dealt operators on odd tables and against brute force."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from registra.llm import ann, html_extract, lines, maxscore, mixing, neardup, packing, shards, suffix, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: helper names of the operators, to clash with
EXTRA = {"_k": "long", "_id": "string", "_text": "string", "n_bytes": "string", "sequence_id": "string", "severity": "string", "_drop": "string", "length": "string", "piece": "string", "epoch": "string", "_toxic": "string", "_scored": "string", "block": "string", "_md5": "string", "depth": "string", "class_id": "string"}


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def table(spark, rows, extra=False):
    schema = DOCS + "".join(f", {k} {v}" for k, v in EXTRA.items()) * extra
    values = [(i, t, "en", s, len(t or "")) + ((7,) + ("x",) * (len(EXTRA) - 1)) * extra for i, t, s in rows]
    return spark.createDataFrame(values, schema)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(4)
    long = prose(rng, 9000)
    same = prose(rng, 120)
    rows = [(1, None, "a"), (2, "", None), (None, same, "a"), (3, same, None), (3, same, None), (4, "x", "b"), (5, long, "a"), (6, "\n\n  \n", "b"), (None, None, None)]
    rows += [(10 + i, prose(rng, 80) + "\n" + "A common line of text here\n" + prose(rng, 60), "a") for i in range(12)]
    return rows


def test_empty_tables(spark):
    docs = table(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, labels).count() == 0
    assert packing.pack_documents(docs).count() == 0
    assert suffix.remove_repeats(docs).count() == 0
    assert lines.drop_boilerplate_lines(docs).count() == 0
    assert mixing.mix_sources(docs).count() == 0
    assert neardup.near_duplicates(docs).count() == 0
    assert neardup.keep_one(docs).count() == 0
    assert shards.extendible_shards(docs, 100).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest_neighbours(vectors, vectors, 3).count() == 0
    assert maxscore.top_inner_products(vectors, vectors, 3).count() == 0
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_packing(spark, odd):
    out = packing.pack_documents(table(spark, odd, extra=True)).collect()
    encode = packing.encoder()[0]
    want = sorted((i if i is not None else -1, len(encode(t or "")) + 1) for i, t, _ in odd)
    got = {}
    for r in out:
        assert 1 <= r.length <= 1024 and len(r.ids) == 4 * r.length
        if r.piece > 0:
            assert r.length == 1024
        got.setdefault(r.doc_id if r.doc_id is not None else -1, []).append(r.length)
    assert sum(n for _, n in want) == sum(map(sum, got.values()))
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    long = next(t for i, t, _ in odd if i == 5)
    ids = np.array([*encode(long), 2], "<u4")
    pieces = sorted((r for r in out if r.doc_id == 5), key=lambda r: r.piece)
    assert b"".join(bytes(r.ids) for r in pieces) == ids.tobytes()
    assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]]


def test_encoder_matches_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = packing.encoder()[0]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ["", " ", "a  b", "tab\tx \n\n y", "it's 123 é ß 中文  x", "end  ", "  start", "\r\n", "a  b"]:
        assert encode(t) == own.encode(t, add_special_tokens=False).ids


def test_complement_plan_places_every_piece():
    rng = random.Random(1)
    for _ in range(30):
        counts = {rng.randint(1, 1024): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
        used = {}
        for pattern, times in packing.complement_plan(counts):
            assert sum(a * k for a, k in pattern) <= 1024
            for a, k in pattern:
                used[a] = used.get(a, 0) + k * times
        assert used == counts
    # pairs and triples take part
    plan = packing.complement_plan({800: 7, 124: 7, 100: 7, 700: 4, 200: 4, 90: 4, 34: 4})
    assert sum(t for _, t in plan) == 11 and {len(p) for p, _ in plan} == {3, 4}
    exact = packing.complement_plan({600: 5, 424: 5, 500: 3, 300: 3, 224: 3})
    assert sum(t for _, t in exact) == 8


def fewest(pieces, capacity):
    """The fewest sequences that hold the pieces, by trying all ways."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for k in {rooms[j]: j for j in range(len(rooms)) if rooms[j] >= pieces[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - pieces[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


def test_packing_is_close_to_the_fewest_sequences():
    rng = random.Random(11)
    over = 0
    for _ in range(60):
        pieces = sorted((rng.randint(1, 16) for _ in range(rng.randint(1, 10))), reverse=True)
        plan = packing.complement_plan({x: pieces.count(x) for x in pieces}, 16)
        over += sum(t for _, t in plan) - fewest(pieces, 16)
    assert over <= 2


def test_toxicity(spark, odd):
    rng = random.Random(2)
    rows = [(i, prose(rng, 50) + (" vile nasty" if i % 3 == 0 else ""), "a") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(table(spark, rows + [(1000, None, "a"), (None, "", "a")], extra=True), labels).collect()
    assert len(out) == 402
    held = [r for r in out if r.doc_id is not None and 300 <= r.doc_id < 400]
    assert all(r.is_toxic == (r.doc_id % 3 == 0) for r in held)
    assert not any(r.is_toxic for r in out if not r.text)
    assert all(r._toxic == "x" and r._scored == "x" for r in out)
    none = toxicity.toxicity(table(spark, odd), labels.filter("false")).collect()
    assert len(none) == len(odd) and not any(r.is_toxic for r in none)


def test_ordinal_thresholds_are_ordered_and_shared():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(4) < 0.5) for _ in range(2000)]
    grades = np.array([min(3, len(r)) for r in rows])
    w, theta = toxicity.fit_ordinal(rows, grades, 4, rounds=600)
    assert (np.diff(theta) > 0).all() and len(theta) == 3
    model = toxicity.OrdinalModel({str(i): x for i, x in enumerate(w)}, theta.tolist())
    score = np.array([w[r].sum() for r in rows])
    assert np.corrcoef(model.above(score).sum(1), grades)[0, 1] > 0.9


def test_held_out_grades_order_what_was_not_counted(spark):
    """Severity follows a hidden grade that the labels don't hold, and scores equal a plain sum."""
    rng = random.Random(14)
    vile = [prose(rng, 1) + "vile" for _ in range(40)]
    hidden, rows = {}, []
    for i in range(1500):
        hidden[i] = rng.choice([0, 0, 0, 1, 2, 3])
        words = prose(rng, 60).split()
        for _ in range(2 * hidden[i]):
            words[rng.randrange(60)] = rng.choice(vile)
        rows.append((i, " ".join(words), "a"))
    labels = spark.createDataFrame([(i, int(hidden[i] > 0)) for i in range(1000)], "doc_id long, toxic int")
    docs = table(spark, rows)
    model = toxicity.train_toxicity(docs, labels)
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i in range(1000, 1500)]
    mean = [np.mean([out[i].severity for i in held if hidden[i] == g]) for g in range(4)]
    assert mean == sorted(mean) and mean[3] - mean[1] > 0.5
    assert np.mean([(out[i].p_toxic >= 0.5) == (hidden[i] > 0) for i in held]) > 0.95
    for i in held[:50]:  # brute force
        score = sum(model.weights.get(f, 0.0) for f in toxicity.text_features(rows[i][1]))
        above = [1 / (1 + np.exp(t - score)) for t in model.thresholds]
        assert abs(out[i].severity - sum(above)) < 1e-9


def removed(texts, n=suffix.LENGTH):
    where = {}
    for t in texts:
        for s in range(len(t) - n + 1):
            where[t[s : s + n]] = where.get(t[s : s + n], 0) + 1
    out = []
    for t in texts:
        m = np.zeros(len(t), bool)
        for s in range(len(t) - n + 1):
            if where[t[s : s + n]] > 1:
                m[s : s + n] = True
        out.append(m)
    return out


def test_repeats_against_brute_force(spark, odd):
    rng = random.Random(3)
    base = prose(rng, 300)
    rows = list(odd) + [
        (100, base, "a"), (101, prose(rng, 30) + base[200:700] + prose(rng, 30), "a"), (102, "q" * 1500, "a"), (103, "é" * 500, "a"),
        (104, base[:399], "a"), (105, base[:400], "a"), (106, "ab" * 390, "a"), (107, base[300:720] + base[310:730], "a"), (108, "z" * 400, "a"),
    ]
    out = suffix.remove_repeats(table(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    raw = [(t or "").encode() for _, t, _ in rows]
    want = sorted((len(t), int(m.sum()), int(np.diff(m.astype(int), prepend=0).clip(0).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest()) for t, m in zip(raw, removed(raw), strict=True))
    assert want == sorted((r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out)


def test_first_minima():
    rng = np.random.default_rng(1)
    for n, w in ((10, 3), (50, 7), (50, 50), (9, 1)):
        v = rng.integers(0, 4, n).astype(np.uint64) << np.uint64(40)
        assert suffix.first_minima(v, w).tolist() == [s + int(np.argmin(v[s : s + w])) for s in range(n - w + 1)]


def test_line_templates(spark, odd):
    out = {r.doc_id: r for r in lines.drop_boilerplate_lines(table(spark, odd, extra=True)).collect()}
    assert len(out) > 0
    for i in range(10, 22):
        assert out[i].n_dropped == 1 and "common line" not in out[i].text and out[i].text.count("\n") == 1
    assert out[1].text is None and out[2].text == "" and out[6].text == "\n\n  \n"


def test_line_templates_of_notices_and_variable_fields(spark):
    rng = random.Random(8)
    notice = "Licensed under the Foo licence\nYou may copy this text freely\nNo warranty"
    rows = [(i, f"{notice}\nUser {prose(rng, 1)} logged in from the main office today\n\n{prose(rng, rng.choice([0, 20, 80]))}\nEnd", "a") for i in range(40)]
    rows += [(100 + i, f"{prose(rng, 20)}\n{prose(rng, 1)} has left the room at {i}x{i} today", "a") for i in range(9)]
    for r in lines.drop_boilerplate_lines(table(spark, rows)).collect():
        own = r.text.split("\n")
        assert (own[0] == "" and len(own) == 2) if r.doc_id < 100 else (len(own) == 1 and "left the room" not in r.text)


def test_lines_of_copies_stay(spark):
    import corpus_pipeline

    rng = random.Random(9)
    foot = "Contact us by post only\nAll rights reserved\nMade in one place by us\nEnd"
    rows = [(i, f"{prose(rng, 90)}\n\nA line between two blank ones\n\n{prose(rng, 90)}\n{foot}", "a") for i in range(60)]
    base = [prose(rng, 60) for _ in range(4)]
    own = "\n".join(base)
    rows += [(100 + i, own, "a") for i in range(400)]  # exact copies
    near = [[w if rng.random() > 0.01 else prose(rng, 1) for w in line.split()] for _ in range(150) for line in base]
    near = ["\n".join(" ".join(x) for x in near[4 * i : 4 * i + 4]) for i in range(150)]
    rows += [(600 + i, t, "a") for i, t in enumerate(near)]  # near copies
    rows += [(1000, None, "a"), (None, foot, None), (1001, "", "a")]
    out = corpus_pipeline.drop_boilerplate(spark, table(spark, rows), "").collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r.text for r in out if r.doc_id is not None}
    for i, text, _ in rows:
        if i is not None and i < 60:  # a footer of four lines, short ones and one between blank lines
            x = text.split("\n")
            assert got[i] == "\n".join([x[0], "", "", x[4]])
        elif i is not None:  # copies have one vote together
            assert got[i] == text
    assert [r.text for r in out if r.doc_id is None] == [""]


def test_masks_are_linear_in_long_lines(spark):
    long = "x" * 300_000 + " 1 " + "y" * 300_000 + "7"
    out = lines.drop_boilerplate_lines(table(spark, [(i, f"{long}\n{i}", "a") for i in range(3)])).collect()
    assert [r.n_dropped for r in out] == [2, 2, 2]


def test_mixing(spark, odd):
    rng = random.Random(5)
    rows = list(odd) + [(1000 + i, prose(rng, rng.randint(1, 60)), "abcd"[min(3, int(rng.expovariate(1)))]) for i in range(900)]
    docs = table(spark, rows, extra=True)
    out = mixing.mix_sources(docs, budget=20_000, entropy_share=1.0, max_repeat=3.0).collect()
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len((t or "").split())
    a = mixing.temperature(mixing.Shares([v for v in tokens.values() if v]), 20_000, 1.0, 3.0)
    norm = sum((v / sum(tokens.values())) ** a for v in tokens.values() if v)
    for s, have in tokens.items():
        want = (have / sum(tokens.values())) ** a / norm * 20_000
        got = sum(r.n_tokens for r in out if r.source == s)
        longest = max(len((t or "").split()) for _, t, x in rows if x == s)
        assert want - longest - 1 <= got <= want + 1
        assert want <= 3 * have + 1
        for e in range(int(want // have)):
            assert sum(r.n_tokens for r in out if r.source == s and r.epoch == e) == have


def test_mixing_of_many_sources_and_impossible_budgets(spark, odd):
    rng = random.Random(15)
    rows = list(odd) + [(1000 + i, prose(rng, rng.randint(1, 60)), rng.choice("abcdefgh") * rng.randint(1, 3)) for i in range(400)]
    docs = table(spark, rows)
    few, many = (mixing.mix_sources(docs, budget=12_000, driver_sources=n).collect() for n in (10**5, 3))
    assert sorted(map(str, few)) == sorted(map(str, many)) and few
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, budget=10**9)


def test_near_duplicates_against_brute_force(spark, odd):
    rng = random.Random(6)
    rows = list(odd)
    for g in range(12):
        base = prose(rng, 200).split()
        for c in range(rng.randint(2, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = "new" + str(rng.randrange(10**6))
            rows.append((1000 + 20 * g + c, " ".join(words), "a"))
    docs = table(spark, rows, extra=True)
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    hashed = neardup.WordHash()
    sets = [neardup.weighted(neardup.shingles(hashed(t or ""))) for _, t, _ in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (len(sets[i][0]) and len(sets[j][0]) and neardup.weighted_jaccard(sets[i], sets[j]) >= 0.8):
                group[top(i)] = top(j)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(least.get(top(i), k), k)
    want = sorted((str(k), str(least.get(top(i)))) for i, (k, _, _) in enumerate(rows))
    assert want == sorted((str(r.doc_id), str(r.class_id)) for r in out)
    kept = neardup.keep_one(docs).collect()
    stay = [i for i, (k, x, _) in enumerate(rows) if any(r.doc_id == k and r.text == x for r in kept)]
    assert len({(r.doc_id, r.text) for r in kept if (r.text or "").split()}) == sum(bool((r.text or "").split()) for r in kept)
    similar = lambda i, j: rows[i][1] == rows[j][1] or (len(sets[i][0]) and len(sets[j][0]) and neardup.weighted_jaccard(sets[i], sets[j]) >= 0.8)
    for i in set(range(len(rows))) - set(stay):  # what goes is that similar to something kept
        assert any(similar(i, j) for j in stay)
    worded = [i for i in stay if len(sets[i][0])]
    close = sum(similar(i, j) for i in worded for j in worded if i < j)
    assert close <= 0.02 * len(rows)
    assert {top(i) for i in stay} == {top(i) for i in range(len(rows))}


def test_a_chain_of_drifting_texts_is_not_cut_to_its_first(spark):
    rng = random.Random(31)
    words, texts = prose(rng, 200).split(), []
    for _ in range(8):
        texts.append(" ".join(words))
        words = words[16:] + prose(rng, 16).split()
    out = neardup.keep_one(table(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    sets = [neardup.weighted(neardup.shingles(neardup.WordHash()(t))) for t in texts]
    kept = sorted(r.doc_id for r in out)
    assert 1 < len(kept) < 8
    for i in range(8):
        assert i in kept or max(neardup.weighted_jaccard(sets[i], sets[k]) for k in kept) >= 0.8


def test_signatures_lose_no_links_at_the_threshold():
    """Pairs of 0.8 to 0.85: found as candidates and not refused by the compact signatures."""
    rng = random.Random(32)
    hashed, found, refused, n = neardup.WordHash(), 0, 0, 0
    while n < 300:
        base = prose(rng, 300).split()
        other = [w if rng.random() > 0.02 else prose(rng, 1) for w in base]
        a, b = (neardup.weighted(neardup.shingles(hashed(" ".join(x)))) for x in (base, other))
        if not 0.8 <= neardup.weighted_jaccard(a, b) <= 0.85:
            continue
        x, y = neardup.dart_signature(*a), neardup.dart_signature(*b)
        same = (x == y).reshape(neardup.BANDS, neardup.ROWS).all(1)
        found += same.any()
        refused += (x >> np.uint64(40) & np.uint64(255) == y >> np.uint64(40) & np.uint64(255)).mean() < neardup.POSSIBLE
        n += 1
    assert found >= 0.99 * n and refused == 0


def test_word_hashes_do_not_depend_on_place_or_piece():
    hashed = neardup.WordHash()
    hashed.PIECE = 50
    one, two = hashed("aa bb  cc\u00a0d " * 40 + "x" * 500), neardup.WordHash()("\n" + "aa bb  cc\u00a0d " * 40 + "\t" + "x" * 500)
    assert (one == two).all() and len(one) == 121 and len(set(one.tolist())) == 4


def test_blocks_are_bounded_and_meet_all_other_components(spark):
    def deal(comps, text=None):
        rows = [(1, k, c) + ((text,) if text else ()) for k, c in enumerate(comps)] + [(2, k, k % 2) + ((text,) if text else ()) for k in range(6)]
        members = spark.createDataFrame(rows, "group long, k long, comp long" + ", _text string" * bool(text))
        return neardup._dealt(members, ["k", "comp"] + ["_text"] * bool(text)).select("group", "k", "comp", "_own", "_i", "_j", "_call").toPandas()

    stray = deal([0] * 9000 + [1])
    assert len(stray) <= 2 * 9001 + 12  # one stray member does not make the others meet each other
    for dealt in (stray, deal([k % 3 for k in range(4000)]), deal(list(range(3000)))):
        assert dealt.groupby("_call").size().max() <= 10 * neardup.CALL
        n, comp = dealt[dealt.group == 1].k.max() + 1, dealt[dealt.group == 1].drop_duplicates("k").sort_values("k").comp.to_numpy()
        met = np.zeros((n, n), bool)
        for (group, i, j), x in dealt.groupby(["group", "_i", "_j"]):
            if group == 1:
                left, right = x.k[x._own == i].to_numpy(), x.k[x._own == j].to_numpy()
                met[np.ix_(left, right)] = met[np.ix_(right, left)] = True
        assert met[comp[:, None] != comp[None, :]].all()
    long = deal([k % 3 for k in range(100)], "x" * 500_000)
    assert long.groupby("_call").size().max() * 500_000 <= 10 * neardup.CALL_BYTES


def test_dart_signatures_estimate_weighted_jaccard():
    keys = np.arange(1, 6, dtype=np.uint64) * np.uint64(1_000_003)
    a, b = np.array([3, 1.5, 2, 1, 1]), np.array([2, 1.5, 1, 1, 0.5])
    agree = [(neardup.dart_signature(keys + np.uint64(i), a) == neardup.dart_signature(keys + np.uint64(i), b)).mean() for i in range(60)]
    assert abs(np.mean(agree) - 6 / 8.5) < 0.03


def test_shards(spark, odd):
    rng = random.Random(7)
    rows = list(odd) + [(i, prose(rng, rng.randint(0, 80)), "a") for i in range(2000, 2600)] + [(9, "same text " * 20, "a")] * 50
    out = shards.extendible_shards(table(spark, rows, extra=True), 4000).collect()
    assert len(out) == len(rows)
    size, members, parents = {}, {}, {}
    for r in out:
        size[(r.shard, r.part)] = size.get((r.shard, r.part), 0) + r.n_bytes
        members[(r.shard, r.part)] = members.get((r.shard, r.part), 0) + 1
        for d in range(r.depth):
            parents[r.shard[:d]] = parents.get(r.shard[:d], 0) + r.n_bytes
    assert all(n <= 4000 or members[k] == 1 for k, n in size.items())
    assert all(n > 4000 for n in parents.values())  # only oversized buckets were split


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([Row(vec_id=int(i), embedding=None if v is None else [None if c is None else float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")


def test_nearest_neighbours_and_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 32))
    x = np.float32(centres[rng.integers(0, 10, 1500)] + rng.normal(size=(1500, 32))).astype(float)
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] * 32, [1.0, 2.0]]
    rows = vectors(spark, [*x, *odd])
    out = ann.nearest_neighbours(rows, rows.filter("vec_id % 50 = 0"), 10).toPandas()
    hits = 0
    for q, g in out.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        assert len(g) == 10 and (g.sort_values("rank")["score"].to_numpy() == d[g.sort_values("rank")["vec_id"]]).all()
        hits += len(set(np.lexsort((np.arange(len(x)), d))[:10]) & set(g.vec_id))
    assert hits >= 0.9 * len(out) and len(out) == 300
    few = vectors(spark, [[1, 0, 0], [0, 1, 0], [0, 1, 0], [-1, 0, 0]])
    assert ann.nearest_neighbours(few, few.filter("vec_id = 0"), 10).collect() == [Row(query_id=0, rank=1, vec_id=1, score=2**0.5), Row(query_id=0, rank=2, vec_id=2, score=2**0.5), Row(query_id=0, rank=3, vec_id=3, score=2.0)]



def test_nearest_neighbours_in_divided_buckets(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(10, 16))
    x = np.float32(centres[rng.integers(0, 10, 2000)] + rng.normal(size=(2000, 16))).astype(float)
    assert len(ann.level_axes(2000, 16, 4)) == 2 and ann.level_axes(2000, 16, 4096) == [16]
    # one vector many times, ids that come twice, vectors of any size
    x[:300] = x[0]
    rows = vectors(spark, [*x, *x[:60], [1e30] * 16, [1e-30] * 16], [*range(2000), *range(60), 5000, 5001])
    out = ann.nearest_neighbours(rows, rows.filter("vec_id % 50 = 0"), 10, bucket=4).toPandas()
    hits = 0
    for q, g in out.groupby("query_id"):
        if q >= 2000:
            continue
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        g = g.sort_values("rank")
        assert g.vec_id.is_unique and (g.score.to_numpy() == d[g.vec_id]).all()
        hits += (g.score <= np.sort(d)[9]).sum()
        if q < 300:
            assert g.vec_id.tolist() == [i for i in range(11) if i != q][:10]
    assert hits >= 0.9 * 400 and len(out) == 410


def test_maxscore_is_exact(spark):
    rng = np.random.default_rng(3)
    x = np.float32(rng.normal(size=(700, 24)) * (rng.random((700, 24)) < 0.4)).astype(float)
    odd = [None, [], [float("nan")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0]]
    rows = vectors(spark, [*x, *x[:20], *odd])
    y = np.floor(256 * np.concatenate([x, x[:20]])).astype(int)
    out = maxscore.top_inner_products(rows, rows.filter("vec_id % 50 = 0"), 5).toPandas()
    for q, g in out.groupby("query_id"):
        s = y @ y[q]
        s[q] = -(10**12)
        best = np.lexsort((np.arange(len(y)), -s))[:5]
        g = g.sort_values("rank")
        assert g.vec_id.tolist() == best.tolist() and g.score.tolist() == s[best].tolist()


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>menu</a></ul></nav><div class='cookie-notice'>we use cookies</div>{}<footer>foot</footer><script>var a='</p>';</script></body></html>"
    body = "<div class='story s{0}'><h1>Head &amp; {0}</h1><p>First &lt;b&gt; <b>bold</b>\n  text {1}<br><p>Second &eacute; part<ul><li>one<li>two</ul><aside>side</aside><form>f</form><div class=comments>reader says</div></div>"
    rows = [(i, "http://h.example/" + str(i), page.format(body.format(i, "word " * 40))) for i in range(6)]
    rows += [(10, None, None), (11, "", ""), (12, "x", "plain & text"), (13, "http://h.example/z", page.format("")), (0, rows[0][1], rows[0][2])]
    out = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_host", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r for r in out}
    for i in range(6):
        assert got[i].text == f"Head & {i}\nFirst <b> bold text {'word ' * 40}".rstrip() + "\nSecond é part\none\ntwo"
    assert (got[10].text, got[11].text, got[12].text, got[13].text) == ("", "", "plain & text", "")
    assert all(r.n_chars == len(r.text) for r in out)


def test_html_of_broken_and_deep_pages_is_read_in_linear_time():
    import time

    read = lambda x: html_extract.page_text(x, [])
    began = time.time()
    assert read("<script " * 20_000) == "" and read("<p>kept <script " + "<a 'b \"" * 20_000) == "kept"
    assert read("<a 'b \"" * 40_000) == "" and read("<a b=\"" * 40_000 + "x>y") in ("", "y")
    assert read("<div>" * 100_000 + "deep text" + "</span></nope></div>" * 100_000) == "deep text"
    assert len(read("".join(f"<div class='c{i}'>text {i} is here" for i in range(50_000))).split("\n")) > 1
    assert len(read("<p>" + "long word " * 500_000)) == 4_999_999
    assert read("<!--" * 50_000) == "" and read("<![CDATA[" * 50_000) == "" and read("</" * 50_000) == ""
    assert time.time() - began < 30
    assert read("<p class=it's>Hello world here") == "Hello world here"
    assert read("<p title='a > b'>Hello</p> 3 < 4 <b>bold</b>") == "Hello\n3 < 4 bold"
    whole = "The whole article stands here. " * 20
    assert read(f"<div class='search-results-article'><p>{whole}</p></div>") == whole.strip()


def test_html_consensus_against_a_plain_count(spark):
    """Winning paths on generated hosts, by counting the pages' votes in Python."""
    from collections import Counter

    rng = random.Random(21)
    rows = []
    for h in range(4):
        for i in range(9):
            main = f"<div class='m{'abcd'[h]}'><p>{prose(rng, 40)}</p></div>"
            side = f"<div class='x{'abcd'[h]}'><p>{prose(rng, 60 if i == 0 else 5)}</p></div>"
            rows.append((10 * h + i, f"https://u:p@Host{h}.example:80/p{i}", f"<body>{side}{main}</body>"))
    out = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for h in range(4):
        own = [r for r in rows if r[0] // 10 == h]
        votes = Counter(html_extract.page_votes(r[2])[0] for r in own)
        score = Counter()
        for r in own:
            path, worth = html_extract.page_votes(r[2])
            score[path] += worth
        paths = sorted((p for p, n in votes.items() if n >= 0.1 * len(own)), key=lambda p: (votes[p], score[p], p), reverse=True)
        for r in own:
            assert out[r[0]] == html_extract.page_text(r[2], paths)
            assert out[r[0]] == r[2].split("</p>")[1].split("<p>")[1]  # page 0 follows the others


def test_crc_matches_query(spark):
    from pyspark.sql import functions as F

    r = packing.pack_documents(table(spark, [(1, "hello there", "a")])).select("ids", F.crc32("ids").alias("c")).first()
    assert r.c == zlib.crc32(bytes(r.ids))


def test_repeats_of_large_groups_are_counted_like_small_ones(spark, monkeypatch):
    rng = random.Random(12)
    base = prose(rng, 160)
    texts = []
    for _ in range(60):  # a family of copies with edits, and a shared passage in other texts
        words = base.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        texts.append(" ".join(words))
    texts += [prose(rng, 40) + " " + base[100:620] + " " + prose(rng, 40) for _ in range(30)] + ["a\0b" * 300, "a\0b" * 200]
    docs = table(spark, [(i, t, "a") for i, t in enumerate(texts)])
    want = [int(m.sum()) for m in removed([t.encode() for t in texts])]
    assert sum(want) and [r.n_removed for r in suffix.remove_repeats(docs).orderBy("doc_id").collect()] == want
    by_count = suffix.repeated_runs(docs, "doc_id", "text", group=1).select("_k", "_runs.lo", "_runs.hi").collect()
    by_array = suffix.repeated_runs(docs, "doc_id", "text").select("_k", "_runs.lo", "_runs.hi").collect()

    def starts(rows):
        return {(bytes(r._k), s) for r in rows for lo, hi in zip(r.lo, r.hi, strict=True) for s in range(lo, hi + 1)}

    assert starts(by_count) == starts(by_array)


def test_suffix_array_orders_rows_and_gives_common_prefixes():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 2, (200, 12)).astype(np.uint8)
    groups = rng.integers(0, 3, 200)
    order, common = suffix.suffix_array(rows, groups)
    listed = [(groups[i], bytes(rows[i])) for i in order]
    assert listed == sorted(listed)
    for a, b, n in zip(listed, listed[1:], common[1:], strict=False):
        want = -1 if a[0] != b[0] else next((k for k in range(12) if a[1][k] != b[1][k]), 12)
        assert n == want


def test_long_texts_are_keyed_once_and_not_once_a_line(spark):
    rng = random.Random(12)
    foot = "All rights reserved by the makers"
    long = "\n".join([f"{prose(rng, 1)} {rng.getrandbits(160):040x} {i}" if i % 2 else f"{prose(rng, 8)}" for i in range(40_000)])
    docs = table(spark, [(1, f"{long}\n{foot}", "a"), (2, f"{prose(rng, 30)}\n{foot}", "a"), (3, f"{prose(rng, 40)}\n{foot}", "a")])
    began = time.perf_counter()
    got = {r.doc_id: r for r in lines.drop_boilerplate_lines(docs).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].n_lines == 40_001 and got[1].n_dropped >= 1 and got[2].n_dropped == got[3].n_dropped == 1


def test_masked_lines_and_sketch_unions_are_not_made_again_by_filters(spark, monkeypatch):
    plans, write = {}, lines.materialize

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(lines, "materialize", noted)
    rng = random.Random(21)
    rows = [(i, f"{prose(rng, 30)}\nuser {i} sent the file to the office {i}", "a") for i in range(6)]
    got = lines.drop_boilerplate_lines(table(spark, rows)).collect()
    assert [r.n_dropped for r in got] == [1] * 6
    assert plans["lines"].count("<*>") == plans["line-tokens"].count("<*>") == 1
    assert plans["lines"].count("md5(") == plans["line-tokens"].count("md5(") == 1
    assert "array_sort" not in plans["copies"]
