"""The corpus pipeline, stage by stage, on odd and empty tables."""

import random
from collections import Counter

import corpus_pipeline
from registra.llm import neardup, packing, toxicity

from .test_llm import prose, table

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def written(spark, path, rows, labels):
    table(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_against_plain_versions(spark, tmp_path):
    rng = random.Random(41)
    vile = [prose(rng, 1) + "vile" for _ in range(10)]
    foot = "All rights reserved\nMade in one place"
    rows = []
    for i in range(240):
        words = prose(rng, rng.randint(60, 90)).split()
        if i % 4 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(vile)
        rows.append((i, " ".join(words) + "\n" + foot, "abc"[i % 3]))
    base = prose(rng, 200)
    rows += [(300 + i, base, "a") for i in range(5)] + [(310, base.replace(" ", "  ", 3), "a"), (320, base + " more words", "b")]
    rows += [(400, None, None), (401, "", "a"), (None, "without an id", "a"), (402, prose(rng, 4000), "c"), (403, "x", "a"), (403, "x", "a")]
    sf = written(spark, tmp_path, rows, [(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    results = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        results.append(docs)
        if name != "packing":
            assert docs.columns == DOCUMENTS
    clean, lined, single, mixed, packed = [r.collect() for r in results]

    key = lambda r: (r.doc_id, r.text)
    every = Counter((i, t) for i, t, _ in rows)
    scored = toxicity.toxicity(table(spark, rows), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert Counter(map(key, clean)) == Counter(key(r) for r in scored if not r.is_toxic)
    gone = every - Counter(map(key, clean))
    assert sum(i is not None and i < 240 and i % 4 == 0 for i, _ in gone) >= 0.95 * 60 and sum(gone.values()) <= 62

    # the footer of all documents goes, all else stays
    want = Counter((i, None if t is None else t.replace("\n" + foot, "")) for i, t in (key(r) for r in clean))
    assert Counter(map(key, lined)) == want and all(r.n_chars == len(r.text) for r in lined if r.text)

    hashed = neardup.WordHash()
    sets = {t: neardup.weighted(neardup.shingles(hashed(t))) for t in {r.text for r in lined if r.text}}
    kept = {r.text for r in single if r.text}
    for t in sets:  # what went resembles a kept text, and kept texts don't resemble each other
        near = [k for k in kept if neardup.weighted_jaccard(sets[t], sets[k]) >= 0.8]
        assert near and (t not in kept or near == [t])
    assert len([r for r in single if r.text == base or (r.text or "").startswith(base[:50])]) == 1
    assert sum(not r.text for r in single) == sum(not r.text for r in lined)

    times = Counter(map(key, mixed))
    assert set(times) <= set(map(key, single)) and max(times.values()) <= 2
    encode = packing.encoder()[0]
    tokens = Counter()
    for i, t in map(key, mixed):
        tokens[i] += len(encode(t or "")) + 1
    placed, room = Counter(), {}
    for r in packed:
        placed[r.doc_id] += r.length
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert placed == tokens
    for places in room.values():
        ends = [0, *[a + n for a, n in sorted(places)]]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 1024


def test_pipeline_of_an_empty_table(spark, tmp_path):
    sf = written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf).count() == 0
