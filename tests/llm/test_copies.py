import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_simhash import brute_components, brute_fp

from lodestack.llm import copies


def brute(docs):
    """The smallest id linked by 4 bits of SimHash or by a Jaccard similarity of 0.8, over all pairs."""
    ids, texts = zip(*docs, strict=True)
    fps, part = [brute_fp(t) for t in texts], {i: i for i in ids}
    sets = [{tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, c in zip(ids, brute_components(list(ids), fps), strict=True):
        part[i] = c
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(ids[i]), find(ids[j])))
                part[b] = a
    return {i: find(i) for i in ids}


def test_edited_copies_beyond_the_ball_go(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    docs = []
    for k in range(30):
        base = rng.choices(vocabulary, k=300)
        for edits in (0, 3, 5, 6, 6, 9, 20):
            words = list(base)
            for p in rng.sample(range(300), edits):
                words[p] = "edited"
            docs.append((len(docs), " ".join(words)))
    want = brute(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in copies.near_copies(frame).collect()} == want
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, "").collect()}
    assert kept == {i for i, c in want.items() if i == c} and len(kept) < 90


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(4)
    for size in (1, 5, 40, 300, 5000):
        for edits in (0, 1, 3, 30):
            a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            b = np.unique(np.concatenate([a[edits:], rng.integers(0, 1 << 63, edits, np.uint64)]))
            bits = int(np.bitwise_count((copies.sketch(a) ^ copies.sketch(b)).view(np.uint64)).sum())
            assert bits <= len(np.setxor1d(a, b)) and (edits or bits == 0)


def test_a_large_group_of_edited_copies(spark):
    """Siblings around the similarity, nulls, wordless and repeated texts: components are those of all pairs, and few pairs leave the joins."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for _ in range(150):
        words = list(base)
        for p in rng.sample(range(150), rng.randint(2, 8)):
            words[p] = f"e{rng.randint(0, 10**6)}"
        docs.append((len(docs), " ".join(words)))
    docs += [(200, docs[0][1]), (201, ""), (202, " ")]
    frame = spark.createDataFrame([*docs, (203, None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in copies.near_copies(frame).collect()}
    want = brute([(i, x) for i, x in docs if x.strip()])
    assert {i: got[i] for i in want} == want and got[201] == got[202] == got[203] == 201


def test_recall_on_all_documents(spark):
    """Every pair of sf0.1 at a similarity of 0.8 or more, by rare shingles (no pair can be missed), against what the bands join."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    sets = {i: set(copies.shingles(np.array([hash(w) & (1 << 63) - 1 for w in (t or "").lower().split()], np.uint64)).tolist()) for i, t in texts.items()}
    often = {}
    for own in sets.values():
        for x in own:
            often[x] = often.get(x, 0) + 1
    rarest = {i: sorted(own, key=lambda x: (often[x], x))[: len(own) - -(-4 * len(own) // 5) + 1] for i, own in sets.items()}
    holders = {}
    for i, own in rarest.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for group in holders.values() if len(group) > 1 for a in group for b in group if a < b and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))}
    near = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    part = {r.doc_id: r.component_id for r in copies.near_copies(docs).collect()}
    joined = sum(part[a] == part[b] for a, b in near)
    edited = [(a, b) for a, b in near if sets[a] != sets[b]]
    print(f"recall {joined} of {len(near)} pairs, {sum(part[a] == part[b] for a, b in edited)} of {len(edited)} edited ones")
    assert len(edited) > 100 and joined >= 0.99 * len(near)


def test_a_large_bucket_is_dealt_in_blocks(spark, monkeypatch):
    """Texts that share a bucket but are no copies: every pair meets once, whatever the blocks."""
    rows = [(k, f"t{i}", 9 + i % 3, i) for k, n in ((1, 90), (2, 7), (3, 1)) for i in range(n)]
    bucket = spark.createDataFrame(rows, "key long, t string, n long, root long")
    for block in (500, 10):
        monkeypatch.setattr(copies, "BLOCK_TEXTS", block)
        left, right = copies.in_blocks(bucket)
        on = ["key", "part", "other"]
        pairs = left.join(right.select(*on, F.col("root").alias("rb")), on).where("root > rb")
        assert pairs.count() == pairs.distinct().count() == 90 * 89 // 2 + 21
        assert left.select(*on).distinct().count() == (81 if block == 10 else 1) + 2
    monkeypatch.setattr(copies, "STAR_ROUNDS", 0)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        words = list(base)
        for p in rng.sample(range(120), rng.randrange(4)):
            words[p] = f"x{i}{p}"
        docs.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in copies.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)
