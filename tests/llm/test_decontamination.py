import random
from collections import Counter
from math import log

import pyarrow as pa
from pyspark.sql import functions as F

from lodestack.llm import decontamination as d

SF = "/root/testdata/sf0.001"


def brute(docs, items, least=0.8):
    """Every window of every document against every item, on the shingles themselves."""

    def shingles(words, k):
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))

    split = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    sets = {i: (len(w), min(5, len(w)), shingles(w, min(5, len(w)))) for i, t in items if (w := split(t))}
    holders = Counter(s for _, _, c in sets.values() for s in c)
    weight = lambda s, own: 1 + log(len(items) / (holders[s] if s in own else 1))
    out = {}
    for doc, text in docs:
        words = split(text)
        for item, (n, k, own) in sets.items():
            for a in range(len(words) - n + 1):
                got = shingles(words[a : a + n], k)
                if not got.keys() & own.keys():
                    continue
                s = sum(weight(x, own) * min(got[x], own[x]) for x in got) / sum(weight(x, own) * max(got[x], own[x]) for x in got.keys() | own.keys())
                if s >= least and s > out.get((doc, item), (0, 0))[0] + 1e-12:
                    out[doc, item] = (s, a)
    return out


def test_query_finds_what_brute_force_finds(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in d.op9_benchmark_decontamination(spark, SF).collect()}
    assert want and {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def test_edited_passages_and_blocks(spark, monkeypatch):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice((3, 20, 60, 120))))) for i in range(25)]
    docs = []
    for k in range(60):
        words = rng.choices(vocabulary, k=150)
        item = rng.choice(items)[1].split()
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            item[rng.randrange(len(item))] = "edited"
        words[40:40] = item
        docs.append((k, " ".join(words)))
    want = brute(docs, items)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    held = Counter(h for _, t in items for h in d.distinct_shingles(hashes(t), 5).tolist())
    index = d.ItemIndex(items, len(items), {h: k for h, k in held.items() if k > 1})
    got = {(doc, m[0]): m[1] for doc, text in docs for m in index.matches(hashes(text), 0.8)}
    assert got == {k: v[1] for k, v in want.items()} and len(want) > 30
    for limit, value in (("BLOCK_CHARS", 2500), ("BLOCK_ITEMS", 10)):  # several blocks of items give the same rows
        with monkeypatch.context() as m:
            m.setattr(d, limit, value)
            rows = d.contaminated(*frames).collect()
        assert {(r.doc_id, r.item_id): r.start_word for r in rows} == {k: v[1] for k, v in want.items()} and len(rows) == len(want)
        assert all(abs(r.similarity - want[r.doc_id, r.item_id][0]) < 1e-9 for r in rows)


def hashes(text):
    return d.hashed_words(pa.array([text]))[0]


def test_index_passes_a_small_share_and_loses_nothing():
    """Of pairs of a window and an item of its size; recall is held against brute force on whole tables in the tests above."""
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(2000)], k=60))) for i in range(200)]
    index = d.ItemIndex(items, len(items), {})
    near = 0
    for i, text in items:
        words = text.split()
        for p in rng.sample(range(60), 1):
            words[p] = "edited"
        found = index.matches(hashes(" ".join(["x"] * 20 + words + ["y"] * 20)), 0.8)
        near += [m[0] for m in found] == [i]
    assert near == len(items)
    share = index.passed / index.pairs
    print(f"share of pairs that the index passes: {share:.3f}")
    assert share < 0.25


def test_edges(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, "one two"), (4, "one two"), (None, "beta alpha one two")], "item_id long, text string").withColumn("similarity", F.lit(1))
    rows = [(1, None), (2, ""), (3, "x ALPHA beta gamma delta\nepsilon zeta y"), (3, "x ALPHA beta gamma delta\nepsilon zeta y"), (4, "beta alpha"), (None, "one two"), (5, "w " * 300_000 + "one two"), (6, "beta alpha one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    got = sorted(((r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity) for r in d.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(3, 1, 1, 6, 1.0)] * 2 + [(None, 4, 0, 2, 1.0), (5, 4, 300_000, 2, 1.0), (6, 4, 2, 2, 1.0), (6, None, 0, 4, 1.0)], key=str)
    kept = d.decontaminate(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4] and kept.columns == docs.columns
    assert d.contaminated(docs.limit(0), items).count() == 0 and d.contaminated(docs, items.limit(0)).count() == 0


def test_documents_shorter_than_the_item(spark):
    words = [f"w{i}" for i in range(50)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(1, " ".join(words[:-1])), (2, " ".join(words[2:])), (3, " ".join(words[:25])), (4, "w0 w1 w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.n_words, round(r.similarity, 6)) for r in d.contaminated(docs, items).collect())
    assert got == [(1, 0, 49, round(45 / 46, 6)), (2, 0, 48, round(44 / 46, 6))]
