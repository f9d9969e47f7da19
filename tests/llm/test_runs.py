import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import runs

SF = "/root/testdata/sf0.001"


def brute(words):
    """All runs as (start, length, period): for each period the longest stretches in which words so far apart are alike."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)  # multiples of the period come later
            i = j
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def found(texts):
    words, ids, bounds = runs.word_ids(pa.array(texts, pa.string()))
    out = [[] for _ in texts]
    for s, e, q in zip(*(x.tolist() for x in runs.runs_of(ids, bounds)), strict=True):
        of = int(np.searchsorted(bounds, s, "right")) - 1
        out[of].append((s - int(bounds[of]), e - s, q))
    return out


STRETCH = st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=7), st.integers(1, 12)).map(lambda x: x[0] * x[1])
TEXT = st.one_of(st.text("ab ", max_size=60), st.lists(STRETCH, max_size=6).map(lambda x: " ".join(sum(x, []))), st.just("x y z"))


@settings(max_examples=1500, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_runs_equal_brute_force(texts):
    assert found(texts) == [brute(t.split()) for t in texts]


def test_longer_texts():
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(900))]
        for _ in range(rng.randrange(4)):
            unit = words[: rng.randrange(1, 60)] or ["u"]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * rng.randrange(2, 9))[: rng.randrange(1, 400)]
        texts.append(" ".join(words))
    assert found(texts) == [brute(t.split()) for t in texts]
    assert sum(map(len, found(texts))) > 30


def fibonacci(n):
    a, b = "a", "a b"
    while len(b) < 2 * n:
        a, b = b, b + " " + a
    return b.split()[:n]


def test_hard_words():
    thue = [str(bin(i).count("1") % 2) for i in range(3000)]
    nested = ((["a"] * 8 + ["b"]) * 6 + ["c"]) * 5
    for words in (["a"] * 5000, ["a", "b"] * 1500 + ["a"], fibonacci(1500), thue, nested, (["a", "a", "a", "a", "b"] * 400)[:-2]):
        assert found([" ".join(words)]) == [brute(words)]


def test_grammar_expands_to_the_text():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 5, 4000)
    begin, middle, end, put, left = runs.grammar(words)
    assert len(left) < 2000 and len(begin) > 100
    rule, place = (np.concatenate(x) for x in zip(*put, strict=True))
    assert (np.bincount(rule) >= 2).all()
    for r, p in zip(rule.tolist(), place.tolist(), strict=True):
        size = end[r] - begin[r]
        assert np.array_equal(words[p : p + size], words[begin[r] : end[r]]) and begin[r] < middle[r] < end[r]


def test_long_text_takes_little_time():
    import time

    for words in (["a"] * 300_000, [str(i % 997) for i in range(300_000)], [f"x{i * i % 50021}" for i in range(300_000)]):
        began = time.perf_counter()
        got = found([" ".join(words)])[0]
        assert time.perf_counter() - began < 30
        assert len(got) <= 1


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    all_runs = brute(words)
    best = min(all_runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(all_runs), *tail, digest("".join(f"{s},{length},{q}\n" for s, length, q in all_runs)), digest(" ".join(collapsed(words, all_runs))))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 12000")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: tuple(r)[1:] for r in runs.op12_periodic_runs(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and len(texts) > 150
    for i, t in texts.items():
        assert rows[i] == expected(i, t)
    assert sum(r[0] > 0 for r in rows.values()) > 10


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a b"), (4, "a a a a a a b"), (5, " x\u00a0y\x0b x\u00a0y " * 3), (None, "b b b b b"), (6, "w " * 100_000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("key", F.lit(1))
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.collapse_runs(docs).collect()), key=str)
    same = (4, [(0, 6, 1)], "a b")
    want = [(1, [], ""), (2, [], ""), (3, [], ""), same, same, (5, [(0, 6, 1)], "x\u00a0y"), (None, [], "b b b b b"), (6, [(0, 100_000, 1)], "w end")]
    assert got == sorted(want, key=str)
    assert runs.collapse_runs(docs.limit(0)).count() == 0
    kept = docs.where("doc_id is null").select(runs.with_repeats(F.col("doc_id"), F.col("text"))).first()[0]
    assert kept == "b b b b b"
