import re
import zlib
from collections import Counter
from math import exp, isclose, log, log10

from pyspark.sql import functions as F

from lodestack.llm import lm

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_base_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in docs}
    counts = Counter(t for r in docs if not out[r.doc_id] for t in [*tokens(r.text), None])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm.op2_subword_lattice_lm(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        own, g = [*tokens(r.text), None], got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (out[r.doc_id], len(own), sum(counts[t] > 0 for t in own), n)
        assert isclose(g.base_score, sum(log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own), rel_tol=1e-9)
    pieces, weights = lm.vocabulary(lm.VOCABULARY)
    untrained = lm.Lattice.of(pieces, weights)
    held = [r for r in docs if out[r.doc_id]]
    assert sum(got[r.doc_id].score for r in held) > 0.9 * sum(untrained.score(t.encode()) / log(10) for r in held for t in tokens(r.text))


def test_forward_recursion_sums_all_segmentations():
    pieces, weights = lm.vocabulary(lm.VOCABULARY)
    assert isclose(weights.sum(), 1)
    lattice, weight = lm.Lattice.of(pieces, weights), dict(zip(pieces, weights, strict=True))

    def brute(rest):
        return 1.0 if not rest else sum(weight.get(rest[:i], 0) * brute(rest[i:]) for i in range(1, len(rest) + 1))

    for word in ("the", "thing", "été", "x1_", "中"):
        assert isclose(exp(lattice.score(word.encode())), brute(b" " + word.encode()), rel_tol=1e-9)

    def cuts(rest):
        return [[]] if not rest else [[rest[:i], *c] for i in range(1, len(rest) + 1) if rest[:i] in weight for c in cuts(rest[i:])]

    uses, total = Counter(), 0.0
    for c in cuts(b" thin"):
        p = exp(sum(log(weight[x]) for x in c))
        total += p
        for x in c:
            uses[x] += p
    into = lm.defaultdict(float)
    lattice.expected(b"thin", 3, into)
    assert all(isclose(into[k], 3 * uses[pieces[k]] / total, rel_tol=1e-9) for k in into) and len(into) == len(uses)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD_WORDS", 50)
    rows = [(1, None), (2, ""), (4, "Aa aa b"), (4, "Aa aa b"), (None, "b"), (5, "\x00 中" * 3), (7, "word " * 200_000), (8, "u" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("row", F.lit(0))
    got = lm.score_texts(docs).collect()
    assert len(got) == len(rows) and all(r.score < 0 and r.base_score < 0 for r in got)
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 2, 4, 4, 5, 200_001]
    assert lm.score_texts(docs.limit(0)).count() == 0


def test_long_words_are_scored_alike_in_bounded_memory(monkeypatch):
    import tracemalloc

    lattice = lm.Lattice.of(*lm.vocabulary(lm.VOCABULARY))
    word, plain, long = b"internationalisation" * 30, Counter(), Counter()
    score = lattice.score(word)
    lattice.expected(word, 2, plain)
    monkeypatch.setattr(lm, "LONG_WORD", 10)
    lattice.expected(word, 2, long)
    assert isclose(lattice.score(word), score) and plain.keys() == long.keys() and all(isclose(plain[k], long[k]) for k in plain)
    tracemalloc.start()
    lattice.score(bytes(97 + i * i % 26 for i in range(200_000)))
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()
