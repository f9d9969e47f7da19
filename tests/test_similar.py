import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestack.operators import similar

SCHEMA = "issue_id long, project_id long, content string"


def brute(rows, limit, top_terms=30):
    """(issue, other, score, rank) by comparing all issues with each other."""
    tfs = {i: Counter(re.findall(r"[^\W\d_]+|\d+", (t or "").lower())) for i, _, t in rows}
    df = Counter(t for c in tfs.values() for t in c)
    n = len(rows)
    w = {i: {t: x for t, tf in c.items() if df[t] < n and (x := math.floor(tf * math.log(n / df[t]) * similar.UNIT + 0.5)) > 0} for i, c in tfs.items()}
    out = set()
    for i, own in w.items():
        top = sorted(own, key=lambda t: (-own[t], t))[:top_terms]
        scores = {j: sum(own[t] * w[j][t] for t in top if t in w[j]) for j in w if j != i}
        best = sorted((-s, j) for j, s in scores.items() if s > 0)[:limit]
        out |= {(i, j, -s / similar.UNIT**2, r) for r, (s, j) in enumerate(best, 1)}
    return out


def contents(rng, n, hot):
    """Issues of rare, middling and frequent words; hot ones are in most issues, copies and empty ones among them."""
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(0, 12)) + [h for h in hot if rng.random() < 0.7] * rng.randrange(1, 4) + [f"r{rng.randrange(n // 2)}" for _ in range(rng.randrange(4))]
        rows.append((i, i % 3, " ".join(text)))
    return [*rows, (n, 0, rows[0][2]), (n + 1, 0, ""), (n + 2, 0, None)]


def test_pairs_equal_brute_force_and_shrink(spark, monkeypatch):
    rows = contents(random.Random(4), 300, ["hot", "warm", "mild"])
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(similar, "FIRST_ROUND", 4)
    monkeypatch.setattr(similar, "ROUND_FACTOR", 6)
    monkeypatch.setattr(similar, "BLOCK", 50)
    report = []
    got = {tuple(r) for r in similar.similar_pairs(df, 3, report=report).collect()}
    assert got == brute(rows, 3)
    every = similar.term_weights(df).where("rank <= 30").groupBy("df").count().select(F.sum(F.col("df") * F.col("count"))).first()[0]
    print(report, every)
    assert len(report) > 1 and sum(r["pairs"] for r in report) < every / 2
    assert [r["issues"] for r in report] == sorted((r["issues"] for r in report), reverse=True)


def test_issues_of_frequent_terms_are_compared_by_blocks_without_rows_for_pairs(spark, monkeypatch):
    rows = contents(random.Random(9), 260, ["hot", "warm", "mild"])
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(similar, "FIRST_ROUND", 4)
    monkeypatch.setattr(similar, "PAIRED", 20)
    monkeypatch.setattr(similar, "ASKED_ROWS", 700)
    monkeypatch.setattr(similar, "HELD", 100)
    written = []
    whole = similar.by_blocks
    monkeypatch.setattr(similar, "by_blocks", lambda a, w, n, kept: whole(a, w, n, lambda d, name: written.append((name, kept(d, name))) or written[-1][1]))
    report = []
    assert {tuple(r) for r in similar.similar_pairs(df, 3, report=report).collect()} == brute(rows, 3)
    blocks = [d for name, d in written if name.startswith("block")]
    assert len(blocks) > 1 and len(report) == 2
    # At most the best of every issue in each task, though the products are many.
    assert all(d.count() <= 3 * report[-1]["issues"] * 4 for d in blocks) and sum(d.count() for d in blocks) < report[-1]["pairs"] / 2


def test_one_issue_equals_pairs(spark, tmp_path):
    rows = contents(random.Random(5), 60, ["hot"])
    df = spark.createDataFrame(rows, SCHEMA)
    similar.write_weights(df, str(tmp_path / "w"))
    stored = similar.read_weights(spark, str(tmp_path / "w"))
    want = brute(rows, 4)
    for i in (0, 7, 60, 61):
        assert [tuple(r) for r in similar.similar_issues(stored, i, 4).collect()] == [(j, s) for _, j, s, _ in sorted((x for x in want if x[0] == i), key=lambda x: x[3])]
    seen = similar.similar_issues(stored, 0, 60, projects=spark.createDataFrame([(1,)], "project_id long")).collect()
    assert seen and all(r.issue_id % 3 == 1 for r in seen)
    plan = similar.similar_issues(stored, 0)._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan.replace("PushedFilters: [In", "In") or "EqualTo(term" in plan


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert similar.similar_pairs(empty).count() == 0
    one = spark.createDataFrame([(1, 1, "alone")], SCHEMA)
    assert similar.similar_pairs(one).count() == 0 and similar.similar_issues(one, 1).count() == 0
    assert similar.similar_pairs(spark.createDataFrame([(1, 1, "same words"), (2, 1, "same words")], SCHEMA)).count() == 0
    three = spark.createDataFrame([(1, 1, "a b"), (2, 1, "a"), (3, 1, "c")], SCHEMA)
    assert [(r.issue_id, r.other_id, r["rank"]) for r in similar.similar_pairs(three).orderBy("issue_id").collect()] == [(1, 2, 1), (2, 1, 1)]
    assert similar.similar_pairs(three).first().score == pytest.approx(math.log(1.5) ** 2, rel=1e-3)
