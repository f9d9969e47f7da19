import numpy as np
from pyspark.sql import functions as F

from lodestack.operators import vectors as v

TYPE = "id long, embedding array<float>, kind int"


def brute(rows, query, k, keep=lambda r: True):
    q = np.array(query, float)
    scored = []
    for r in rows:
        if r[1] is not None and any(r[1]) and keep(r):
            x = np.array(r[1], np.float32).astype(float)
            scored.append((-(x @ q) / np.sqrt((x @ x) * (q @ q)), r[0]))
    return [i for _, i in sorted(scored)[:k]]


def clustered(rng, n, centres=8, spread=0.05):
    at = rng.normal(size=(centres, 12))
    points = at[np.arange(n) % centres] + spread * rng.normal(size=(n, 12))
    return [(i, p.astype(np.float32).tolist(), i % 3) for i, p in enumerate(points)]


def test_an_index_finds_the_nearest_and_reads_little(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [*clustered(rng, 1600), (5000, None, 0), (5001, [0.0] * 12, 0)]
    df = spark.createDataFrame(rows, TYPE)
    v.write_vectors(df, str(tmp_path / "v"), 16)
    index = v.read_vectors(spark, str(tmp_path / "v"))
    shares = []
    for q in (rows[3][1], rows[700][1], rng.normal(size=12).tolist()):
        report = []
        got = [r.id for r in v.semantic_search(index, q, 20, report=report).collect()]
        assert got == brute(rows, q, 20) == [r.id for r in v.semantic_search(df, q, 20).collect()]
        shares.append(report[0]["read"] / report[0]["rows"])
    print("share of vectors read", shares)
    assert sum(shares) / len(shares) < 0.35
    even = v.semantic_search(index, rows[3][1], 5, F.col("kind") == 1)
    assert [r.id for r in even.collect()] == brute(rows, rows[3][1], 5, lambda r: r[2] == 1)
    ids = spark.createDataFrame([(i,) for i in range(0, 1600, 11)], "id long")
    for target in (index, df):
        assert [r.id for r in v.semantic_search(target, rows[3][1], 30, ids).collect()] == brute(rows, rows[3][1], 30, lambda r: r[0] % 11 == 0)
    after = v.semantic_search(index, rows[3][1], 30, ids, post_filter=True)
    assert [r.id for r in after.collect()] == [i for i in brute(rows, rows[3][1], 30) if i % 11 == 0]
    assert [r.id for r in v.semantic_search(index, rows[3][1], 5000).collect()] == brute(rows, rows[3][1], 5000)


def test_scattered_vectors_are_all_found(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 0) for i in range(400)] + [(400 + i, [1.0] + [0.0] * 15, 0) for i in range(60)]
    v.write_vectors(spark.createDataFrame(rows, TYPE), str(tmp_path / "v"), 10)
    index = v.read_vectors(spark, str(tmp_path / "v"))
    for q in (rows[0][1], [1.0] + [0.0] * 15):
        assert [r.id for r in v.semantic_search(index, q, 25).collect()] == brute(rows, q, 25)


def test_edges(spark, tmp_path):
    v.write_vectors(spark.createDataFrame([(1, None, 0), (2, [0.0, 0.0], 0)], TYPE), str(tmp_path / "v"))
    index = v.read_vectors(spark, str(tmp_path / "v"))
    assert v.semantic_search(index, [1.0, 0.0]).count() == 0 and v.semantic_search(index, None).count() == 0 and v.semantic_search(index, [0.0, 0.0]).count() == 0
    v.write_vectors(spark.createDataFrame([(1, [1.0, 2.0], 0)], TYPE), str(tmp_path / "w"))
    assert [r.id for r in v.semantic_search(v.read_vectors(spark, str(tmp_path / "w")), [-1.0, 0.0]).collect()] == [1]


def test_many_queries_in_cells(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [*clustered(rng, 1200), (5000, None, 0), (5001, [0.0] * 12, 0)]
    df = spark.createDataFrame(rows, TYPE)
    v.write_vectors(df, str(tmp_path / "v"), 16)
    index = v.read_vectors(spark, str(tmp_path / "v"))
    queries = df.where("id % 40 = 0 or id >= 5000").select(F.col("id").alias("query_id"), "embedding")
    for keep in (None, F.col("kind") == 1, spark.createDataFrame([(i,) for i in range(0, 1200, 7)], "id long")):
        seen = {"None": lambda r: True, "Column": lambda r: r[2] == 1, "DataFrame": lambda r: r[0] % 7 == 0}[type(keep).__name__.replace("NoneType", "None")]
        counted = spark.sparkContext.accumulator(0)
        got = {}
        for r in v.semantic_search_many(index, queries, 6, keep=keep, compared=counted).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.id
        want = {}
        for r in v.semantic_search_many(df, queries, 6, keep=keep).collect():
            want.setdefault(r.query_id, {})[r["rank"]] = r.id
        assert got == want and 5000 not in got and 5001 not in got
        assert [got[80][i] for i in range(1, 7)] == [i for i in brute(rows, rows[80][1], 7, seen) if i != 80][:6]
        if keep is None:
            print("pairs compared", counted.value, "of", 30 * 1200)
            assert counted.value < 0.5 * 30 * 1200
    assert v.semantic_search_many(index, queries.limit(0), 6).count() == 0
    v.write_vectors(df.limit(0), str(tmp_path / "none"))
    assert v.semantic_search_many(v.read_vectors(spark, str(tmp_path / "none")), queries, 6).count() == 0


def test_no_task_holds_all_queries_against_a_batch():
    """Tiles bound what is held at a time: 3,000 queries by 10,000 rows would take 240 MB for the similarities alone, and several times that sorted."""
    import tracemalloc

    rng = np.random.default_rng(8)
    matrix, own = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(3_000, 8)), rng.normal(size=(10_000, 8))))
    own[17], own[5_000:5_040] = np.nan, own[4_000]
    ids, own_ids, k = np.arange(3_000), np.arange(10_000)[::-1].copy(), 7
    best_s, best_i = np.full((3_000, k), -np.inf), np.zeros((3_000, k), np.int64)
    tracemalloc.start()
    for first in range(0, 10_000, 5_000):
        v.compare(matrix, ids, np.arange(3_000), own[first : first + 5_000], own_ids[first : first + 5_000], best_s, best_i, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
    for q in range(0, 3_000, 97):
        s = np.round(own @ matrix[q], 12)
        s[np.isnan(s) | (own_ids == q)] = -np.inf
        order = np.lexsort((own_ids, -s))[:k]
        assert best_i[q].tolist() == own_ids[order].tolist() and np.allclose(best_s[q], s[order], atol=1e-11)
