import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestack.llm import simhash
from lodestack.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute_fp(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=4):
    part = {i: i for i in range(len(ids))}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                part[a] = b
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(ids))]


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    fps = [brute_fp(r.text) for r in docs]
    expected = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(docs, fps, brute_components([r.doc_id for r in docs], fps), strict=True)}
    assert {tuple(r) for r in simhash.op7_simhash_near_dedup(spark, SF).collect()} == expected


def test_links_on_planted_balls(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:20]:
        for k in (1, 2, 3, 4, 5, 6):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), k)))
    ids = list(range(len(fps)))
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    part = {r.vertex: r.root for r in connected_components(simhash.links(df)).collect()}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    mine = [part.get(s, s) for s in signed]
    brute = brute_components(ids, fps)
    assert len(set(zip(mine, brute, strict=True))) == len(set(mine)) == len(set(brute))


def test_split_keys_give_the_same_links(spark, monkeypatch):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 5, 9)))) for _ in range(150)}
    monkeypatch.setattr(simhash, "SPLIT_VARIANTS", 20_000)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    part = {r.vertex: r.root for r in connected_components(simhash.links(df)).collect()}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    mine = [part.get(s, s) for s in signed]
    brute = brute_components(list(range(len(fps))), fps)
    assert len(set(zip(mine, brute, strict=True))) == len(set(mine)) == len(set(brute))


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "one two", "x"), (5, "ONE\ttwo", "x"), (6, long, "x"), (7, long, "x"), (8, "a b c d", "x"), (8, "a b c d", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit("clash")).withColumn("prefix", F.lit(1))
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "component_id").collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (8, 8)]
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [1, 4, 6, 8]
    assert simhash.one_of_each(docs).columns == docs.columns
    same_ids = spark.createDataFrame([(None, "a b c d e"), (None, "f g h i j"), (5, "k l m n o"), (9, "a b c d e"), (5, "p q r s t")], "doc_id long, text string").withColumn("_row", F.lit("clash"))
    assert sorted(map(str, (tuple(r)[:2] for r in simhash.one_of_each(same_ids).collect()))) == sorted(map(str, [(None, "f g h i j"), (5, "k l m n o"), (5, "p q r s t"), (9, "a b c d e")]))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r.vertex: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in [7, *range(200, 260)]}
