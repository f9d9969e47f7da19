import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestack.llm import packing, tokens

SF = "/root/testdata/sf0.001"
os.environ["TOKENIZERS_PARALLELISM"] = "false"
WHOLE = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=800, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aZéÉßİΣσς'’sllve.,-|<>3½ªµ \n\t\x0b\x1c\x1f\x85\xa0́ ", max_size=40) | st.sampled_from(["a<|endoftext|>b", "x <|startoftext|>"]))
def test_word_by_word_equals_whole(text):
    ids, starts = tokens.encoder(tokens.TOKENIZER).encode(pa.array([text, None, text], pa.string()), 1)
    own = brute(text)
    assert ids.tolist() == [*own, 1, *own] and starts.tolist() == [0, len(own), len(own) + 1, 2 * len(own) + 1]


def test_orc_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want, start = [], 0
    for r in docs:
        ids = brute(r.text)
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, tokens.op4_token_id_orc(spark, SF).collect())) == want


def test_orc_files_and_edges(spark, tmp_path):
    rows = [(3, "three"), (1, None), (2, ""), (2, "two two"), (2, "two two"), (None, "lost"), (4, "w " * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("row", F.lit(0))
    path = str(tmp_path / "ids")
    tokens.write_token_ids(docs, path)
    back = {}
    for r in tokens.read_token_ids(spark, path).orderBy("file", "row").collect():
        back.setdefault(r.doc_id, []).append(r.ids)
    assert back[3] == [brute("three")] and back[1] == [[1]] and sorted(back[2]) == sorted([[1], brute("two two"), brute("two two")]) and len(back[4][0]) == 300_001
    index = sorted(tokens.token_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in index] == [None, 1, 2, 2, 2, 3, 4]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(index, index[1:], strict=False))
    empty = str(tmp_path / "none")
    tokens.write_token_ids(docs.limit(0), empty)
    assert tokens.token_index(spark, empty).count() == 0


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = packing.op5_best_fit_packing(spark, SF).collect()
    want = set()
    for d in docs:
        ids = brute(d.text)
        want |= {(d.doc_id, i // 4096, i, len(ids[i : i + 4096]), crc(ids[i : i + 4096])) for i in range(0, len(ids), 4096)}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert check_packing(rows, 4096) <= 1.01 * sum(r.length for r in rows) / 4096 + 1


def test_packing_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y"), (5, "word " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("part", F.lit(0))
    got = packing.pack(docs, capacity=8, keep_ids=True).collect()
    check_packing(got, 8)
    assert sum(r.length for r in got) == sum(len(brute(t)) for _, t in rows)
    assert b"".join(bytes(r.ids) for r in sorted((r for r in got if r.doc_id == 5), key=lambda r: r.piece)) == np.array(brute("word " * 50), "<u4").tobytes()
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20))
def test_plan_places_all(histogram):
    steps = packing.plan(histogram, 40)
    bins = {}
    for x, n in histogram.items():
        own = [s for s in steps if s[0] == x]
        for rank in range(n):
            _, first, each, sequence, offset = max((s for s in own if s[1] <= rank), key=lambda s: s[1])
            k = rank - first
            bins.setdefault(sequence + k // each, []).append((offset + k % each * x, x))
    for own in bins.values():
        at = 0
        for offset, x in sorted(own):
            assert offset == at
            at += x
        assert at <= 40


def test_two_replace_the_smallest():
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [(2, 0, 2, 0, 6), (3, 0, 1, 1, 0), (6, 0, 1, 0, 0)]
