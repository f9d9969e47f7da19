import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import pieces

SF = "/root/testdata/sf0.001"
DATA = open(public_tokenizers.path(pieces.MODEL), "rb").read()


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def with_map(rule, squeeze, prefix=1, spelled=1):
    """The model with another character map and flags (later fields of a message win), and without its pieces of single bytes if not spelled."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec() + b"\x18" + bytes([prefix]) + b"\x20" + bytes([squeeze])
    trainer = b"\x98\x02" + bytes([spelled])
    kept = [(n, v) for n, v in pieces.fields(DATA) if spelled or n != 1 or dict(pieces.fields(v)).get(3) != 6]
    return b"".join(bytes([8 * n + 2]) + varint(len(v)) + v for n, v in [*kept, (3, spec), (2, trainer)])


MODELS = {
    "own": pieces.PieceModel(DATA),
    "nfkc, spaces kept": pieces.PieceModel(with_map("nmt_nfkc", 0)),
    "nfkc, spaces squeezed": pieces.PieceModel(with_map("nmt_nfkc_cf", 1)),
    "no prefix, unknown pieces": pieces.PieceModel(with_map("nfkc", 0, 0, 0)),
}
TEXTS = st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["the ", "word", " ", "  ", "\n", "\t", "▁", "▁▁ ", "é", "é", "ｶﾞ", "①", " ", "　", "​", "ﷺ", "😀", "\0", "日本語", "<s>", "</s>", "<0x41>", "½", "ˇ ", "㌀", "a" * 80])), max_size=14).map("".join)


@pytest.mark.parametrize("name", MODELS)
@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS.filter(lambda t: t.isprintable() or "\ud800" not in t), min_size=1, max_size=6))
def test_ids_spans_and_decoding_equal_the_library(name, texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    model = MODELS[name]
    worker = pieces.PieceEncoder(model)
    array = pa.array([None, "skipped", *texts, None])[2:]
    for _ in range(2):  # learnt, then remembered
        ids, starts, ends, bounds = worker.encode(array)
        for i, t in enumerate([*texts, ""]):
            a, b = bounds[i], bounds[i + 1]
            want = model.processor.encode(t, return_type="proto").pieces
            assert ids[a:b].tolist() == [*(p.id for p in want), 2] == model.processor.encode(t, add_eos=True)
            spans = list(zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))
            assert spans == [*((p.begin, p.end) for p in want), (len(t.encode()),) * 2]
    assert worker.decode(ids, bounds) == [model.processor.decode(model.processor.encode(t)) for t in [*texts, ""]]


@pytest.mark.parametrize("name", MODELS)
@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_normaliser_equals_the_library(name, text):
    text = text.encode("utf-8", "replace").decode()
    plain, origin = MODELS[name].normalise(text.encode())
    assert plain.decode() == MODELS[name].processor.normalize(text)
    assert len(origin) == len(plain) + 1 and origin == sorted(origin)


def test_longest_key_wins():
    items = dict(MODELS["nfkc, spaces kept"].map.items())
    assert len(items) > 1000 and items["①".encode()] == b"1"
    for key, value in list(items.items())[:500]:
        assert MODELS["nfkc, spaces kept"].map.longest(b"x" + key + b"\xff", 1) == (len(key), value)


def test_units_are_cut_only_where_no_piece_reaches_across():
    assert MODELS["own"].after.sum() == 254 and not MODELS["nfkc, spaces squeezed"].after.any()


def test_query_equals_brute_force(spark):
    rows = pieces.op13_sentencepiece_offsets(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    library = sentencepiece.SentencePieceProcessor(model_proto=DATA)
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))


def test_edges(spark):
    long = "wordé " * 60_000 + "x" * 100_000
    rows = [(1, None), (2, ""), (3, " a  b "), (3, " a  b "), (None, "一\U0001f600"), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("key", F.lit(1))
    found = pieces.encode_pieces(docs, decoded=True)
    got = {(r.doc_id, r.decoded): r for r in found.collect()}
    assert found.columns == ["doc_id", "ids", "starts", "ends", "decoded"] and found.count() == 6
    assert got[1, ""].ids == got[2, ""].ids == [2] and got[1, ""].ends == [0] and (3, " a  b ") in got and (4, long) in got
    data = long.encode()
    r = got[4, long]
    assert b"".join(data[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == data
    back = pieces.decode_pieces(found.select("doc_id", "ids").union(spark.createDataFrame([(9, None), (8, [])], "doc_id long, ids array<int>")))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted([(1, ""), (2, ""), (3, " a  b "), (3, " a  b "), (None, rows[4][1]), (4, long), (9, None), (8, "")], key=str)
    assert pieces.encode_pieces(docs.limit(0)).count() == 0
