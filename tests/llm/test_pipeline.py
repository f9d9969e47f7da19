import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from test_copies import brute as near
from test_decontamination import brute as contaminated
from test_pii import brute as base_spans
from test_tokens import brute as token_ids
from test_tokens import check_packing, crc

from lodestack.llm import langid, pii

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r.text for r in table.orderBy("doc_id").collect()}
    judged = langid.identify(langid.document_rows(table), langid.train(langid.labelled(table))).collect()
    docs = {k: docs[k] for k in sorted(r.key for r in judged if r.accepted)}
    docs = {k: docs[k] for k, c in near(list(docs.items())).items() if k == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {k for k, _ in contaminated(list(docs.items()), items)}
    assert bad
    want = set()
    for k, t in docs.items():
        if k in bad:
            continue
        spans = pii.covered(pii.find(t, pii.automaton()))
        assert {(a, b) for _, a, b in base_spans(t)} <= {(a, b) for _, a, b in pii.find(t, pii.automaton())}
        for kind, a, b in reversed(spans):
            t = f"{t[:a]}[{pii.KINDS[kind].upper()}]{t[b:]}"
        ids = token_ids(t)
        want |= {(k, i // 4096, i, len(ids[i : i + 4096]), crc(ids[i : i + 4096])) for i in range(0, len(ids), 4096)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    check_packing(rows, 4096)


def test_stages_keep_columns_and_bear_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
