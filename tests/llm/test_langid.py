import random

from pyspark.sql import functions as F

from lodestack.llm import langid

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy_and_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(langid.labelled(docs), train_rows=300)
    assert model.languages == ["de", "en", "es", "fr"]
    last = docs.select(F.xxhash64("doc_id").alias("m")).orderBy("m").limit(300).agg(F.max("m")).first()[0]
    held = docs.where(F.xxhash64("doc_id") > last)
    got = {r.key: r for r in langid.identify(langid.document_rows(held).withColumn("declared", F.lit(None).cast("string")), model).collect()}
    truth = {r.doc_id: r.lang for r in held.collect()}
    assert len(got) == len(truth) and sum(got[i].language == truth[i] for i in truth) >= 0.97 * len(truth)
    rng = random.Random(2)
    noise = [(i, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(80))) for i in range(30)]
    frame = spark.createDataFrame(noise, "key long, text string").withColumn("declared", F.lit("en")).withColumn("host", F.lit("src0"))
    assert not any(r.accepted for r in langid.identify(frame, model).collect())


def test_evidence_decides_where_text_is_thin(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(langid.labelled(docs))
    sure = {x: docs.where(F.col("lang") == x).select("text").first()[0] for x in ("de", "fr")}
    rows = [(i, sure["de"], "de", "www.a.example.de") for i in range(30)] + [(100 + i, sure["fr"], "fr", "b.example.fr") for i in range(30)]
    rows += [(200, "in", None, "www.a.example.de"), (201, "la", None, "new.example.fr"), (202, "so", "de", None)]
    got = {r.key: r.language for r in langid.identify(spark.createDataFrame(rows, "key long, text string, declared string, host string"), model).collect()}
    assert got[200] == "de" and got[201] == "fr" and got[202] == "de"


def test_queries_cover_all_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.op3_language_id(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(lang[r.doc_id] == r.language for r in rows) >= 0.97 * len(rows) and all(r.accepted for r in rows)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    found = langid.language_id_pages(spark, SF).collect()
    assert len(found) == pages.count()


def test_edges(spark):
    rows = [(1, None, "en", "src0"), (2, "", None, None), (3, "12 34 5", "en", "src0"), (None, None, None, None), (4, "the and of the thing", "en", "src1"), (4, "the and of the thing", "en", "src1"), (5, "the of and " * 40_000, "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("p0", F.lit("clash")).withColumn("host", F.lit(1))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 4, 5]
    assert langid.keep_identified(docs.limit(0)).count() == 0


def test_rare_labels_become_languages(spark):
    rng = random.Random(3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text"), "lang", "source")
    many = docs.crossJoin(spark.range(12)).select((F.col("doc_id") * 12 + F.col("id")).alias("doc_id"), "text", "lang", "source")
    words = ["".join(chr(rng.randrange(0x3B1, 0x3C9)) for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    greek = spark.createDataFrame([(-1 - i, " ".join(rng.choices(words, k=60)), "el", "src0") for i in range(30)], many.schema)
    docs = many.union(greek)
    few = docs.where("doc_id >= -3")
    for rows, n in ((docs, 30), (few, 3)):
        model = langid.train(langid.labelled(rows))
        assert model.languages == ["de", "el", "en", "es", "fr"]
        assert langid.identify(langid.document_rows(rows), model).where("key < 0 and language = 'el'").count() == n
        assert langid.keep_identified(rows).where("doc_id < 0").count() == n


def test_labels_beyond_the_bound_stay(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LABELS", 1)
    rows = [(i, "the and of the thing", "en", None) for i in range(3)] + [(9, "\u4e00\u4e8c\u4e09" * 40, "ja", None), (10, "", "ja", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert langid.train(langid.labelled(docs)).languages == ["en"]
    assert sorted(r.doc_id for r in langid.keep_identified(docs).collect()) == [0, 1, 2, 9]


def test_fusion_equals_plain_bayes(spark):
    """op3 on all of sf0.001, in plain Python: trigrams, smoothed likelihoods, posteriors, confusions and priors without a row's own share."""
    from collections import Counter
    from math import exp, log

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fold = lambda b: b if b >= 128 or 97 <= b <= 122 else 32

    names = sorted({r.lang for r in docs})
    counts = {x: Counter() for x in names}
    own = {}
    for r in docs:
        raw = f" {r.text or ''} ".lower().encode()
        data = [fold(b) for b in raw]
        own[r.doc_id] = [((((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 16) for a, b, c in zip(data, data[1:], data[2:], strict=False) if b != 32]
        counts[r.lang].update(own[r.doc_id])
    logs = {x: (counts[x], sum(counts[x].values()) + langid.SMOOTHING * langid.CELLS) for x in names}
    soft = lambda v: [exp(x - max(v)) / sum(exp(y - max(v)) for y in v) for x in v]
    scores, shares = {}, {}
    for i, cells in own.items():
        v = [sum(log((logs[x][0][c] + langid.SMOOTHING) / logs[x][1]) for c in cells) for x in names] + [-len(cells) * log(langid.CELLS)]
        scores[i] = [x * langid.TEMPER for x in v]
        shares[i] = soft(scores[i]) if cells else [0.0] * len(v)
    k = len(names)
    add = lambda rows: [sum(c) for c in zip(*rows, strict=True)] if rows else [0.0] * k
    part = lambda keep: add([shares[r.doc_id][:k] for r in docs if keep(r)])
    total = part(lambda r: True)
    overall = [(x + 1) / (sum(total) + k) for x in total]
    seen = total
    told = {}
    for d in names:
        prior = [langid.DECLARED_TRUE if d == x else (1 - langid.DECLARED_TRUE) / (k - 1) for x in names]
        told[d] = [log((s + langid.DECLARED_WEIGHT * p) / (n + langid.DECLARED_WEIGHT)) for s, p, n in zip(part(lambda r, d=d: r.lang == d), prior, seen, strict=True)] + [log(1 / (k + 2))]
    hosts = {h: part(lambda r, h=h: r.source == h) for h in {r.source for r in docs}}
    got = {r.doc_id: r for r in langid.op3_language_id(spark, SF).collect()}
    assert len(got) == len(docs)
    for r in docs:
        rest = lambda v: [max(x - y, 0) for x, y in zip(v, shares[r.doc_id], strict=False)]  # noqa: B023, E731
        above = rest(total)  # no source has a dot: one suffix holds all
        above = [(x + langid.SUFFIX_WEIGHT * o) / (sum(above) + langid.SUFFIX_WEIGHT) for x, o in zip(above, overall, strict=True)]
        host = rest(hosts[r.source])
        host = [(x + langid.HOST_WEIGHT * o) / (sum(host) + langid.HOST_WEIGHT) for x, o in zip(host, above, strict=True)]
        prior = [log(x * (1 - langid.UNDETERMINED_PRIOR)) for x in host] + [log(langid.UNDETERMINED_PRIOR)]
        post = soft([a + b + c for a, b, c in zip(scores[r.doc_id], prior, told[r.lang], strict=True)])
        best = post.index(max(post))
        assert got[r.doc_id].language == (names + ["und"])[best] and abs(got[r.doc_id].confidence - max(post)) < 1e-3


def test_pages_of_every_kind(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.where("lang = 'de'").first().text[:2000]
    rows = [
        (1, "https://a.de/x", f'<html lang="de"><body>{text}</body></html>'), (2, None, None), (3, "", ""), (4, "nonsense", "<html lang=de><script>" + text), (5, "http://u@b.de:80/", "<!-- " + text),
        (6, "https://c.de", "<p>" + text * 200), (7, "https://c.de", "<" * 100_000), (8, "https://c.de", "<style>x</style>" + text + "&amp;" * 10), (8, "https://c.de", "<style>x</style>" + text + "&amp;" * 10), (None, "https://c.de", text),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit(1))
    evidence = {(r.key, r.host): (r.text.strip() if r.text else r.text, r.declared) for r in langid.page_rows(pages).collect()}
    assert evidence[1, "a.de"][1] == "de" and evidence[5, "b.de"][0] == "" and evidence[4, None] == ("", "de") and evidence[2, None] == (None, None)
    got = sorted(((r.key, r.language) for r in langid.identify(langid.page_rows(pages), langid.train(langid.labelled(docs))).collect()), key=str)
    assert got == sorted([(1, "de"), (2, "und"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (7, "und"), (8, "de"), (8, "de"), (None, "de")], key=str)
    assert langid.identify(langid.page_rows(pages.limit(0)), langid.train(langid.labelled(docs))).count() == 0
