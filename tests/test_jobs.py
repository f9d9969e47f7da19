import importlib.util
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__
from lodestack.operators import exports, logs, similar, sync, vectors
from lodestack.operators import corpus as c
from lodestack.operators.corpus import CORPUS
from lodestack.sources import buckets, readers, sinks
from lodestack.streaming import streams

T = datetime(2024, 1, 1)


def test_entry_and_registry(spark):
    queries, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(queries) and len(oracle) > 70
    assert ("op1_pii_anchor_expansion" in queries) == (importlib.util.find_spec("lodestack.llm") is not None)
    assert __spark_entry__.entry(spark).columns == ["source_id", "score"]


def test_log_of_two_users(spark):
    def at(n):
        return T + timedelta(seconds=n)

    rows = [
        (1, 0, False, "x", 0, at(0), None, None),  # a visit before any search
        (1, 1, True, "a", None, at(1), 3, 0.5),
        (1, 2, False, "a", 5, at(2), None, None),
        (1, 3, False, "a", 0, at(3), None, None),
        (1, 4, True, "a", None, at(4), 3, 0.7),  # paging under one search_id
        (1, 5, False, "a", 0, at(5), None, None),
        (1, 6, True, "b", None, at(6), 0, 1.5),
        (2, 1, True, "c", None, at(1), 1, 0.2),
        (2, 2, False, "c", 5, at(2), None, None),
    ]
    log = spark.createDataFrame(rows, "user_id long, position long, is_search boolean, search_id string, search_n long, timestamp timestamp, n_hits long, elapsed double")
    assert [(r.user_id, r.n_searches, r.n_visits) for r in logs.search_stats(log).collect()] == [(1, 3, 3), (2, 1, 1)]
    assert {r.user_id: r.n_zero for r in logs.zero_hits(log).collect()} == {1: 1, 2: 0}
    got = {(r.user_id, r.block): r.converted for r in logs.conversions(log).collect()}
    assert got == {(1, 1): False, (1, 2): True, (1, 3): False, (2, 1): False}


def test_log_lines(spark, tmp_path):
    lines = [
        '[full-text-search][search] {"search_id":"s1","q":"x","user_id":4,"n_hits":0,"total_n_hits":2,"elapsed_time":1.25,"timestamp":"2024-01-01T00:00:00Z"}',
        'Started GET "/issues/1" for ::1 at 2024-01-01 00:00:05 +0000',
        '  Parameters: {"search_id"=>"s1", "search_n"=>"2", "id"=>"1"}',
        "  Current user: admin (id=4)",
        "  Current user: admin (id=5)",
        "[ActiveJob] [Job] [abc] [full-text-search][text-extract] Extracted: Target: <7>: path: </a/B.PDF>: elapsed time: <1.5m>: memory usage: <1.50GiB>: memory usage diff: <600MiB>",
        "[full-text-search][text-extract] Failed to extract: path: </x.pdf>: encrypted",
        "[full-text-search][text-extract] Failed to extract: path: </y.pdf>: broken",
        "noise",
    ]
    (tmp_path / "log.txt").write_bytes("\n".join(lines).encode() + b"\n\xff bad bytes")
    df = readers.read_action_log(spark, str(tmp_path))
    assert df.where("kind = 'search'").select("search.q", "search.n_hits", "search.elapsed_time").first() == ("x", 0, 1.25)
    v = logs.visits(df).collect()
    assert [(r.user_id, r.search_id, r.search_n) for r in v] == [(4, "s1", 2)] and v[0].timestamp == datetime(2024, 1, 1, 0, 0, 5)
    stats = logs.extraction_stats(df).first()
    assert (stats.extension, stats.n, stats.n_slow, stats.total) == ("pdf", 1, 1, 90.0)
    assert {r.alert for r in logs.resource_alerts(df).collect()} == {"large memory diff", "large memory use", "slow"}
    assert [r.path for r in logs.extraction_errors(df).collect()] == ["/y.pdf"]


def test_expansion_files(spark, tmp_path):
    for name, text in (("a.CSV", '﻿press,print\n"a,b",c\n'), ("b.json", '[["press","print"],["a,b","c"]]'), ("c.json", '[{"source":"press","destination":"print"},{"source":"a,b","destination":"c"}]'), ("d", ' [["press","print"],["a,b","c"]]'), ("e", "press,print\n\"a,b\",c")):
        (tmp_path / name).write_text(text)
        assert sorted(map(tuple, readers.read_expansions(spark, str(tmp_path / name)).collect())) == [("a,b", "c"), ("press", "print")]
    (tmp_path / "f.csv").write_text('\ufeff"two\nlines","say ""x"""\n\na, b \n')
    assert sorted(map(tuple, readers.read_expansions(spark, str(tmp_path / "f.csv")).collect())) == [("a", " b "), ("two\nlines", 'say "x"')]


def test_snapshots_and_streams(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    assert sinks.read_corpus(spark, folder).count() == 0
    source = spark.createDataFrame([(i, 1, "d", f"t{i}", T) for i in range(1, 5)], "id long, project_id long, description string, title string, created_on timestamp")
    sources = {"Document": (source, c.map_documents)}
    feed = [(1, "Document", 1, "upsert"), (2, "Document", 2, "upsert"), (3, "Document", 1, "delete"), (4, "Document", 9, "upsert"), (5, "Document", 3, "delete"), (6, "Document", 3, "upsert")]
    df = spark.createDataFrame(feed, streams.FEED)
    df.repartitionByRange(2, "seq").write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(streams.FEED).parquet(str(tmp_path / "feed"))
    streams.stream_upserts(stream, str(tmp_path / "kept"), sources, str(tmp_path / "cp")).awaitTermination()
    streamed = buckets.read_buckets(spark, str(tmp_path / "kept"))
    batch = streams.apply_feed(spark.createDataFrame([], CORPUS), df, sources)
    assert sorted(r.source_id for r in streamed.collect()) == sorted(r.source_id for r in batch.collect()) == [2, 3]
    sinks.truncate_corpus(spark, folder)
    assert sinks.read_corpus(spark, folder).count() == 0


def test_sentence_files_keep_order_and_size(spark, tmp_path):
    records = spark.createDataFrame([(i, [f"文{i}。"] * (i % 4)) for i in range(40)], "id long, sentences array<string>")
    b = {r.id: (r.bucket, r.bytes) for r in sinks.sentence_buckets(records, 60).collect()}
    file, fill = 0, 0
    for i in sorted(b):  # as a writer opens one file after another
        file, fill = (file, fill + b[i][1]) if fill + b[i][1] <= 60 else (file + 1, b[i][1])
        assert b[i][0] == file
    sinks.export_sentences(records, str(tmp_path / "out"), 60)
    assert spark.read.text(str(tmp_path / "out")).where("value <> ''").count() == sum(i % 4 for i in range(40))


def test_contents_and_similar(spark):
    issues = spark.createDataFrame([(1, 5, "犬の話", None, 1), (2, 5, "犬が好き", "about dogs", 1), (3, 6, "猫", "cats", 1)], "id long, project_id long, subject string, description string, status_id long")
    journals = spark.createDataFrame([(2, 1, "Issue", "second"), (1, 1, "Issue", "first"), (3, 1, "Issue", " ")], "id long, journalized_id long, journalized_type string, notes string")
    files = spark.createDataFrame([(1, "Issue", 1, "f.txt", "file"), (2, "Issue", 1, "g.txt", None)], "id long, container_type string, container_id long, filename string, description string")
    df = similar.build_issue_contents(issues, journals, files)
    assert {r.issue_id: r.content for r in df.collect()}[1] == "犬の話\n\nfirst\nsecond\nf.txt\nfile\ng.txt"
    changed = spark.createDataFrame([("Journal", 9, 3, "upsert"), ("Attachment", 1, 2, "upsert")], "entity string, id long, issue_id long, op string")
    fresh = similar.refresh_issue_contents(df, issues, journals.unionByName(spark.createDataFrame([(9, 3, "Issue", "dogs too")], journals.schema)), files, changed)
    assert {r.issue_id: r.content for r in fresh.collect()}[3] == "猫\ncats\ndogs too"
    assert [r.issue_id for r in similar.similar_issues(fresh, 2).collect()] == [3]
    assert [r.issue_id for r in similar.similar_issues(fresh, 2, projects=spark.createDataFrame([(5,)], "project_id long")).collect()] == []


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None)], "id long, embedding array<float>")
    assert [r.id for r in vectors.semantic_search(v, [1.0, 0.0], 2).collect()] == [1, 2] and vectors.semantic_search(v, [], 2).count() == 0
    assert [r.id for r in vectors.semantic_search(v, [1.0, 0.0], 1, F.col("id") > 1).collect()] == [2]
    assert vectors.semantic_search(v, [1.0, 0.0], 1, F.col("id") > 1, post_filter=True).count() == 0
    many = vectors.semantic_search_many(v, v.where("id = 3").withColumnRenamed("id", "query_id"), 1).collect()
    assert [(r.query_id, r.id, r["rank"]) for r in many] == [(3, 2, 1)]


def test_exports(spark):
    df = spark.createDataFrame([("Issue", "ab", "cde"), ("Issue", None, "x"), ("News", "a", "b")], "source_type string, title string, content string")
    assert {r.source_type: r.n_chars for r in exports.char_counts(df).collect()} == {"Issue": 5, "News": 2, None: 7}
    late = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b")], "k long, seq long, v string")
    assert sync.latest_by_key(late, ["k"], [F.col("seq")]).first().v == "c"


def test_upsert_of_equal_times(spark):
    row = lambda i, title, at: (i, "Issue", 1, None, None, None, False, at, at, title, "", [])
    one, two = datetime(2024, 1, 1), datetime(2024, 1, 2)
    corpus = spark.createDataFrame([row(1, "old", one), row(2, "kept", one)], CORPUS)
    changes = [row(1, "a", two), row(1, "b", two), row(1, "c", one), row(3, "d", None), row(3, "e", one)]
    titles = [{r.source_id: r.title for r in sync.upsert(corpus, spark.createDataFrame(some, CORPUS).repartition(n)).collect()} for some, n in ((changes, 1), (changes[::-1], 4))]
    assert titles[0] == titles[1] and titles[0][1] in ("a", "b") and titles[0][2] == "kept" and titles[0][3] == "e"
    assert sync.upsert(corpus, corpus.limit(0)).count() == 2


def test_an_action_log_has_files_by_time_and_none_for_each_user(spark, tmp_path):
    from lodestack.plans.io_queries import log_lines

    events = spark.range(600).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 7 % 601).alias("ts"), (F.col("id") % 300).alias("user_id"), F.when(F.col("id") % 2 == 0, "click").otherwise("view").alias("event_type"), (F.col("id") % 9).cast("double").alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    lines = log_lines(spark, str(tmp_path))
    assert lines.select("file").distinct().count() <= 8
    found = logs.visits(lines)
    assert {(r.user_id, r.search_id, r.search_n, r.n) for r in found.groupBy("user_id", "search_id", "search_n").agg(F.count("*").alias("n")).collect()} == {
        (r.user_id, r.search_id, r.search_n, r.n)
        for r in events.where("event_type = 'click'").groupBy("user_id", (F.col("event_id") % 50).cast("string").alias("search_id"), F.floor("value").alias("search_n")).agg(F.count("*").alias("n")).collect()
    }
