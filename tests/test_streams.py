import random
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from lodestack.operators import corpus as c
from lodestack.operators import logs
from lodestack.operators.corpus import CORPUS
from lodestack.sources import buckets
from lodestack.streaming import streams

T = datetime(2024, 1, 1)


def row(i, kind="Document", title="old", container=None):
    given = {"source_id": i, "source_type": kind, "project_id": 1, "title": title, "container_type": container and container[0], "container_id": container and container[1], "tags": []}
    return tuple(given.get(n) for n in CORPUS.fieldNames())


def titles(df):
    return sorted((r.source_type, r.source_id, r.title) for r in df.collect())


def versions(folder):
    return {p.name: {b.name for b in p.glob("bucket=*")} for p in Path(folder).iterdir() if p.name != "states" and p.is_dir()}


def test_a_batch_rewrites_the_buckets_of_its_keys(spark, tmp_path):
    folder = str(tmp_path / "kept")
    rows = [row(i) for i in range(200)] + [row(1000 + i, "CustomValue", "v", ("Document", i % 50)) for i in range(100)]
    corpus = spark.createDataFrame(rows, CORPUS)
    buckets.create_buckets(corpus, folder, 16)
    source = spark.createDataFrame([(i, 1, "d", "new", T) for i in range(150)], "id long, project_id long, description string, title string, created_on timestamp")
    sources = {"Document": (source, c.map_documents)}
    before = versions(folder)
    feed = lambda *x: spark.createDataFrame(list(x), streams.FEED)
    one = feed((1, "Document", 7, "upsert"))
    assert len(streams.apply_batch(one, folder, sources)) == 1
    (name,) = set(versions(folder)) - set(before)
    assert len(versions(folder)[name]) == 1
    want = titles(streams.apply_feed(corpus, one, sources))
    assert titles(buckets.read_buckets(spark, folder)) == want and ("Document", 7, "new") in want and ("Document", 8, "old") in want
    streams.apply_batch(one, folder, sources)  # as after a failure
    assert titles(buckets.read_buckets(spark, folder)) == want
    assert streams.apply_batch(feed((1, "Document", 190, "upsert")), folder, sources) == []  # its source row is gone
    assert titles(buckets.read_buckets(spark, folder)) == want
    some = feed((1, "Document", 3, "delete"), (2, "Document", 4, "upsert"), (1, "Document", 4, "delete"), (3, "Document", 9, "delete"), (4, "Document", 9, "upsert"))
    now = buckets.read_buckets(spark, folder)
    want = titles(streams.apply_feed(now, some, sources))
    touched = streams.apply_batch(some, folder, sources)
    assert titles(buckets.read_buckets(spark, folder)) == want and 1 <= len(touched) <= 5
    assert not [r for r in want if r[0] == "CustomValue" and (r[1] - 1000) % 50 == 3] and ("Document", 4, "new") in want


def test_old_versions_go_and_the_state_being_read_stays(spark, tmp_path):
    folder = str(tmp_path / "kept")
    buckets.create_buckets(spark.createDataFrame([row(i) for i in range(40)], CORPUS), folder, 4)
    reading = buckets.read_buckets(spark, folder)
    sources = {"Document": (spark.createDataFrame([(i, 1, "d", f"n{i}", T) for i in range(40)], "id long, project_id long, description string, title string, created_on timestamp"), c.map_documents)}
    for step in range(5):
        streams.apply_batch(spark.createDataFrame([(1, "Document", 5, "upsert")], streams.FEED), folder, sources)
        if step == 0:
            assert reading.count() == 40
    hot = buckets.buckets_of(spark.createDataFrame([("Document", 5)], "source_type string, source_id long"), 4)[0]
    assert sum(f"bucket={hot}" in v for v in versions(folder).values()) <= 3
    assert buckets.read_buckets(spark, folder).count() == 40
    every = spark.createDataFrame([(1, "Document", i, "delete") for i in range(40)], streams.FEED)
    streams.apply_batch(every, folder, sources)
    assert buckets.read_buckets(spark, folder).count() == 0
    streams.apply_batch(spark.createDataFrame([(1, "Document", 5, "upsert")], streams.FEED), folder, sources)
    assert [r.title for r in buckets.read_buckets(spark, folder).collect()] == ["n5"]


def test_visits_are_the_same_wherever_a_file_is_cut(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for file in ("a", "b", "c"):
        kinds = [rng.choice(["request", "parameters", "user", "search", "request parameters user"]) for _ in range(300)]
        lines = [k for kind in kinds for k in kind.split()]
        told = [(file, {"block": n // 50, "line": n}, k, 7 if k == "user" else None, f"s{n}" if k == "parameters" and n % 7 else None, n if k == "parameters" else None, datetime(2024, 1, 1, 0, n // 60 % 60, n % 60) if k == "request" else None) for n, k in enumerate(lines)]
        real = [x for x in told if x[2] != "search"]
        for x, y, z in zip(real, real[1:], real[2:], strict=False):
            if (x[2], y[2], z[2]) == ("request", "parameters", "user") and y[4]:
                want.add((file, z[1]["line"], 7, y[4], y[5], x[6]))
        rows += told
    schema = "file string, position struct<block:long,line:long>, kind string, user_id long, search_id string, search_n long, request_at timestamp"
    df = spark.createDataFrame(rows, schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for parts in ("1", "7", "300"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {(r.file, r.position.line, r.user_id, r.search_id, r.search_n, r.timestamp) for r in logs.visits(df.repartition(5)).collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(want) > 50 and logs.visits(df.where(F.lit(False))).count() == 0


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    rows = c.row(spark.range(20_000), "Issue", source_id="id", content=F.concat(F.sha2(F.col("id").cast("string"), 512), F.sha2((-F.col("id")).cast("string"), 512)))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        buckets.create_buckets(rows.repartition(8), str(tmp_path / "b"), 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list((tmp_path / "b").glob("*/bucket=0/part-*"))) > 1
    assert buckets.read_buckets(spark, str(tmp_path / "b")).select("source_id").distinct().count() == 20_000
