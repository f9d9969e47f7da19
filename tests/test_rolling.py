import pathlib
import random
import tempfile

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.sources import rolling, sinks


def loop(sizes, cap):
    """The file of each record, one after another."""
    files, fill, number = [], None, -1
    for b in sizes:
        if fill is None or fill + b > cap:
            number, fill = number + 1, 0
        fill += b
        files.append(number)
    return files, fill


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(1, 40), st.data())
def test_tables_and_their_composition_equal_the_loop(sizes, cap, data):
    cut = data.draw(st.integers(0, len(sizes)))
    parts = [p for p in (sizes[:cut], sizes[cut:]) if p]
    tables = [rolling.table_of(np.array(p), cap) for p in parts]
    whole = rolling.composed(tables[0], tables[1]) if len(tables) == 2 else tables[0]
    for table in (rolling.table_of(np.array(sizes), cap), whole):
        assert table["lo"].iat[0] == -1 and table["hi"].iat[-1] == rolling.NONE_OPEN and (table["lo"].iloc[1:].to_numpy() == table["hi"].iloc[:-1].to_numpy()).all()
        for fill in [*range(1, cap + 3), rolling.NONE_OPEN]:
            opened, last = (int(v[0]) for v in rolling.after(table, np.array([fill])))
            files, end = loop(sizes, cap) if fill == rolling.NONE_OPEN else loop([fill, *sizes], cap)
            assert opened == files[-1] + (fill == rolling.NONE_OPEN) and last == end


def test_tables_of_many_equal_records_merge():
    table = rolling.table_of(np.full(100_000, 7), 10_000)
    assert len(table) <= 10_000 // 7 + 2
    assert len(rolling.table_of(np.array([5000] * 50), 10_000)) <= 3


def test_files_equal_the_loop(spark):
    rng = random.Random(8)
    for n, cap, parts in ((1, 10, 2), (3000, 700, 7), (3000, 5_000, 40), (2000, 10**9, 5), (500, 1, 3)):
        sizes = [rng.choice([1, 3, rng.randrange(1, 400), rng.randrange(1, 40)]) for _ in range(n)]
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        df = spark.createDataFrame(list(enumerate(sizes)), "id long, n long").repartition(3)
        for gap in (0, 1):
            got = rolling.rolled(df, ["id"], F.col("n"), cap, gap).orderBy("id").collect()
            want, _ = loop([b + gap for b in sizes], cap + gap)
            assert [r._file for r in got] == want
            assert [r._first for r in got] == [i == 0 or want[i] != want[i - 1] for i in range(n)]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rolling.rolled(df.limit(0), ["id"], F.col("n"), 10).count() == 0


def test_exported_files_hold_what_a_writer_would_have_written(spark):
    rng = random.Random(9)
    rows = [(i % 700, ["Issue", "Journal"][i // 700], [f"sentence {rng.randrange(10**rng.randrange(1, 9))}。" for _ in range(rng.randrange(4))]) for i in range(1400)]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/out"
    sinks.export_sentences(spark.createDataFrame(rows, "id long, source_type string, sentences array<string>"), folder, 2000)
    kept = sorted((i, k, s) for i, k, s in rows if s)
    files, _ = loop([sum(len(x.encode()) + 1 for x in s) for *_, s in kept], 2000)
    want = pd.DataFrame({"file": files, "text": ["\n".join(s) + "\n" for *_, s in kept]}).groupby("file")["text"].apply("\n".join).to_dict()
    got = {}
    for r in spark.read.text(folder, wholetext=True).collect():
        got[r.bucket] = r.value
    assert got == want and len(want) > 10


def test_edges(spark):
    rows = [(1, None), (2, []), (3, ["x" * 50]), (4, ["a"]), (4, ["a"]), (None, ["b", None])]
    df = spark.createDataFrame(rows, "id long, sentences array<string>").withColumn("bytes", F.lit("clash"))
    got = sorted((str(r.id), r.text, r.bucket) for r in sinks.sentence_buckets(df, 10).collect())
    assert got == [("3", "x" * 50, 1), ("4", "a", 2), ("4", "a", 2), ("None", "b", 0)]


def test_many_exported_files_are_listed_by_few_tasks(spark):
    df = spark.range(300).select("id", F.array(F.lit("x" * 50)).alias("sentences"))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/out"
    sinks.export_sentences(df, folder, 60)
    assert not list(pathlib.Path(folder).rglob("bucket=*/*.crc"))
    spark.sparkContext.setJobGroup("listing", "listing")
    lines = sinks.read_sentences(spark, folder)
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and all(tracker.getStageInfo(s).numTasks <= 4 * spark.sparkContext.defaultParallelism for s in stages)
    assert lines.where("value <> ''").count() == 300 and spark.conf.get(sinks.LISTING, None) in (None, "10000")
