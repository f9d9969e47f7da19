"""A corpus kept in buckets by key, so that a change rewrites the buckets of its keys alone.

Each write makes a folder with the buckets that it replaces. A list, written last, says which; a bucket's newest folder counts. A state that is
being read stays: what a write replaces is removed by the write after the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.corpus import CORPUS, KEY

BUCKETS = 64
STATE = "number long, name string, buckets int, touched array<int>, filled array<int>"


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/states")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _states(spark: SparkSession, folder: str) -> list:
    if not exists(spark, folder):
        raise ValueError(f"there are no buckets in {folder}")
    return sorted(spark.read.schema(STATE).json(f"{folder}/states").collect())  # a row for each write


def _newest(states: list) -> dict[int, str | None]:
    """The name of each bucket's newest folder; None where it is empty now."""
    found: dict[int, str | None] = {}
    for r in states:
        found |= {b: r["name"] if b in r["filled"] else None for b in r["touched"]}
    return found


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def buckets_of(keys: DataFrame, buckets: int) -> list[int]:
    """The buckets that keys fall into, at most all."""
    return sorted(r[0] for r in keys.select(bucket_of(buckets)).distinct().collect())


def count(spark: SparkSession, folder: str) -> int:
    return _states(spark, folder)[0]["buckets"]


def _write(rows: DataFrame, folder: str, number: int, buckets: int, touched: list[int]) -> None:
    spark, name = rows.sparkSession, uuid.uuid4().hex
    dealt = rows.select(*CORPUS.fieldNames(), bucket_of(buckets).alias("bucket")).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *KEY)  # a large bucket is written by several tasks
    dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{folder}/{name}")
    at = spark.read.schema(f"bucket int, {KEY[1]} long").parquet(f"{folder}/{name}")
    filled = sorted(r[0] for r in at.select("bucket").distinct().collect())
    ints = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    row = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(name).alias("name"), F.lit(buckets).alias("buckets"), ints(touched).alias("touched"), ints(filled).alias("filled"))
    row.write.mode("append").json(f"{folder}/states")


def create_buckets(corpus: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Writes a corpus in buckets. A bucket should be some hundred megabytes: it is what a change of one key rewrites."""
    _write(corpus, folder, 0, buckets, list(range(buckets)))


def read_buckets(spark: SparkSession, folder: str, only: list[int] | None = None) -> DataFrame:
    """The corpus as it is now, or those of its buckets."""
    newest = _newest(_states(spark, folder))
    paths = [f"{folder}/{name}/bucket={b}" for b, name in sorted(newest.items()) if name is not None and (only is None or b in only)]
    return spark.read.schema(CORPUS).parquet(*paths) if paths else spark.createDataFrame([], CORPUS)


def replace_buckets(spark: SparkSession, folder: str, rows: DataFrame, touched: list[int]) -> None:
    """Puts rows, all of these buckets, in their place, and removes what only the state before the present one needed."""
    states = _states(spark, folder)
    stale = {(b, n) for b, n in _names(states) if n not in (_newest(states).get(b), _newest(states[:-1]).get(b))}
    _write(rows, folder, states[-1]["number"] + 1, states[0]["buckets"], touched)
    for b, name in sorted(stale):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/bucket={b}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _names(states: list) -> set[tuple[int, str]]:
    return {(b, r["name"]) for r in states for b in r["filled"]}
