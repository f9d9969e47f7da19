"""Analysis of action logs: extraction, resources, visits, searches, conversions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from lodestack.sources.folders import shared_dir

from lodestack.functions.text import path_extension

SLOW_EXTRACTION, LARGE_DIFF, LARGE_USE = 5.0, 512 << 20, 1 << 30
SLOW_SEARCH, CONVERTING_RANK, CONVERSION_GAP = 1.0, 3, 30


def extraction_stats(records: DataFrame, slow: float = SLOW_EXTRACTION) -> DataFrame:
    """By extension of extracted files (label, path, elapsed): n, n_slow, total, max, min and mean time, the most total first."""
    df = records.where("label = 'Extracted'").withColumn("extension", path_extension("path")).where("extension is not null")
    stats = df.groupBy("extension").agg(
        F.count("*").alias("n"), F.count_if(F.col("elapsed") >= slow).alias("n_slow"), F.sum("elapsed").alias("total"), F.max("elapsed").alias("max"), F.min("elapsed").alias("min"), F.avg("elapsed").alias("mean")
    )
    return stats.orderBy(F.desc("total"), "extension")


def resource_alerts(records: DataFrame, slow: float = SLOW_EXTRACTION, diff: float = LARGE_DIFF, use: float = LARGE_USE) -> DataFrame:
    """(alert, value, target, path): large memory differences and uses and slow records; of repository records only slow ones."""
    extract = F.col("kind") == "text-extract"
    found = F.array_compact(
        F.array(
            F.when(extract & (F.col("memory_diff") >= diff), F.struct(F.lit("large memory diff").alias("alert"), F.col("memory_diff").alias("value"))),
            F.when(extract & (F.col("memory") >= use), F.struct(F.lit("large memory use").alias("alert"), F.col("memory").alias("value"))),
            F.when(F.col("kind").isin("text-extract", "repository-entry") & (F.col("elapsed") >= slow), F.struct(F.lit("slow").alias("alert"), F.col("elapsed").alias("value"))),
        )
    )
    return records.select(F.explode(found).alias("a"), "target", "path").select("a.alert", "a.value", "target", "path")


def extraction_errors(records: DataFrame) -> DataFrame:
    """Failed extractions, but for encrypted files."""
    return records.where("kind = 'text-extract' and lower(label) like 'failed%' and not lower(text) like '%encrypted%'").select("file", "position", "path", "text")


def visits(lines: DataFrame) -> DataFrame:
    """(file, position, user_id, search_id, search_n, timestamp): a request, its parameters and its user, in this order of lines.

    Lines are dealt by ranges, so a large file is worked on by several tasks. What stands before a range's first two lines is carried
    over: at most four lines of a range take part in that, however long the file is.
    """
    spark = lines.sparkSession
    columns = ["kind", "user_id", "search_id", "search_n", "request_at"]
    dealt = lines.where("kind in ('request', 'parameters', 'user')").select("file", "position", *columns).repartitionByRange("file", "position")
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    dealt.withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)

    def with_two_before(df: DataFrame, w: WindowSpec) -> DataFrame:
        before = lambda c, n: F.lag(c, n).over(w)
        return df.select("*", before("kind", 1).alias("k1"), before("kind", 2).alias("k2"), before("search_id", 1).alias("_id"), before("search_n", 1).alias("_n"), before("request_at", 2).alias("timestamp"))

    own = Window.partitionBy("file", "_part")
    numbered = dealt.withColumn("_first", F.row_number().over(own.orderBy("position"))).withColumn("_last", F.row_number().over(own.orderBy(F.desc("position"))))
    inside = with_two_before(numbered, own.orderBy("position")).where("_first > 2")
    edges = with_two_before(numbered.where("_first <= 2 or _last <= 2"), Window.partitionBy("file").orderBy("position")).where("_first <= 2")
    df = inside.unionByName(edges).where("kind = 'user' and k1 = 'parameters' and k2 = 'request'")
    df = df.select("file", "position", "user_id", F.col("_id").alias("search_id"), F.col("_n").alias("search_n"), "timestamp")
    return df.where("search_id is not null and search_n is not null and user_id is not null")


def actions(searches: DataFrame, found: DataFrame) -> DataFrame:
    """One log of searches and visits: user_id, position, is_search, search_id, search_n, timestamp, n_hits, elapsed."""
    s = searches.select("user_id", "position", F.lit(True).alias("is_search"), "search_id", F.lit(None).cast("long").alias("search_n"), "timestamp", "n_hits", F.col("elapsed_time").alias("elapsed"))
    v = found.select("user_id", "position", F.lit(False).alias("is_search"), "search_id", "search_n", "timestamp", F.lit(None).cast("long").alias("n_hits"), F.lit(None).cast("double").alias("elapsed"))
    return s.unionByName(v)


def search_stats(log: DataFrame) -> DataFrame:
    """Per user: searches, visits after the first search, their ratio in per cent, and the searches' times; the most active first."""
    first = log.where("is_search").groupBy("user_id").agg(F.min("position").alias("_first"))
    df = log.join(first, "user_id").where(F.col("is_search") | (F.col("position") > F.col("_first")))
    stats = df.groupBy("user_id").agg(
        F.count_if("is_search").alias("n_searches"), F.count_if(~F.col("is_search")).alias("n_visits"), F.max("elapsed").alias("max"), F.min("elapsed").alias("min"), F.avg("elapsed").alias("mean")
    )
    ratio = (F.col("n_visits") * 100.0 / F.col("n_searches")).alias("visit_ratio")
    return stats.select("user_id", "n_searches", "n_visits", ratio, "max", "min", "mean").orderBy(F.desc(F.col("n_searches") + F.col("n_visits")), "user_id")


def zero_hits(log: DataFrame) -> DataFrame:
    """Per user: searches without hits, and their ratio in per cent."""
    n = log.where("is_search").groupBy("user_id").agg(F.count("*").alias("n_searches"), F.count_if(F.col("n_hits") == 0).alias("n_zero"))
    return n.select("user_id", "n_searches", "n_zero", (F.col("n_zero") * 100.0 / F.col("n_searches")).alias("zero_ratio"))


def slow_searches(searches: DataFrame, slow: float = SLOW_SEARCH) -> DataFrame:
    """(elapsed_time, project, q) of slow searches, the slowest first."""
    project = F.coalesce(F.col("project_id").cast("string"), F.lit("all")).alias("project")
    return searches.where(F.col("elapsed_time") > slow).select("search_id", "elapsed_time", project, "q").orderBy(F.desc("elapsed_time"), "search_id")


def conversions(log: DataFrame, rank: int = CONVERTING_RANK, gap: int = CONVERSION_GAP) -> DataFrame:
    """(user_id, block, search_id, converted): every search of a user with whether it led to a hit.

    It does if the last visit before the next search was to one of the first hits and, unless the log ends there, the next
    search has another search_id than the latest event and comes later than a set time before it.
    """
    by_user = Window.partitionBy("user_id").orderBy("position")
    blocks = log.withColumn("block", F.sum(F.col("is_search").cast("int")).over(by_user.rowsBetween(Window.unboundedPreceding, 0))).where("block > 0")
    event = F.struct("search_id", "timestamp")
    b = blocks.groupBy("user_id", "block").agg(
        F.max(F.when(F.col("is_search"), F.col("search_id"))).alias("search_id"),
        F.max(F.when(F.col("is_search"), F.col("timestamp"))).alias("at"),
        F.max_by(F.when(~F.col("is_search"), F.col("search_n")), F.when(~F.col("is_search"), F.col("position"))).alias("search_n"),
        F.max_by(event, "position").alias("latest"),
    )
    w = Window.partitionBy("user_id").orderBy("block")
    b = b.withColumns({"next_id": F.lead("search_id").over(w), "next_at": F.lead("at").over(w), "is_last": F.lead("block").over(w).isNull()})
    apart = (F.col("next_id") != F.col("latest.search_id")) & (F.col("next_at") + F.expr(f"interval {gap} seconds") > F.col("latest.timestamp"))
    converted = F.coalesce((F.col("search_n") < rank) & (F.col("is_last") | apart), F.lit(False))
    return b.select("user_id", F.col("block").cast("long").alias("block"), "search_id", converted.alias("converted"))
