"""Sinks: versioned corpus snapshots, sentence files, histories, search logs, result pages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.corpus import CORPUS, event_title, event_type, event_url
from lodestack.operators.search import highlight
from lodestack.sources.folders import shared_dir
from lodestack.sources.rolling import rolled


def current(spark: SparkSession, folder: str) -> str | None:
    """The folder of the newest version: the name in the last pointer written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    last = spark.read.schema("name string, number long").json(f"{folder}/versions").orderBy(F.desc("number")).first()
    return None if last is None else f"{folder}/{last['name']}"


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    at = current(spark, folder)
    return spark.createDataFrame([], CORPUS) if at is None else spark.read.schema(CORPUS).parquet(at).select(*CORPUS.fieldNames())


def write_corpus(df: DataFrame, folder: str) -> str:
    """Writes df as the newest version of the corpus, by source type; readers of older versions aren't disturbed."""
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.partitionBy("source_type").option("compression", "zstd").parquet(f"{folder}/{name}")
    number = 0 if current(spark, folder) is None else spark.read.schema("name string, number long").json(f"{folder}/versions").agg(F.max("number")).first()[0] + 1
    spark.range(1).select(F.lit(name).alias("name"), F.lit(number).alias("number")).write.mode("append").json(f"{folder}/versions")
    return f"{folder}/{name}"


def truncate_corpus(spark: SparkSession, folder: str) -> None:
    """An empty newest version."""
    name, number = f"v-{uuid.uuid4().hex}", 0
    if current(spark, folder) is not None:
        number = spark.read.schema("name string, number long").json(f"{folder}/versions").agg(F.max("number")).first()[0] + 1
    spark.createDataFrame([], CORPUS).write.parquet(f"{folder}/{name}")
    spark.range(1).select(F.lit(name).alias("name"), F.lit(number).alias("number")).write.mode("append").json(f"{folder}/versions")


def sentence_buckets(records: DataFrame, max_bytes: int) -> DataFrame:
    """records (id, sentences, perhaps source_type) with their text, the number of the file each goes to, and whether it is the first there.

    Records come by id, then source type. A file takes records while their sentences, a line each, come to max_bytes at most; a larger
    record has a file of its own. Records without sentences are left out.
    """
    keys = [k for k in ("id", "source_type") if k in records.columns]
    body = F.array_join("sentences", "\n")
    sized = records.where("size(sentences) > 0").select(*keys, body.alias("text"), (F.octet_length(body) + 1).cast("long").alias("bytes"))
    placed = rolled(sized.withColumn("_mark", F.xxhash64("text")), [*keys, "_mark"], F.col("bytes"), max_bytes)
    return placed.select(*keys, "text", "bytes", F.col("_file").alias("bucket"), F.col("_first").alias("first"))


#: Hadoop's options for files without a checksum file on local disks: where its native library lacks, each file made costs a process.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Spark's bound on the tasks that list folders, and how many of them each core gets here.
LISTING, LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4


def export_sentences(records: DataFrame, folder: str, max_bytes: int = 100 << 20) -> None:
    """Writes records (id, sentences, perhaps source_type) as text files, a folder each, that roll over at max_bytes; a blank line between records.

    As sentence_buckets() counts them: the blank lines are not part of a file's size. On local disks no checksum files stand beside them.
    """
    keys = [k for k in ("id", "source_type") if k in records.columns]
    out = sentence_buckets(records, max_bytes).withColumn("text", F.when(F.col("first"), F.col("text")).otherwise(F.concat(F.lit("\n"), "text")))
    ordered = out.repartition("bucket").sortWithinPartitions("bucket", F.desc("first"), *keys, F.xxhash64(F.ltrim("text")))
    ordered.select("text", "bucket").write.options(**PLAIN_FILES).partitionBy("bucket").text(folder)


def read_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """(value, bucket): the lines of files that export_sentences() wrote, blank ones too.

    Spark lists a table's folders in a task each, up to ten thousand, which takes longer than the listing; here some folders share a task.
    """
    before = spark.conf.get(LISTING, None)
    spark.conf.set(LISTING, str(LISTING_TASKS * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.option("lineSep", "\n").schema("value string, bucket int").text(folder)
    finally:
        spark.conf.unset(LISTING) if before is None else spark.conf.set(LISTING, before)


#: Projects' first and last issues are broadcast up to so many.
BROADCAST_PROJECTS = 200_000


def export_issue_histories(histories: DataFrame, folder: str, compression: str = "none") -> None:
    """Writes nested histories (project, issue) as one JSON array for each project, an issue a line, by the issues' ids.

    A project's array is what the files in its folder hold, put together in the order of their names: a project of very many issues is
    written by several tasks. Nulls have no entry. Rows without a project go to the folder of a null project. compression is that of the files.
    """
    spark, path = histories.sparkSession, f"{shared_dir(histories.sparkSession)}/{uuid.uuid4().hex}"
    histories.select("project", F.col("issue.id").alias("id"), F.to_json("issue", {"ignoreNullFields": "true"}).alias("line")).write.option("compression", "zstd").parquet(path)
    lines = spark.read.parquet(path).withColumn("mark", F.xxhash64("line"))
    place = F.struct("id", "mark")
    ends = lines.groupBy("project").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    ends = F.broadcast(ends) if ends.limit(BROADCAST_PROJECTS + 1).count() <= BROADCAST_PROJECTS else ends
    marked = lines.join(ends.withColumnRenamed("project", "_project"), F.col("project").eqNullSafe(F.col("_project"))).select("project", "id", "mark", "line", (place == F.col("first")).alias("is_first"), (place == F.col("last")).alias("is_last"))
    text = F.concat(F.when(F.col("is_first"), "[").otherwise(","), "line", F.when(F.col("is_last"), "]").otherwise(""))
    ordered = marked.repartitionByRange("project", "id", "mark").sortWithinPartitions("project", "id", "mark")
    ordered.select(text.alias("text"), "project").write.partitionBy("project").option("compression", compression).text(folder)


def search_log(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """A row for every request (query_id, search_id, q, scope, user_id, project_id, elapsed_time, timestamp) with its counts of hits (query_id, selected)."""
    n = hits.groupBy("query_id").agg(F.count_if("selected").alias("n_hits"), F.count("*").alias("total_n_hits"))
    return requests.join(n, "query_id", "left").fillna(0, ["n_hits", "total_n_hits"]).select("search_id", "q", "scope", "user_id", "project_id", "n_hits", "total_n_hits", "elapsed_time", "timestamp")


def write_search_log(hits: DataFrame, requests: DataFrame, folder: str) -> None:
    """Appends a line for every request, in the format that read_action_log reads."""
    log = search_log(hits, requests)
    body = F.to_json(F.struct(*log.columns))
    log.select(F.concat(F.lit("[full-text-search][search] "), body).alias("value")).write.mode("append").text(folder)


def result_page(page: DataFrame, words: list[str], total: int, offset: int, limit: int, search_id: str | None = None, index: Column | None = None) -> DataFrame:
    """A page of hits as an API shows it: id, title, type, url, description, times, rank, and the page's own numbers."""
    return page.select(
        F.col("source_id").alias("id"),
        highlight(event_title(page), words).alias("title"),
        event_type(page).alias("type"),
        event_url(page, search_id, offset, index).alias("url"),
        F.array_join("snippets", "\n").alias("description"),
        F.col("last_modified_at").alias("datetime"),
        "last_modified_at",
        "registered_at",
        F.col("score").alias("rank"),
        F.lit(total).alias("total_count"),
        F.lit(offset).alias("offset"),
        F.lit(limit).alias("limit"),
    )
