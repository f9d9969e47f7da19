"""Registered queries that write files derived from the driver's tables and read them back, and streams over them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import corpus as c
from lodestack.operators import index, logs, search, similar
from lodestack.operators.visibility import Dims, Request
from lodestack.plans.queries import ESCAPED, HISTORIES, flat_history, has, histories, query, scored
from lodestack.plans.sources import DOCUMENTS, ISSUES, documents, issues, t
from lodestack.sources import buckets, readers, sinks
from lodestack.sources.folders import shared_dir
from lodestack.streaming import streams


def folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


PAIRS_SQL = "SELECT split_part(p_name, ' ', 1) AS source, split_part(p_name, ' ', -1) AS destination, count(*) AS n FROM part GROUP BY 1, 2"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    return t(spark, sf, "part").select(F.element_at(words, 1).alias("source"), F.element_at(words, -1).alias("destination"))


@query(PAIRS_SQL)
def read_expansions_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark) + ".csv"
    pairs(spark, sf).select(F.to_csv(F.struct("source", "destination")).alias("value")).write.text(path)
    return readers.read_expansions(spark, path).groupBy("source", "destination").agg(F.count("*").alias("n"))


@query(PAIRS_SQL)
def read_expansions_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON array for each first letter, of pairs for some and of objects for others."""
    path = folder(spark) + ".json"
    p = pairs(spark, sf).withColumn("k", F.substring("source", 1, 1))
    text = F.when(F.ascii("k") % 2 == 0, F.to_json(F.collect_list(F.array("source", "destination")))).otherwise(F.to_json(F.collect_list(F.struct("source", "destination"))))
    p.groupBy("k").agg(text.alias("value")).select("k", F.concat(F.lit("﻿"), "value").alias("value")).write.partitionBy("k").text(path)
    found = readers.read_expansions(spark, path)
    return found.groupBy("source", "destination").agg(F.count("*").alias("n"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of an action log, which rolls over by time: views are searches, clicks visits, the rest extractions."""
    e = t(spark, sf, "events").select("*", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    body = F.to_json(F.struct((F.col("event_id") % 50).cast("string").alias("search_id"), F.col("props").alias("q"), "user_id", (F.floor("value") % 4).alias("n_hits"), (F.floor("value") % 4).alias("total_n_hits"), (F.col("value") / 100).alias("elapsed_time"), F.col("at").alias("timestamp")))
    record = F.concat(F.lit("[ActiveJob] [Job] [1] [full-text-search][text-extract] "), F.when(F.col("event_type") == "error", "Failed to extract").otherwise("Extracted"), F.lit(": Target: <"), F.col("event_id").cast("string"), F.lit(">: path: </a."), "event_type", F.lit(">: elapsed time: <"), F.col("value").cast("string"), F.lit("s>: memory usage: <1.5GiB>: memory usage diff: <2MiB>"))
    visit = F.concat(F.lit('Started GET "/x" for ::1 at '), "at", F.lit(' +0000\n  Parameters: {"search_id"=>"'), (F.col("event_id") % 50).cast("string"), F.lit('", "search_n"=>"'), (F.floor("value") % 10).cast("string"), F.lit('"}\n  Current user: u (id='), F.col("user_id").cast("string"), F.lit(")"))
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("[full-text-search][search] "), body)).when(F.col("event_type") == "click", visit).otherwise(record)
    path = folder(spark)
    e.select("ts", "event_id", line.alias("value")).repartitionByRange("ts", "event_id").sortWithinPartitions("ts", "event_id").select("value").write.text(path)
    return readers.read_action_log(spark, path)


@query("SELECT CASE event_type WHEN 'view' THEN 'search' WHEN 'click' THEN 'user' ELSE 'text-extract' END AS kind, count(*) AS n, CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN floor(value) % 4 END), 0) AS BIGINT) AS hits, round(coalesce(sum(CASE WHEN event_type NOT IN ('view', 'click') THEN value END), 0), 3) AS elapsed FROM events GROUP BY 1")
def action_log(spark: SparkSession, sf: str) -> DataFrame:
    df = log_lines(spark, sf).where("kind not in ('request', 'parameters')")
    return df.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("search.n_hits"), F.lit(0)).alias("hits"), F.round(F.coalesce(F.sum("elapsed"), F.lit(0.0)), 3).alias("elapsed"))


@query("SELECT user_id, CAST(event_id % 50 AS VARCHAR) AS search_id, CAST(floor(value) AS BIGINT) % 10 AS search_n, CAST(floor(epoch(ts)) AS BIGINT) AS at, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL")
def visits(spark: SparkSession, sf: str) -> DataFrame:
    return logs.visits(log_lines(spark, sf)).groupBy("user_id", "search_id", "search_n", F.unix_timestamp("timestamp").alias("at")).agg(F.count("*").alias("n"))


@query("SELECT '/a.error' AS path, count(*) AS n FROM events WHERE event_type = 'error'")
def extraction_errors(spark: SparkSession, sf: str) -> DataFrame:
    return logs.extraction_errors(log_lines(spark, sf)).groupBy("path").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS source_id, CAST(substr(source, 4) AS BIGINT) AS project_id, CASE WHEN doc_id % 2 = 0 THEN ['label:' || lang] ELSE [] END AS tags FROM documents WHERE doc_id % 3 > 0")
def write_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions after each other, the second made from the first, and in between an empty one elsewhere."""
    path, other = folder(spark), folder(spark)
    sinks.write_corpus(documents(spark, sf), path)
    first = sinks.read_corpus(spark, path)
    sinks.write_corpus(first.where("source_id % 3 > 0").withColumn("tags", F.when(F.col("source_id") % 2 == 0, F.col("tags")).otherwise(F.slice("tags", 1, 0))), path)
    sinks.write_corpus(documents(spark, sf), other)
    sinks.truncate_corpus(spark, other)
    both = sinks.read_corpus(spark, path).unionByName(sinks.read_corpus(spark, other))
    return both.select("source_id", "project_id", F.transform("tags", lambda s: F.concat_ws(":", s["type"], s["name"])).alias("tags"))


@query(
    """WITH RECURSIVE s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents),
r AS MATERIALIZED (SELECT len(lines) AS n, strlen(array_to_string(lines, chr(10))) + 1 AS b, row_number() OVER (ORDER BY doc_id) AS i FROM s WHERE len(lines) > 0),
f AS (SELECT i, n, b, b AS fill, 0 AS bucket FROM r WHERE i = 1 UNION ALL
SELECT r.i, r.n, r.b, CASE WHEN fill + r.b > 65536 THEN r.b ELSE fill + r.b END, CASE WHEN fill + r.b > 65536 THEN bucket + 1 ELSE bucket END FROM f JOIN r ON r.i = f.i + 1)
SELECT bucket, CAST(sum(n) + count(*) - 1 AS BIGINT) AS lines, count(*) - 1 AS blank, CAST(sum(b) + count(*) - 1 AS BIGINT) AS bytes FROM f GROUP BY 1"""
)
def export_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the exported files, by file: documents' lines as sentences."""
    path = folder(spark)
    lines = F.filter(F.split("text", "\n"), lambda s: s != "")
    sinks.export_sentences(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), lines.alias("sentences")), path, 1 << 16)
    out = sinks.read_sentences(spark, path)
    return out.groupBy("bucket").agg(F.count("*").alias("lines"), F.count_if(F.col("value") == "").alias("blank"), F.sum(F.octet_length("value") + 1).alias("bytes"))


@query(HISTORIES)
def export_issue_histories(spark: SparkSession, sf: str) -> DataFrame:
    """The records of the projects' JSON arrays, as read back from the files."""
    path, found = folder(spark), histories(spark, sf)
    sinks.export_issue_histories(found, path, "gzip")
    line = F.regexp_replace("value", r"^[\[,]|\]$", "")
    return flat_history(spark.read.text(path).select("project", F.from_json(line, found.schema["issue"].dataType).alias("issue")))


@query(
    r"""WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+|\p{N}+'))) AS term FROM benchmark), n AS (SELECT item_id, count(*) AS words FROM q GROUP BY 1),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+|\p{N}+')) AS term FROM documents), h AS (SELECT item_id, doc_id FROM d JOIN q USING (term) JOIN n USING (item_id) GROUP BY item_id, doc_id, words HAVING count(*) = words)
SELECT CAST(item_id AS VARCHAR) AS search_id, count(doc_id) FILTER (doc_id % 2 = 0) AS n_hits, count(doc_id) AS total_n_hits FROM n LEFT JOIN h USING (item_id) GROUP BY item_id"""
)
def search_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log that a batch of searches writes, as read from it."""
    path = folder(spark)
    queries = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = search.search_many(documents(spark, sf), queries, None).withColumn("selected", F.col("source_id") % 2 == 0)
    requests = queries.select("query_id", F.col("query_id").cast("string").alias("search_id"), F.col("text").alias("q"), F.lit("all").alias("scope"), F.lit(1).alias("user_id"), F.lit(None).cast("long").alias("project_id"), F.lit(0.5).alias("elapsed_time"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"))
    sinks.write_search_log(hits, requests, path)
    return readers.read_action_log(spark, path).select("search.search_id", "search.n_hits", "search.total_n_hits")


SHOWN = "'<span class=\"keyword\">'"


@query(
    f"""WITH hit AS (SELECT *, p_name LIKE '% ring' OR p_name LIKE 'ring %' AS named, p_type = 'ECONOMY' AS cheap FROM part)
SELECT p_partkey AS id, 'Document: ' || replace(p_name, 'ring', {SHOWN} || 'ring</span>') AS title, 'document' AS type, '/documents/' || p_partkey AS url, {SHOWN} || p_type || '</span>' AS description,
strftime(TIMESTAMP '2024-01-01' + to_minutes(p_partkey), '%Y-%m-%d %H:%M') AS at, CAST(102 AS BIGINT) AS rank, count(*) OVER () AS total_count FROM hit WHERE named AND cheap"""
)
def result_page(spark: SparkSession, sf: str) -> DataFrame:
    """All hits of a search as an API shows them: parts play documents, with a word of the query in the title and one in the short content."""
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("p_partkey") * 60)
    d = c.map_documents(t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit(1).cast("long").alias("project_id"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), at.alias("created_on")))
    request = Request("ring economy", limit=-1)
    found = search.search(d, request, Dims(), keep=False)
    page = sinks.result_page(found.page, ["ring", "economy"], found.counts.first()["n_hits"], request.offset, request.limit)
    return page.select("id", "title", "type", "url", "description", F.date_format("datetime", "yyyy-MM-dd HH:mm").alias("at"), "rank", F.col("total_count").cast("long").alias("total_count"))


@query("SELECT o_orderkey % 100 AS id, CAST(sum(strlen(o_orderpriority) + 1) AS BIGINT) AS n FROM orders GROUP BY 1")
def read_text_files(spark: SparkSession, sf: str) -> DataFrame:
    """All orders, a line each, in a file for each of a hundred groups."""
    path = folder(spark)
    t(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("id"), "o_orderpriority").repartition("id").write.partitionBy("id").text(path)
    files = readers.read_text_files(spark, f"{path}/*/*.txt")
    return files.groupBy(F.regexp_extract("path", "id=([0-9]+)", 1).cast("long").alias("id")).agg(F.sum(F.octet_length("bytes")).cast("long").alias("n"))


def feed_of(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as a feed of changes to orders; every line number over 5 deletes its order."""
    line = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit("Issue").alias("source_type"), F.col("l_orderkey").alias("source_id"), F.when(F.col("l_linenumber") > 5, "delete").otherwise("upsert").alias("op"))


@query(f"WITH {ISSUES}, last AS (SELECT l_orderkey, max(l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT id AS source_id, coalesce(n <= 5, false) AS fresh FROM issues LEFT JOIN last ON l_orderkey = id WHERE (n IS NULL AND id % 2 = 0) OR n <= 5")
def stream_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus after a feed of files, a few at a time; it started with every second order."""
    base = folder(spark)
    i = issues(spark, sf)
    buckets.create_buckets(c.map_issues(i).where("source_id % 2 = 0").withColumn("title", F.lit("old")), f"{base}/corpus", 8)
    feed_of(spark, sf).repartitionByRange(3, "source_id").write.parquet(f"{base}/feed")
    feed = spark.readStream.schema(streams.FEED).option("maxFilesPerTrigger", 2).parquet(f"{base}/feed")
    stream = streams.stream_upserts(feed, f"{base}/corpus", {"Issue": (i, c.map_issues)}, f"{base}/checkpoint")
    stream.awaitTermination()
    return buckets.read_buckets(spark, f"{base}/corpus").select("source_id", (F.col("title") != "old").alias("fresh"))


@query("SELECT conv_id AS issue_id, count(*) FILTER (turn > 0) AS notes FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1")
def stream_issue_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Issue contents after a feed of notes: talks are issues, their later turns notes; odd talks are gone again."""
    base = folder(spark)
    k = t(spark, sf, "conversations")
    now = k.where("turn = 0 and conv_id % 2 = 0").select(F.col("conv_id").alias("id"), F.lit(1).cast("long").alias("project_id"), F.lit("s").alias("subject"), F.lit("d").alias("description"), F.lit(1).alias("status_id"))
    notes = k.where("turn > 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("journalized_id"), F.lit("Issue").alias("journalized_type"), F.lit("note").alias("notes"))
    files = spark.createDataFrame([], "id long, container_type string, container_id long, filename string, description string")
    everything = k.where("turn = 0").select(F.col("conv_id").alias("id"), F.lit(1).cast("long").alias("project_id"), F.lit("s").alias("subject"), F.lit("d").alias("description"), F.lit(1).alias("status_id"))
    similar.build_issue_contents(everything, notes.limit(0), files).write.parquet(f"{base}/v0")
    k.select(F.lit("Journal").alias("entity"), "conv_id", F.col("conv_id").alias("issue_id"), F.lit("upsert").alias("op")).withColumnRenamed("conv_id", "id").repartition(2).write.parquet(f"{base}/feed")
    feed = spark.readStream.schema("entity string, id long, issue_id long, op string").option("maxFilesPerTrigger", 1).parquet(f"{base}/feed")
    version = [0]

    def write(df: DataFrame) -> None:
        df.write.parquet(f"{base}/v{version[0] + 1}")
        version[0] += 1

    stream = streams.stream_issue_contents(feed, lambda: spark.read.parquet(f"{base}/v{version[0]}"), write, lambda: (now, notes, files), f"{base}/checkpoint")
    stream.awaitTermination()
    return spark.read.parquet(f"{base}/v{version[0]}").select("issue_id", (F.size(F.split("content", "note", -1)) - 1).cast("long").alias("notes"))


MARKED = r"(^|[^\p{L}\p{N}\x01\x02])(from|this|the)($|[^\p{L}\p{N}\x01\x02])"  # twice, as neighbours share a separator
EITHER = "len(list_filter({}, lambda x: x IN ('from', 'this')))"
MARK = f", '{MARKED}', chr(92) || '1' || chr(1) || chr(92) || '2' || chr(2) || chr(92) || '3', 'gi')"
ONCE = f"regexp_replace(title{MARK}"


@query(
    f"""WITH {DOCUMENTS} SELECT source_id, CAST({EITHER.format("tt")} * 100 + least({EITHER.format("ct")}, 5) + {scored("the")} + 1 AS BIGINT) AS score,
replace(replace({ESCAPED.format(f"regexp_replace({ONCE}{MARK}")}, chr(1), '<span class="keyword">'), chr(2), '</span>') AS highlighted
FROM tok WHERE lang = 'en' AND project_id < 15 AND {EITHER.format("tt")} + {EITHER.format("ct")} > 0 AND {has("the")} ORDER BY score DESC, source_id DESC LIMIT 20"""
)
def whole_search(spark: SparkSession, sf: str) -> DataFrame:
    """A search from request to page on a written index, with visibility, synonyms and late texts."""
    d, path = documents(spark, sf), folder(spark)
    index.write_index(d, path)
    dims = Dims(visible=d.select("project_id").distinct().where("project_id < 15"))
    pairs = spark.createDataFrame([("this", "this"), ("this", "from")], "source string, destination string")
    request = Request("this the", tags=[("label", "en")], limit=20)
    return index.search_index(index.read_index(spark, path), request, dims, expansions=pairs, keep=False).page.select("source_id", "score", "highlighted")
