"""Sources: synonym files, action logs, attachment bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import parse_elapsed, parse_size

PAIR = "source string, destination string"
#: What lines of the log start with (written by sinks.write_search_log, too).
JOB_MARK = r"^\[ActiveJob\] \[[^\]]*\] \[[^\]]*\] "
LINE_MARK = r"^\[full-text-search\]\[([a-z-]+)\] "


def read_expansions(spark: SparkSession, path: str) -> DataFrame:
    """(source, destination) of a synonym file: CSV without a header, or a JSON array of pairs or of objects.

    The format is that of the extension, else JSON where the text starts with a bracket. A byte order mark is skipped.
    """
    lowered = path.lower()
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\\uFEFF", "").alias("value"))
    if lowered.endswith(".json"):
        as_json = True
    elif lowered.endswith(".csv"):
        as_json = False
    else:
        as_json = not whole.where(F.ltrim("value").startswith("[")).isEmpty()
    if not as_json:  # a quoted field may hold line breaks
        records = spark.read.schema(PAIR).options(multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        bare = F.regexp_replace("source", "^\\uFEFF", "")
        return records.select(bare.alias("source"), "destination").where("trim(source) <> '' or destination is not null")
    pairs = F.transform(F.from_json("value", "array<array<string>>"), lambda p: F.struct(F.get(p, F.lit(0)).alias("source"), F.get(p, F.lit(1)).alias("destination")))
    objects = F.from_json("value", "array<struct<source:string,destination:string>>")
    is_pairs = F.col("value").rlike(r"^\s*\[\s*\[")
    return whole.select(F.explode(F.when(is_pairs, pairs).otherwise(objects)).alias("p")).select("p.*")


SEARCH = "search_id string, q string, scope string, user_id long, project_id long, n_hits long, total_n_hits long, elapsed_time double, timestamp timestamp"


def read_action_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an action log, classified: file, position, kind, label, path, target, elapsed, memory, memory_diff, search, request_at, search_id, search_n, user_id.

    kind is search, text-extract, repository-entry, request, parameters or user; other lines are left out. (file, position) is the
    order of lines: it is taken before anything is shuffled.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("position"), "value")
    return parse_action_log(lines)


def parse_action_log(lines: DataFrame) -> DataFrame:
    """The same for a DataFrame of lines (file, position, value)."""
    text = F.regexp_replace(F.call_function("make_valid_utf8", F.col("value")), JOB_MARK, "")
    df = lines.withColumn("value", text)
    mark = F.regexp_extract("value", LINE_MARK, 1)
    kind = (
        F.when(mark != "", mark)
        .when(F.col("value").startswith("Started "), "request")
        .when(F.col("value").rlike(r"^\s*Parameters: "), "parameters")
        .when(F.col("value").rlike(r"^\s*Current user: "), "user")
    )
    body = F.regexp_replace("value", LINE_MARK, "")
    field = lambda name: F.nullif(F.regexp_extract(body, rf"(?:^|: ){name}: <([^>]*)>", 1), F.lit(""))
    is_record = kind.isin("text-extract", "repository-entry")
    parameter = lambda name: F.nullif(F.regexp_extract("value", rf'"{name}"\s*=>\s*"?([^",}}]*)', 1), F.lit(""))
    return (
        df.withColumn("kind", kind)
        .where("kind is not null")
        .select(
            "file",
            "position",
            "kind",
            F.when(is_record, F.regexp_extract(body, r"^([^:]+):", 1)).alias("label"),
            F.when(is_record, field("path")).alias("path"),
            F.when(is_record, F.nullif(F.regexp_extract(body, r"Target: <([^>]*)>", 1), F.lit(""))).alias("target"),
            F.when(is_record, parse_elapsed(field("elapsed time"))).alias("elapsed"),
            F.when(is_record, parse_size(field("memory usage"))).alias("memory"),
            F.when(is_record, parse_size(field("memory usage diff"))).alias("memory_diff"),
            F.when(kind == "search", F.from_json(body, SEARCH)).alias("search"),
            F.when(kind == "request", F.regexp_extract("value", r" at ([0-9-]+ [0-9:.]+(?: [+-][0-9]{4})?)\s*$", 1).try_cast("timestamp")).alias("request_at"),
            F.when(kind == "parameters", parameter("search_id")).alias("search_id"),
            F.when(kind == "parameters", parameter("search_n").try_cast("long")).alias("search_n"),
            F.when(kind == "user", F.regexp_extract("value", r"\(id=([0-9]+)\)", 1).try_cast("long")).alias("user_id"),
            body.alias("text"),
        )
    )


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of attachment files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("bytes"))
