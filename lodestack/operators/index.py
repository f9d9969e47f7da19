"""A written search index that follows changes, and whole searches on it.

An index is a row of segments in a folder. Each holds postings, sorted by term in parts of some rows each, and its rows, sorted by id,
of which a search reads the narrow columns and the texts of a page. The first segment is a whole corpus. A later one holds rows that changed, and the keys that it takes back from all
segments before it; nothing else is read or written for a change. Merging makes one segment of all, without reading a text again for its words.

A list of the segments is written last, so that readers see whole ones only, and those who read an older state aren't disturbed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestack.operators.corpus import CORPUS, KEY
from lodestack.operators.search import (
    POSTING,
    Result,
    condition,
    dealt_by_text,
    find,
    has_where,
    highlight,
    hit_counts,
    page,
    query_words,
    snippets,
    sort_columns,
    tag_drilldown,
    type_drilldown,
    write_postings,
    write_sorted,
)
from lodestack.operators.visibility import Dims, Request, select_types

TEXTS = ["title", "content"]
NARROW = [c for c in CORPUS.fieldNames() if c not in TEXTS]
#: What each part of a segment holds.
PARTS = {"postings": POSTING, "rows": CORPUS, "taken": StructType([CORPUS[c] for c in KEY])}
SEGMENT = "number long, name string, whole boolean, normalized boolean"
#: Bytes of a row group of rows: a page's rows are found by the ids that each group spans.
GROUP_BYTES = str(4 << 20)


@dataclass
class Index:
    """An index as it was when it was read. keys: the corpus without texts; texts: keys, title and content."""

    postings: DataFrame
    rows: DataFrame
    normalized: bool

    @property
    def keys(self) -> DataFrame:
        return self.rows.select(*NARROW)

    @property
    def texts(self) -> DataFrame:
        return self.rows.select(*KEY, *TEXTS)

    def corpus(self) -> DataFrame:
        return self.rows


def segments(spark: SparkSession, folder: str) -> list:
    """The segments that make up the newest state: the last whole one and those after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/segments")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    rows = sorted(spark.read.schema(SEGMENT).json(f"{folder}/segments").collect())  # a row for each change since the index was first made
    last = max((r["number"] for r in rows if r["whole"]), default=0)
    return [r for r in rows if r["number"] >= last]


def _write_rows(corpus: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes the rows of a segment, all columns at once, and gives them as written."""
    ids, path = ["source_id", "source_type"], f"{folder}/{name}/rows"
    corpus.select(*CORPUS.fieldNames()).repartitionByRange(*ids).sortWithinPartitions(*ids).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return corpus.sparkSession.read.schema(CORPUS).parquet(path)


def _enter(spark: SparkSession, folder: str, name: str, whole: bool, normalized: bool) -> None:
    number = max((r["number"] for r in segments(spark, folder)), default=-1) + 1
    row = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(name).alias("name"), F.lit(whole).alias("whole"), F.lit(normalized).alias("normalized"))
    row.write.mode("append").json(f"{folder}/segments")


def write_index(corpus: DataFrame, folder: str, normalized: bool = True) -> None:
    """Writes the index of a whole corpus, as a new state of the folder's index. normalized false: words meet after NFKC."""
    name = uuid.uuid4().hex
    write_postings(_write_rows(corpus, folder, name), f"{folder}/{name}/postings", normalized)
    _enter(corpus.sparkSession, folder, name, True, normalized)


def change_index(folder: str, fresh: DataFrame, gone: DataFrame | None = None) -> None:
    """Brings the index up to date: fresh are new and changed rows of the corpus, gone the keys of rows that are no more.

    Of several fresh rows with one key all would count: give the last (upsert() and latest_by_key() do).
    """
    spark, name = fresh.sparkSession, uuid.uuid4().hex
    state = segments(spark, folder)
    if not state:
        raise ValueError("there is no index to change")
    fresh = _write_rows(fresh, folder, name)
    taken = fresh.select(*KEY) if gone is None else fresh.select(*KEY).unionByName(gone.select(*KEY))
    taken.distinct().write.parquet(f"{folder}/{name}/taken")
    write_postings(fresh, f"{folder}/{name}/postings", state[0]["normalized"])
    _enter(spark, folder, name, False, state[0]["normalized"])


def read_index(spark: SparkSession, folder: str) -> Index:
    state = segments(spark, folder)
    if not state:
        raise ValueError("there is no index")
    later = state[1:]

    def whole(part: str) -> DataFrame:
        each = [spark.read.schema(PARTS[part]).parquet(f"{folder}/{r['name']}/{part}").withColumn("_segment", F.lit(r["number"])) for r in state]
        df = reduce(DataFrame.unionByName, each)
        if not later:
            return df.drop("_segment")
        taken = [spark.read.schema(PARTS["taken"]).parquet(f"{folder}/{r['name']}/taken").withColumn("_taken", F.lit(r["number"])) for r in later]
        last = reduce(DataFrame.unionByName, taken).groupBy(*KEY).agg(F.max("_taken").alias("_taken"))
        return df.join(last, KEY, "left").where("_taken is null or _segment >= _taken").drop("_segment", "_taken")

    postings = whole("postings").select("term", "field", *KEY, "tf", "positions")
    return Index(postings, whole("rows").select(*CORPUS.fieldNames()), state[0]["normalized"])


def merge_index(spark: SparkSession, folder: str) -> None:
    """One segment in place of all; answers stay the same."""
    now, name = read_index(spark, folder), uuid.uuid4().hex
    rows = _write_rows(now.rows, folder, name)
    write_sorted(now.postings.repartition(dealt_by_text(rows), *KEY), f"{folder}/{name}/postings")
    _enter(spark, folder, name, True, now.normalized)


def search_index(index: Index, request: Request, dims: Dims, tag_dim: DataFrame | None = None, expansions: DataFrame | None = None, keep: bool = True) -> Result:
    """A whole search on an index: what search() gives, but no text is read beyond those of the page.

    Words meet postings, visibility and order the narrow columns. The page's keys (request.limit of them at most, unless all are asked for)
    come to the driver, and their texts are found by the ids that the files' row groups span. close() the result if keep.
    A query with a condition on columns (Where) scans all texts.
    """
    tree = condition(request, expansions)
    if request.nfkc == index.normalized and tree is not None:
        raise ValueError("the index was written for the other normalisation")
    scans = tree is not None and has_where(tree)
    narrow = find(index.corpus() if scans else index.keys, request, dims, expansions, None if scans else index.postings).select(*KEY, "container_type", "project_id", "container_id", "custom_field_id", "last_modified_at", "registered_at", "tags", "score")
    if keep:
        narrow = narrow.persist()
    one = request.project_id is not None
    chosen = select_types(narrow, request.types, one)
    top = page(chosen if request.has_condition() else chosen.limit(0), request)
    if request.limit >= 0:
        rows = top.collect()
        top = narrow.sparkSession.createDataFrame(rows, top.schema)
        texts = index.texts.where(F.col("source_id").isin(sorted({r["source_id"] for r in rows})) & F.col("source_type").isin(sorted({r["source_type"] for r in rows})))
        shown = texts.join(F.broadcast(top), KEY).repartition(1)  # request.limit rows
    else:
        shown = index.texts.join(top, KEY)
    words = query_words(tree)
    shown = snippets(shown, words).withColumn("highlighted", highlight("title", words))
    shown = shown.sortWithinPartitions(*sort_columns(request)) if request.limit >= 0 else shown.orderBy(*sort_columns(request))
    return Result(shown, hit_counts(narrow, request.types, one), type_drilldown(narrow), None if tag_dim is None else tag_drilldown(chosen, tag_dim), narrow if keep else None)
