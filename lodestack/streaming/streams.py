"""Change feeds: upserts of the corpus and of issue contents, batch by batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack.operators.corpus import CORPUS, KEY
from lodestack.operators.similar import refresh_issue_contents
from lodestack.operators.sync import latest_by_key
from lodestack.sources import buckets
from lodestack.sources.folders import shared_dir

FEED = "seq long, source_type string, source_id long, op string"
Sources = dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]


def fresh_rows(last: DataFrame, sources: Sources, columns: list[str]) -> DataFrame | None:
    """The rows that the upserted keys of last are mapped to now, of all source types together."""
    parts = []
    for source_type, (source, mapper) in sources.items():
        wanted = last.where((F.col("source_type") == source_type) & (F.col("op") == "upsert")).select(F.col("source_id").alias("id"))
        parts.append(mapper(source.join(wanted, "id", "left_semi").select(*source.columns)).select(*columns))
    return reduce(DataFrame.unionByName, parts) if parts else None


def values_inside(corpus: DataFrame, deleted: DataFrame) -> DataFrame:
    """Keys of the custom values of deleted entities; of corpus the keys and containers of its custom values are read."""
    inside = deleted.select(F.col("source_type").alias("container_type"), F.col("source_id").alias("container_id"))
    return corpus.where("source_type = 'CustomValue'").select(*KEY, "container_type", "container_id").join(inside, ["container_type", "container_id"], "left_semi").select(*KEY)


def apply_feed(corpus: DataFrame, feed: DataFrame, sources: Sources) -> DataFrame:
    """The corpus after a feed (seq, source_type, source_id, op): of several changes of a key the last counts.

    An upsert whose source row is gone drops nothing and adds nothing; a delete takes custom values along.
    """
    last = latest_by_key(feed.select("seq", *KEY, "op"), KEY, [F.col("seq")])
    fresh = fresh_rows(last, sources, corpus.columns)
    deleted = last.where("op = 'delete'").select(*KEY)
    gone = deleted.unionByName(values_inside(corpus, deleted))
    gone = gone if fresh is None else gone.unionByName(fresh.select(*KEY))
    kept = corpus.join(gone.distinct(), KEY, "left_anti").select(*corpus.columns)
    return kept if fresh is None else kept.unionByName(fresh)


def apply_batch(batch: DataFrame, folder: str, sources: Sources) -> list[int]:
    """Applies a batch of a feed to the corpus kept in buckets in folder; the buckets that were written anew.

    Only buckets with a key that changes are read whole and written; of the others, if something is deleted, the keys of custom values are looked at.
    """
    spark, base = batch.sparkSession, f"{shared_dir(batch.sparkSession)}/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    last = kept(latest_by_key(batch.select("seq", *KEY, "op"), KEY, [F.col("seq")]), "last")
    deleted = last.where("op = 'delete'").select(*KEY)
    gone = deleted
    if not deleted.isEmpty():
        gone = gone.unionByName(values_inside(buckets.read_buckets(spark, folder), deleted))
    fresh = fresh_rows(last, sources, CORPUS.fieldNames())
    if fresh is not None:
        fresh = kept(fresh, "fresh")
        gone = gone.unionByName(fresh.select(*KEY))
    gone = kept(gone.distinct(), "gone")
    touched = buckets.buckets_of(gone, buckets.count(spark, folder))
    if touched:
        rest = buckets.read_buckets(spark, folder, touched).join(gone, KEY, "left_anti").select(*CORPUS.fieldNames())
        buckets.replace_buckets(spark, folder, rest if fresh is None else rest.unionByName(fresh), touched)
    return touched


def stream_upserts(feed: DataFrame, folder: str, sources: Sources, checkpoint: str) -> StreamingQuery:
    """Applies a streaming feed to the corpus kept in buckets in folder (an empty one is made if there is none): a batch rewrites the buckets of its keys.

    A batch that is run again after a failure gives the same corpus: applying changes twice changes nothing.
    """

    if not buckets.exists(feed.sparkSession, folder):
        buckets.create_buckets(feed.sparkSession.createDataFrame([], CORPUS), folder)

    def run(batch: DataFrame, _: int) -> None:
        apply_batch(batch, folder, sources)

    return feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_issue_contents(feed: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], checkpoint: str) -> StreamingQuery:
    """Applies a streaming feed (entity, id, issue_id, op) to issue contents; tables gives issues, journals and attachments as they are now."""

    def run(batch: DataFrame, _: int) -> None:
        write(refresh_issue_contents(read(), *tables(), batch))

    return feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
