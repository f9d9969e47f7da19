"""What several of the training-data operators share: reading, cutting lineage, text as bytes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.sources.folders import shared_dir

#: Rows that a Python task turns into one Arrow batch of results.
OUT_ROWS = 20_000
#: A side of a join is broadcast up to this many rows of a few numbers each (some 16 MB).
BROADCAST_ROWS = 500_000


#: Bytes of texts that Spark hands to a Python task at once.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20)


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session hands rows to Python in batches of some BATCH_BYTES unless it has been told otherwise.

    Spark's own bound (ten thousand rows or 64 MB) is held several times over in both processes, which long texts make much of.
    """
    conf = df.sparkSession.conf
    if df.sparkSession.sparkContext.getConf().get(BATCH_SETTING) is None:
        conf.set(BATCH_SETTING, BATCH_BYTES)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def written(df: DataFrame, fmt: str = "parquet", **options: str) -> DataFrame:
    """df written once to the shared folder and read again: lineage ends here, and readers prune its columns."""
    spark = bounded(df).sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than 0x20 and 0x09-0x0D, with A-Z lower-cased; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in a row, as words_of() gives them: XXH64 of the distinct ones, each word's place among
    them, and where each text's words start (and the last's end)."""
    texts = pc.ascii_lower(pc.fill_null(texts, "") if texts.null_count else texts)
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    table = np.fromiter((xxhash.xxh64_intdigest(w, 9) for w in words), np.uint64, len(words))
    indices, ends = coded.indices.to_numpy(), np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy(), dtype=np.int64)))
    if b"" in words:  # white space at either end of a text leaves an empty word
        real = indices != words.index(b"")
        indices, ends = indices[real], np.concatenate(([0], np.cumsum(real)))[ends]
    return table, indices, ends


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the words of all texts in a row, and where each text's start (and the last's end)."""
    table, indices, starts = coded_words(texts)
    return table[indices], starts


def text_batches(batches: Iterable[pa.RecordBatch], step_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about step_bytes, however long its texts are."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * step_bytes / max(batch.nbytes, 1)))
        for i in range(0, n, step):
            yield batch.slice(i, step)
    pa.default_memory_pool().release_unused()  # a worker outlives its task


def named(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, so that further ones of any name don't clash with what an operator adds."""
    return bounded(df).select(*[F.col(f"`{c}`") for c in columns])


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few enough rows; the planner's own choice beyond that."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def without_rows(docs: DataFrame, gone: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """docs without the rows whose numbers gone(numbered docs, name of the number) gives.

    Rows are numbered once and written, so that each is judged by itself, whatever its doc_id and whatever other rows share it.
    """
    number = "_row"
    while number in docs.columns:
        number += "_"
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()))
    return rows.join(small(written(gone(rows, number))), number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex reachable from each of 0..n-1 over the edges (u, v)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while ((jump := new[new]) != new).any():
            new = jump
        if (new == label).all():
            return label
        label = new
