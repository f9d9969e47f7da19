"""Token ids of whole texts, and their file format: ORC with integer run-length encoding and Bloom filters."""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.common import named, shared_dir, small, table, text_batches

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Units of one generation that a worker remembers, the longest of them in bytes, and how many are learnt at a time.
KNOWN_UNITS, KNOWN_BYTES, LEARNT = 100_000, 64, 20_000
#: Latin letters and ASCII punctuation (without the apostrophe, which starts contractions).
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
PLAIN = f"^[{LETTERS}]*[{MARKS}]*$"
LETTER_CHARS = "".join(c for c in map(chr, range(33, 256)) if re.fullmatch(f"[{LETTERS}]", c))
MARK_CHARS = "".join(c for c in map(chr, range(33, 127)) if re.fullmatch(f"[{MARKS}]", c))


def lists(values: list[bytes]) -> pa.ListArray:
    """Lists of ids from their bytes."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]) // 4, pa.int32()), pa.array(np.frombuffer(b"".join(values), "<i4")))


def laid_out(table: pa.ListArray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists at these places one after another, and where each starts (and the last ends)."""
    taken = table.take(pa.array(places))
    return taken.flatten().to_numpy(), np.concatenate(([0], np.cumsum(taken.value_lengths().to_numpy(), dtype=np.int64)))


def as_list(strings: pa.Array) -> list[str]:
    """to_pylist() by way of numpy, which is many times faster."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Encodes texts word by word with a tokenizer that drops white space and never looks across it.

    A batch's texts are split into words, and only its distinct words are worked on. A word of letters and then marks is two
    units (the letters in lower case, the marks), which is what the tokenizer's own splitting would give. Units that the worker
    doesn't remember go to the tokenizer's model many at a time; as it marks the last token of each, they are told apart again.
    All other words are a unit each and go through the whole tokenizer. The memory has two generations: when the younger is
    full it becomes the older, and units of the older that occur move on.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        chars = [c for c in map(chr, range(33, 256)) if re.fullmatch(f"[{LETTERS}{MARKS}]", c)]
        self.form = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(c))[0][0] for c in chars})
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def learn(self, units: list[str], plain: bool) -> None:
        for i in range(0, len(units), LEARNT):
            some = units[i : i + LEARNT]
            if plain:
                ids = np.array(self.model.encode_batch_fast([" ".join(some).translate(self.form)], add_special_tokens=False)[0].ids, "<u4")
                data, ends = ids.tobytes(), (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
                self.known.update((u, data[a:b]) for u, a, b in zip(some, [0, *ends], ends, strict=False))
            else:
                found = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
                self.known.update((u, np.array(e.ids, "<u4").tobytes()) for u, e in zip(some, found, strict=True))

    def ids_of(self, units: list[str], plain: bool) -> list[bytes]:
        """The ids of distinct units, learnt where they aren't remembered. Plain and other units have nothing in common but "" ."""
        ids = list(map(self.known.get, units))
        if None in ids:
            gaps = [i for i, x in enumerate(ids) if x is None]
            old = {u: x for i in gaps if (x := self.older.get(u := units[i])) is not None}
            self.known.update(old)
            self.learn([u for i in gaps if (u := units[i]) not in old], plain)
            for i in gaps:
                ids[i] = self.known[units[i]] if len(units[i]) <= KNOWN_BYTES else self.known.pop(units[i])
        return ids

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by the id end, and where each text starts (and the last ends); null counts as empty."""
        if len(self.known) > KNOWN_UNITS:
            self.older, self.known = self.known, {"": b""}
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "") if texts.null_count else texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring_regex(words, PLAIN)
        simple, others = words.filter(plain), as_list(words.filter(pc.invert(plain)))
        letters = pc.utf8_lower(pc.ascii_rtrim(simple, MARK_CHARS)).dictionary_encode()
        marks = pc.utf8_ltrim(simple, LETTER_CHARS).dictionary_encode()
        units = [*self.ids_of(as_list(letters.dictionary), True), *self.ids_of(as_list(marks.dictionary), True), *self.ids_of(others, False), b"", np.array([end], "<u4").tobytes()]
        # The two units of each word, and of the end as one word more.
        nothing, is_plain = len(units) - 2, plain.to_numpy(zero_copy_only=False)
        pairs = np.full((len(words) + 1, 2), nothing)
        pairs[:-1][is_plain, 0] = letters.indices.to_numpy()
        pairs[:-1][is_plain, 1] = marks.indices.to_numpy() + len(letters.dictionary)
        pairs[:-1][~is_plain, 0] = np.arange(len(others)) + nothing - len(others)
        pairs[-1, 0] = nothing + 1
        ids, starts = laid_out(lists(units), pairs.ravel())
        table = pa.ListArray.from_arrays(pa.array(starts[::2], pa.int32()), pa.array(ids))
        ends = np.cumsum(split.value_lengths().to_numpy(), dtype=np.int64)
        ids, starts = laid_out(table, np.insert(coded.indices.to_numpy(), ends, len(words)))
        return ids.view("<u4"), starts[np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))]


@cache
def encoder(name: str) -> WordEncoder:
    import public_tokenizers

    return WordEncoder(public_tokenizers.path(name))


def encode_rows(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(row, doc_id, ids) of docs (doc_id, text): ids with the end id, row counting up within and over partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << ROW_BITS
        for batch in text_batches(batches):
            values, starts = encoder(tokenizer).encode(batch.column(1), END_ID)
            ids = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view("<i4")))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(ids))), batch.column(0), ids], names=["row", "doc_id", "ids"])
            row += len(ids)

    return docs.mapInArrow(run, "row long, doc_id long, ids array<int>")


#: Rows of a partition are numbered in these low bits; the partition's number is above them.
ROW_BITS = 40
FORMAT = "row long, doc_id long, ids array<int>"


def write_token_ids(docs: DataFrame, path: str, tokenizer: str = TOKENIZER) -> None:
    """Writes docs as token ids in ascending order of doc_id: row numbers the documents of all files in that order.

    Integers are run-length encoded by ORC; stripes are small enough to be read in parallel, each has a row index, and
    a Bloom filter on doc_id lets a reader of single documents skip stripes and row groups. Texts are dealt by ranges
    of doc_id before they are encoded, so ids are made where they are written. Documents that share a doc_id lie side by side in
    the order of a hash of their texts; null texts have the end id alone; an empty table gives an empty file set.
    """
    dealt = named(docs, "doc_id", "text").withColumn("mark", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").drop("mark")
    options = {"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    encode_rows(dealt, tokenizer).write.options(**options).orc(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, doc_id, ids) as written by write_token_ids."""
    return spark.read.schema(FORMAT).orc(path).select(F.col("_metadata.file_name").alias("file"), "row", "doc_id", "ids")


def checksums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(3)
        ids, ends = column.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())], names=["file", "row", "doc_id", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files at path: start is the number of ids before it.

    Starts are a running sum within each file on top of what the files before it hold, by the number that a file's rows carry; only
    a row for each file is summed in one place.
    """
    part = F.shiftright("row", ROW_BITS).alias("part")
    rows = read_token_ids(spark, path).mapInArrow(checksums, "file string, row long, doc_id long, n_tokens long, ids_crc32 long").select(part, "row", "doc_id", "n_tokens", "ids_crc32")
    sizes = spark.read.schema(FORMAT).orc(path).groupBy(part).agg(F.sum(F.size("ids").cast("long")).alias("total"))
    first = sizes.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("first"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(small(first), "part").select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_id_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    write_token_ids(table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)
