"""Packing of documents into sequences by best-two-fit.

Only lengths matter to the packing, and pieces of one length are alike, so the plan is made on the histogram of
lengths: at most as many rows as a sequence has places, whatever the size of the corpus. The plan consists of patterns
(how often each length goes into one sequence) with the number of sequences made by each. Every piece then finds its
own place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.llm.common import named, table, text_batches, written
from lodestack.llm.tokens import END_ID, TOKENIZER, encoder

CAPACITY = 4096


def two_for(gap: int, lengths: np.ndarray, left: np.ndarray) -> tuple[int, int] | None:
    """The two lengths of the largest sum up to gap, of those that are left; the larger one first."""
    at = np.searchsorted(lengths, gap - lengths, "right") - 1
    at = np.where((at >= 0) & (lengths[at] == lengths) & (left < 2), at - 1, at)
    total = np.where(at >= 0, lengths + lengths[at], -1)
    best = len(total) - 1 - int(np.argmax(total[::-1])) if len(total) else 0
    return (int(lengths[best]), int(lengths[at[best]])) if len(total) and total[best] > 0 else None


def pattern(lengths: list[int], count: dict[int, int], capacity: int) -> Counter:
    """One sequence: filled greedily, then its smallest piece gives way to two that fill it more tightly."""
    used: Counter = Counter()
    gap = capacity
    while (i := bisect_right(lengths, gap)) > 0:
        while i and used[lengths[i - 1]] == count[lengths[i - 1]]:
            i -= 1
        if not i:
            break
        piece = lengths[i - 1]
        used[piece] += (n := min(count[piece] - used[piece], gap // piece))
        gap -= n * piece
    while gap and used:
        small = min(used)
        left = np.array([count[x] - used[x] for x in lengths])
        free = np.array(lengths)[left > 0]
        pair = two_for(gap + small, free, left[left > 0])
        if not pair or sum(pair) <= small:
            break
        used[small] -= 1
        used += Counter()
        used.update(pair)
        gap += small - sum(pair)
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces a sequence, first sequence, first offset) by length and first rank.

    Each pattern is repeated while its lengths last, so every one uses up some length and patterns are few.
    """
    count = {x: n for x, n in histogram.items() if n > 0}
    if any(not 0 < x <= capacity for x in count):
        raise ValueError("a piece is longer than a sequence")
    lengths, taken, sequence, out = sorted(count), Counter(), 0, []
    while lengths:
        used = pattern(lengths, count, capacity)
        times, offset = min(count[x] // n for x, n in used.items()), 0
        for x, n in sorted(used.items(), reverse=True):
            out.append((x, taken[x], n, sequence, offset))
            taken[x] += n * times
            count[x] -= n * times
            offset += n * x
            if not count[x]:
                lengths.remove(x)
        sequence += times
    return sorted(out)


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """The pieces of docs: documents of up to capacity ids whole, longer ones cut every capacity ids.

    part and rank say which partition made a piece and how many pieces of its length came before it there.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in text_batches(batches):
            ids, starts = encoder(tokenizer).encode(batch.column(1), END_ID)
            size = np.diff(starts)
            pieces = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.minimum(size[doc] - piece * capacity, capacity)
            order = np.argsort(length, kind="stable")
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.searchsorted(length[order], length[order])
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            data, at = memoryview(ids.tobytes()), (4 * (starts[doc] + piece * capacity)).tolist()
            own = [data[i : i + n] for i, n in zip(at, (4 * length).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), piece.astype(np.int32), piece * capacity, length, np.array(list(map(zlib.crc32, own)), np.int64), np.full(len(doc), part, np.int32), rank]
            if keep_ids:
                columns.append(pa.array(list(map(bytes, own)), pa.binary()))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * keep_ids
    return named(docs, "doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep_ids: bool = False) -> DataFrame:
    """Every piece of docs with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Sequences hold at most capacity ids, gapless from 0. A null or empty text is a piece of the end id alone; repeated
    rows are packed as often as they occur; an empty table gives an empty result; further columns are not read.
    """
    pieces = written(pieces_of(docs, capacity, tokenizer, keep_ids))
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length: capacity at most
    steps = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (steps[:, 0] << 48) + steps[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            _, first, each, sequence, offset = steps[at].T
            own = rank - first
            columns = [batch.column(c) for c in names] + [pa.array(sequence + own // each), pa.array(offset + own % each * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return pieces.join(before.hint("merge"), ["part", "length"]).mapInArrow(place, schema)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
