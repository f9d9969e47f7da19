"""Benchmark decontamination: windows of a document that repeat a benchmark item.

A window has as many words as the item, or is the whole document where that is shorter. Windows and items get a SimHash of their five-word
shingles. Fingerprints are cut into BLOCKS blocks of bits: at distance RADIUS or less at least one block differs in BLOCK_FLIPS
bits or less, so an index from the values of each block to the items that near gives every item within the radius of a
window, and some fifth of all others. The exact weighted similarity of the two sets of shingles then decides.
Windows that hold no shingle of any item have similarity 0 and are passed over without a fingerprint.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import hashed_words, named, table, text_batches, without_rows, written

SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8
#: Fixed by each other: BLOCKS * (BLOCK_FLIPS + 1) - 1 is the largest radius that the index guarantees.
RADIUS, BLOCKS, BLOCK_FLIPS = 19, 5, 3
WIDTHS = np.array([13, 13, 13, 13, 12], np.uint64)
SHIFTS = np.cumsum(WIDTHS) - WIDTHS
#: Characters and items of the benchmark in one broadcast index (some 20 MB); more are worked through in several passes.
BLOCK_CHARS, BLOCK_ITEMS = 4_000_000, 2_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of size words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mixed(total)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of the windows of count shingles from each start: a bit is 1 if over half the shingles have it."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    return np.packbits(2 * (sums[starts + count] - sums[starts]) > count, axis=1, bitorder="little").view(np.uint64)[:, 0]


def block_values(prints: np.ndarray) -> np.ndarray:
    """The blocks of fingerprints, a column each."""
    return (prints[:, None] >> SHIFTS) & ((np.uint64(1) << WIDTHS) - np.uint64(1))


def distinct_shingles(words: np.ndarray, shingle_words: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, min(shingle_words, len(words)))) if len(words) else np.zeros(0, np.uint64)


class ItemIndex:
    """Some items by their numbers of words. held says how many of all the n items hold a shingle, where it is more than one."""

    def __init__(self, items: list[tuple[int | None, str]], n: int, held: dict[int, int], radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS):
        if radius >= BLOCKS * (BLOCK_FLIPS + 1):
            raise ValueError("the radius is beyond what the index guarantees")
        self.radius, self.shingle_words, self.held, self.n = radius, shingle_words, held, max(1, n)
        hashes, starts = hashed_words(pa.array([t for _, t in items], pa.string()))
        own = []
        for (item, _), a, b in zip(items, starts, starts[1:], strict=False):
            if b > a:
                shingles = shingle_hashes(hashes[a:b], min(shingle_words, int(b - a)))
                own.append((int(b - a), item, Counter(shingles.tolist()), fingerprints(shingles, np.array([0]), len(shingles))[0]))
        own.sort(key=lambda x: x[0])
        self.ids, self.sets = [x[1] for x in own], [x[2] for x in own]
        self.prints = np.array([x[3] for x in own], np.uint64)
        self.sizes: dict[int, tuple[int, int]] = {}
        self.sizes_of: dict[int, set[int]] = defaultdict(set)
        for place, (size, _, shingles, _) in enumerate(own):
            self.sizes[size] = (self.sizes.get(size, (place,))[0], place + 1)
            for h in shingles:
                self.sizes_of[h].add(size)
        values = block_values(self.prints)
        self.near = [np.packbits(np.bitwise_count(np.arange(1 << int(w), dtype=np.uint64)[:, None] ^ v[None, :]) <= BLOCK_FLIPS, axis=1, bitorder="little") for w, v in zip(WIDTHS, values.T, strict=True)]
        self.widths = sorted({min(shingle_words, s) for s in self.sizes})
        self.seen = np.zeros(1 << 20, bool)
        self.seen[np.array(list(self.sizes_of), np.uint64) & np.uint64((1 << 20) - 1)] = True
        self.pairs = self.passed = 0

    def similarity(self, window: Counter, item: Counter) -> float:
        """Weighted Jaccard similarity of two multisets: a shingle of the item weighs more the fewer items hold it, any other most."""
        low = high = 0.0
        for h in sorted(window.keys() | item.keys()):
            w, x, y = 1 + log(self.n / self.held.get(h, 1)) if h in item else 1 + log(self.n), window[h], item[h]
            low += w * min(x, y)
            high += w * max(x, y)
        return low / high if high else 0.0

    def candidates(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all pairs within the radius among the items of a size, by way of the blocks."""
        first, end = self.sizes[size]
        low, high = first // 8, (end + 7) // 8
        packed = reduce(np.bitwise_or, (near[v, low:high] for near, v in zip(self.near, block_values(prints).T, strict=True)))
        maybe = np.unpackbits(packed, axis=1, bitorder="little")[:, first - 8 * low : end - 8 * low]
        w, i = np.nonzero(maybe)
        self.pairs += maybe.size
        self.passed += len(w)
        good = np.bitwise_count(prints[w] ^ self.prints[first + i]) <= self.radius
        return w[good], first + i[good]

    def matches(self, words: np.ndarray, least: float) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item that reaches least."""
        best: dict[int, tuple[float, int, int]] = {}
        for width in self.widths:
            hashes = shingle_hashes(words, width)
            at = np.flatnonzero(self.seen[hashes & np.uint64((1 << 20) - 1)])
            marks = defaultdict(list)
            for p, h in zip(at.tolist(), hashes[at].tolist(), strict=True):
                for size in self.sizes_of.get(h, ()):
                    if min(self.shingle_words, size) == width:
                        marks[size].append(p)
            for size, places in marks.items():
                size_here = min(size, len(words))
                count, last = size_here - width + 1, len(words) - size_here
                for start, end in runs([(max(0, p - count + 1), min(p, last)) for p in places]):
                    starts = np.arange(end - start + 1)
                    w, i = self.candidates(fingerprints(hashes[start : end + count], starts, count), size)
                    for a, k in zip(w.tolist(), i.tolist(), strict=True):
                        s = self.similarity(Counter(hashes[start + a : start + a + count].tolist()), self.sets[k])
                        if s >= least and (-s, start + a, size_here) < best.get(self.ids[k], (0.0, 0, 0)):
                            best[self.ids[k]] = (-s, start + a, size_here)
        return [(item, start, size, -s) for item, (s, start, size) in best.items()]


def runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending spans (ends included) with those that touch put together."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if b < a:
            continue
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST_SIMILARITY, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): for each document and item the best window at or above least.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; of windows alike the first is given.
    Items shorter than a shingle count as one shingle. Null or empty texts on either side match nothing; repeated
    rows of docs are answered each, repeated item ids (a null one too) keep the better match; empty tables give an empty result; further
    columns are not read. Weights are worked out over all items first. The index of the items is broadcast while they are at most
    BLOCK_ITEMS with BLOCK_CHARS characters; more items are split into blocks of that size, one pass over docs for each, and a
    document's matches in the blocks are put together.
    """
    docs, items = named(docs, "doc_id", "text"), named(items, "item_id", "text").where("text is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = 1 if chars <= BLOCK_CHARS and n <= BLOCK_ITEMS else -(-2 * max(chars * BLOCK_ITEMS, n * BLOCK_CHARS) // (BLOCK_CHARS * BLOCK_ITEMS))
    context = docs.sparkSession.sparkContext

    def shingled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1 << 20):
            hashes, starts = hashed_words(batch.column(1))
            own = [distinct_shingles(hashes[a:b], shingle_words) for a, b in zip(starts, starts[1:], strict=False)]
            for block, h in zip(batch.column(0).to_pylist(), own, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), block, np.int32)), pa.array(h.view(np.int64))], names=["block", "h"])

    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    held = items.select("block", "text").mapInArrow(shingled, "block int, h long")
    counts = held.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    held = written(held.distinct().join(counts, "h"))
    if blocks > 1:
        docs = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    else:
        docs = docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text")

    def one_pass(block: int) -> DataFrame:
        own = [tuple(r) for r in items.where(F.col("block") == block).select("item_id", "text").collect()]  # bounded by BLOCK_ITEMS and BLOCK_CHARS
        counted = {r["h"] & (1 << 64) - 1: r["n"] for r in held.where(F.col("block") == block).collect()}  # a row for each of their shingles at most
        index = context.broadcast(ItemIndex(own, n, counted, radius, shingle_words))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in text_batches(batches, 4 << 20):
                hashes, starts = hashed_words(batch.column(2))
                rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = [(row, doc, *m) for row, doc, a, b in zip(rows, ids, starts, starts[1:], strict=False) for m in index.value.matches(hashes[a:b], least)]
                columns = zip(*out, strict=True) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        return docs.mapInArrow(run, "row long, doc_id long, item_id long, start_word int, n_words int, similarity double")

    names, types = ["row", "doc_id", "item_id", "start_word", "n_words", "similarity"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()]
    found = reduce(DataFrame.unionByName, map(one_pass, range(blocks)))
    if blocks > 1:
        best = F.min(F.struct((-F.col("similarity")).alias("s"), "start_word", "n_words")).alias("m")
        found = found.groupBy("row", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.start_word", "m.n_words", (-F.col("m.s")).alias("similarity"))
    return found.select("doc_id", "item_id", "start_word", "n_words", "similarity")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows whose text repeats an item."""
    return without_rows(docs, lambda rows, number: contaminated(rows.select(F.col(number).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(number)).distinct())
