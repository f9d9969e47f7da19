"""Near-duplicates by SimHash: fingerprints, and links found by meeting in the middle of the Hamming ball.

Two fingerprints differ in at most 2h bits exactly if some value lies within h bits of both. Every distinct
fingerprint therefore emits all values within h bits of itself (its variants), variants are shuffled, and
fingerprints that emitted the same one are linked. Variants travel packed: the shuffle key of a variant is its
leading bits, and a fingerprint is sent once to each key that any of its variants has, with the number of bits
that it may still flip; the receiving task writes out the variants of that key. All that meet at one variant
lie within 2h of each other, so linking them in a chain loses nothing and no group is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import named, roots, small, table, text_batches, without_rows, words_of, written
from lodestack.llm.components import connected_components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Variants that one shuffle key should hold, and those from which a key is split further.
KEY_VARIANTS, SPLIT_VARIANTS = 300_000, 600_000


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words."""
    tokens = words_of(text)
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1))
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) of every row of docs, fp as a signed long. Null and wordless texts have 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            fps = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return named(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def masks(bits: int, most: int) -> np.ndarray:
    """All values of so many low bits with at most this many bits set."""
    one = [1 << i for i in range(bits)]
    return np.array([sum(c) for k in range(most + 1) for c in combinations(one, k)], np.uint64)


def salt_codes(values: np.ndarray, salt_bits: int) -> np.ndarray:
    """A linear code of so many bits: the code of a ^ b is the code of a ^ that of b, and it spreads small masks evenly."""
    out = np.zeros(len(values), np.uint64)
    for i in range(64):
        column = np.uint64(xxhash.xxh64_intdigest(b"salt", i) & ((1 << salt_bits) - 1))
        out ^= ((values >> np.uint64(i)) & np.uint64(1)) * column
    return out


def variants(fps: np.ndarray, flips: np.ndarray, low_bits: int, salt: int, salt_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The low bits of all variants that have this salt, and the index of the fingerprint of each."""
    low = np.uint64((1 << low_bits) - 1)
    values, index = [], []
    for left in np.unique(flips):
        own, flip = np.flatnonzero(flips == left), masks(low_bits, int(left))
        if not salt_bits:
            values.append(((fps[own] & low)[:, None] ^ flip[None, :]).ravel())
            index.append(np.repeat(own, len(flip)))
            continue
        code, flip_code = salt_codes(fps[own] & low, salt_bits), salt_codes(flip, salt_bits)
        for c in np.unique(code):
            part, some = own[code == c], flip[flip_code == (np.uint64(salt) ^ c)]
            values.append(((fps[part] & low)[:, None] ^ some[None, :]).ravel())
            index.append(np.repeat(part, len(some)))
    if not values:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(values), np.concatenate(index)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect all distinct values of fps.fp that differ in at most radius bits (an even number).

    Only enough edges to connect what is linked: within a shuffle key each fingerprint is tied to one other.
    Nulls count for nothing.
    """
    half = radius // 2
    if radius != 2 * half:
        raise ValueError("radius must be even")
    fps = named(fps, "fp").where("fp is not null").distinct()
    count = fps.count()
    ball = len(masks(64, half))
    bits = max(2, ceil(log2(max(1.0, count * ball / KEY_VARIANTS))))
    low_bits = 64 - bits

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip = masks(bits, half)
        left = half - np.bitwise_count(flip).astype(np.int32)
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.column(0).slice(i, 5000).to_numpy().view(np.uint64)
                key = (part >> np.uint64(low_bits))[:, None] ^ flip[None, :]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), pa.array(np.tile(left, len(part))), pa.array(np.repeat(part, len(flip)).view(np.int64))], names=["prefix", "flips", "fp"]
                )

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["fp"].to_numpy().view(np.uint64)
        value, index = variants(own, pdf["flips"].to_numpy(), low_bits, int(key[1]), int(pdf["salt_bits"].iloc[0]))
        order = np.argsort(value)
        value = value[order]
        same = np.flatnonzero(value[1:] == value[:-1])
        del value
        pair = np.unique(index[order[same]] * len(own) + index[order[same + 1]])
        u, v = pair // max(len(own), 1), pair % max(len(own), 1)
        near = np.bitwise_count(own[u] ^ own[v]) <= radius
        root = roots(u[near], v[near], len(own))
        tied = np.flatnonzero(root != np.arange(len(own)))
        return pd.DataFrame({"u": own[tied].view(np.int64), "v": own[root[tied]].view(np.int64)})

    sent = fps.mapInArrow(send, "prefix long, flips int, fp long")
    each = F.element_at(F.array(*[F.lit(len(masks(low_bits, k))) for k in range(half + 1)]), F.col("flips") + 1)
    hot = sent.groupBy("prefix").agg(F.sum(each).alias("variants")).where(F.col("variants") > SPLIT_VARIANTS)
    hot = written(hot.select("prefix", F.ceil(F.log2(F.col("variants") / SPLIT_VARIANTS)).cast("int").alias("salt_bits")))
    sent = sent.join(small(hot), "prefix", "left").withColumn("salt_bits", F.coalesce("salt_bits", F.lit(0)))
    sent = sent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, salt_bits) - 1"))))
    return sent.groupBy("prefix", "salt").applyInPandas(meet, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs: links between fingerprints, followed to their ends.

    component_id is the smallest doc_id that links reach, itself included. Rows are kept as often as they occur;
    null texts and texts without words have fingerprint 0 and are linked like any other; a null doc_id stays null
    and never names a component unless it has no other member. An empty table gives an empty result; other columns of docs are not read.
    """
    prints = written(fingerprints(docs, words))
    groups = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    part = connected_components(links(groups, radius))
    known = groups.join(part, groups["fp"] == part["vertex"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named_groups = known.join(smallest, "root").select("fp", "component_id")
    return prints.join(named_groups, "fp").select("doc_id", "fp", "component_id")


def hex_digits(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, components: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id (null after all others) stays.

    Rows are judged one by one: different texts under one doc_id, or under none, are different documents. An empty table
    gives an empty result; columns and their order stay.
    """

    def gone(rows: DataFrame, number: str) -> DataFrame:
        part = components(rows.select(F.col(number).alias("doc_id"), "text")).select(F.col("doc_id").alias(number), "component_id")
        part = written(part.join(named(rows, number, "doc_id"), number))
        first = part.groupBy("component_id").agg(F.count("*").alias("members"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", number)).alias("first"))
        stays = written(first.where("members > 1").select("component_id", F.col(f"first.{number}").alias("_stays")))
        return part.join(small(stays), "component_id").where(F.col(number) != F.col("_stays")).select(number)

    return without_rows(docs, gone)
