"""Edited copies: documents whose five-word shingles have a Jaccard similarity of LEAST_SIMILARITY or more.

At that similarity two 64-bit SimHashes differ in some ten bits, which no small Hamming ball covers. So what SimHash
links stays linked, and further candidates come from MinHash bands: texts whose BAND_ROWS minima agree in one of BANDS
bands meet in a bucket. A pair of similarity s meets with probability 1 - (1 - s ** BAND_ROWS) ** BANDS: 0.9996 at 0.8.
The exact similarity of the shingle sets then decides, so bands can only miss a pair and never add one.

A bucket's texts meet with a sketch of their sets: a shingle flips one of SKETCH_BITS bits, so two sketches differ in no more bits
than the sets do in shingles. Pairs whose sketches differ in more than the similarity allows never leave the join. That loses no pair;
it passes more of them the longer the texts are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import hashed_words, named, small, text_batches, written
from lodestack.llm.components import connected_components
from lodestack.llm.decontamination import mixed, shingle_hashes
from lodestack.llm.simhash import fingerprint, links

SHINGLE_WORDS, LEAST_SIMILARITY = 5, 0.8
BANDS, BAND_ROWS = 20, 5
STAR_ROUNDS = 3
#: Texts of a bucket that one key of the last turn's join holds on either side, about.
BLOCK_TEXTS = 500
SKETCH_BITS = 512
SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray) -> np.ndarray:
    """The set of a text's shingles, ascending; a text shorter than a shingle is one shingle."""
    return np.unique(shingle_hashes(words, min(SHINGLE_WORDS, len(words)))) if len(words) else np.zeros(0, np.uint64)


def band_keys(own: np.ndarray) -> np.ndarray:
    """A bucket for each band of a set that isn't empty."""
    least = np.min([(own[i : i + 2000, None] * FACTORS).min(axis=0) for i in range(0, len(own), 2000)], axis=0).reshape(BANDS, BAND_ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key


def sketch(own: np.ndarray) -> np.ndarray:
    """For each of SKETCH_BITS bits whether an odd number of a set's shingles fall on it."""
    place = (mixed(own) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=SKETCH_BITS).astype(np.uint8) & 1).view(np.int64)


def prints_and_bands(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, t, n, sketch, bands): SimHash, hash of the text, number of shingles, sketch, buckets; none for texts without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2 << 20):
            texts, (hashes, starts) = batch.column(2).to_pylist(), hashed_words(batch.column(2))
            sets = [shingles(hashes[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
            fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64)
            bands = [band_keys(s).view(np.int64) if len(s) else None for s in sets]
            sizes, sketches = pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))
            columns = [batch.column(0), pa.array(fps), batch.column(1), sizes, sketches, pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "t", "n", "sketch", "bands"])

    rows = named(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("t"), "text")
    return rows.mapInArrow(run, "doc_id long, fp long, t long, n long, sketch array<long>, bands array<long>")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b, ra, rb), hashes of texts in docs, that reach the similarity."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1 << 20):
            hashes, starts = hashed_words(batch.column(1))
            own = [shingles(hashes[a:b]).view(np.int64) for a, b in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["t", "own"])

    wanted = small(pairs.select(F.explode(F.array("a", "b")).alias("t")).distinct())
    texts = named(docs, "text").where("text is not null").select(F.xxhash64("text").alias("t"), "text").join(wanted, "t", "left_semi")
    own = written(texts.mapInArrow(sets, "t long, own array<long>").dropDuplicates(["t"]))
    both = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
    shared = both.select("ra", "rb", F.size("x").alias("n"), F.size("y").alias("n_b"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return shared.where(f"shared >= {LEAST_SIMILARITY}D * (n + n_b - shared)").select("ra", "rb").distinct()


def busy(rows: DataFrame) -> DataFrame:
    """The rows (key, t, n, root, ...) of buckets that hold more than one root."""
    keys = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return written(rows.join(keys, "key", "left_semi"))


def joined(rows: DataFrame, part: DataFrame) -> DataFrame:
    """rows with the root of their root."""
    part = part.select(F.col("vertex").alias("root"), F.col("root").alias("_root"))
    return rows.join(small(part), "root", "left").withColumn("root", F.coalesce("_root", "root")).drop("_root")


def sketched(bucket: DataFrame, rows: DataFrame) -> DataFrame:
    """bucket with the sketches of its texts, a column for each 64 bits."""
    sketches = rows.select("t", "sketch").join(small(bucket.select("t").distinct()), "t", "left_semi").dropDuplicates(["t"])
    return written(bucket.join(sketches.select("t", *[F.col("sketch")[i].alias(s) for i, s in enumerate(SKETCH)]), "t"))


def in_blocks(bucket: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a bucket's join with itself, by key, part and other: large buckets are dealt to blocks, and each pair of blocks is a key of its own."""
    parts = F.ceil(F.col("size") / BLOCK_TEXTS).cast("int")
    own = F.pmod(F.xxhash64("t"), parts).cast("int")
    sized = bucket.join(small(bucket.groupBy("key").agg(F.count("*").alias("size"))), "key")
    every = F.explode(F.sequence(F.lit(0), parts - 1))
    left = sized.select("*", own.alias("part"), every.alias("other")).drop("size").repartition("key", "part", "other")
    return left, sized.select("*", own.alias("other"), every.alias("part")).drop("size")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) as simhash.near_duplicates gives them, linked also by the similarity of shingle sets.

    A bucket's texts are first held against one of them, another one each time for STAR_ROUNDS rounds, which joins large groups of copies
    at a cost in proportion to their size. Those that are still in different components are then all held against each other by their
    sketches, so no pair of a bucket is left out, and only pairs that may reach the similarity become rows; a large bucket is dealt to tasks in blocks.
    """
    rows = written(prints_and_bands(docs))
    groups = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    part = connected_components(links(groups))
    known = written(joined(groups.withColumn("root", F.col("fp")), part))
    spread = rows.where("n > 0").join(known.select("fp", "root"), "fp").select(F.explode("bands").alias("key"), "t", "n", "root").distinct()
    apart_bits = " + ".join(f"bit_count({s} ^ {s}_b)" for s in SKETCH)
    near = f"least(n, n_b) >= {LEAST_SIMILARITY} * greatest(n, n_b) and {apart_bits} <= (n + n_b) * {(1 - LEAST_SIMILARITY) / (1 + LEAST_SIMILARITY) + 1e-9}D"
    bucket = sketched(busy(spread), rows)
    on = ["key"]
    for turn in range(STAR_ROUNDS + 1):
        if turn < STAR_ROUNDS:
            chosen = F.min(F.struct(F.xxhash64("root", F.lit(turn)).alias("mark"), "root", "t", "n", *SKETCH)).alias("o")
            other = bucket.groupBy("key").agg(chosen).select("key", "o.*")
            apart = "root <> rb"
        else:
            bucket, other = in_blocks(bucket)
            on, apart = ["key", "part", "other"], "root > rb"
        other = other.select(*on, F.col("root").alias("rb"), F.col("t").alias("b"), F.col("n").alias("n_b"), *[F.col(s).alias(f"{s}_b") for s in SKETCH])
        pairs = written(bucket.join(other, on).where(f"{apart} and {near}").select(F.col("t").alias("a"), "b", F.col("root").alias("ra"), "rb").distinct())
        edges = written(verified(docs, pairs))
        if not edges.isEmpty():
            part = written(connected_components(edges.toDF("u", "v")))
            known, bucket = written(joined(known, part)), joined(bucket, part)
        if turn < STAR_ROUNDS:
            bucket = busy(bucket)
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named_groups = known.join(smallest, "root").select("fp", "component_id")
    return rows.select("doc_id", "fp").join(named_groups, "fp").select("doc_id", "fp", "component_id")
