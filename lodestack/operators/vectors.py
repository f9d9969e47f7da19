"""Nearest neighbours over embeddings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

K = 50
#: Numbers of query vectors in one broadcast block; more queries are answered in several passes.
BLOCK_NUMBERS = 4_000_000
#: Queries, and rows, whose similarities a task holds at a time (32 MB); similarities within SAME of the k-th are compared with it, rounded.
TILE, SAME = 2_000, 1e-11


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def kept(vectors: DataFrame, keep: Column | DataFrame | None) -> DataFrame:
    """Rows of vectors that may be shown: by a condition on their columns, or by a table of their ids (id)."""
    if keep is None:
        return vectors
    return vectors.where(keep) if isinstance(keep, Column) else vectors.join(keep.select("id").distinct(), "id", "left_semi").select(*vectors.columns)


def semantic_search(vectors: DataFrame | VectorIndex, query: list[float] | None, k: int = K, keep: Column | DataFrame | None = None, post_filter: bool = False, report: list[dict] | None = None) -> DataFrame:
    """The k rows of vectors (id, embedding, ...) nearest to query by cosine, nearest first, with their similarity.

    keep says which rows may be shown (a condition, or a table of ids: what visible() leaves of the corpus), before k are chosen or, with
    post_filter, after. No query gives no rows; rows whose vector is null or zero have no similarity and aren't found.

    Of a VectorIndex only the cells are read that can hold one of the k: cells come nearest bound first, in growing groups, until the next
    bound is beyond the k-th distance found. report, if given, gets the number of rows in the cells read and in all.
    """
    index = vectors if isinstance(vectors, VectorIndex) else None
    rows = index.rows.drop("_cell", "_distance") if index is not None else vectors
    if not query or not any(query):
        return rows.withColumn("similarity", F.lit(0.0)).limit(0)
    if index is not None:
        rows = index.near(query, k, keep if not post_filter else None, report).drop("_cell", "_distance")
    given = F.array(*[F.lit(float(x)) for x in query])
    df = rows if post_filter else kept(rows, keep)
    top = df.withColumn("similarity", cosine("embedding", given)).where("similarity is not null").orderBy(F.desc("similarity"), "id").limit(k)
    return kept(top, keep).orderBy(F.desc("similarity"), "id") if post_filter and keep is not None else top


#: Rows that centres are fitted on, rows of a cell that are aimed at, and the most cells (their centres are held by the driver).
SAMPLE_ROWS, CELL_ROWS, MOST_CELLS = 20_000, 10_000, 1_024
#: Similarities within this of the k-th are looked at: bounds come from rounded distances.
SLACK = 1e-6


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of length 1; zero vectors become nothing comparable (NaN)."""
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    even = len(lengths) == 1 and lengths[0] > 0
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if even else np.array(column.to_pylist(), float)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, np.nan)


@dataclass
class VectorIndex:
    """Vectors in cells around centres: rows with _cell and _distance (to the centre, both of length 1), and the cells' centres, sizes and bounds.

    By the triangle inequality a row is no nearer to a query than the query's distance to the centre and the row's differ. Rows lie in the files by cell,
    then distance, so that both kinds of bounds skip row groups.
    """

    rows: DataFrame
    centres: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def near(self, query: list[float], k: int, keep: Column | DataFrame | None, report: list[dict] | None = None) -> DataFrame:
        """Rows that include the k nearest to query of those that may be shown."""
        q = np.array(query, float) / np.linalg.norm(query)
        to = np.linalg.norm(self.centres - q, axis=1) if len(self.centres) else np.zeros(0)
        bound = np.maximum(0, np.maximum(to - self.most, self.least - to))
        order = np.argsort(bound, kind="stable")
        given = F.array(*[F.lit(float(x)) for x in query])
        read, limit, group = 0, np.inf, 1
        while read < len(order) and bound[order[read]] <= limit:
            while read < len(order) and (self.sizes[order[:read]].sum() < k * group or bound[order[read]] == 0) and bound[order[read]] <= limit:
                read += 1
            some = kept(self.rows.where(F.col("_cell").isin(order[:read].tolist())), keep)
            best = some.select(cosine("embedding", given).alias("s")).where("s is not null").orderBy(F.desc("s")).limit(k).agg(F.min("s"), F.count("*")).first()
            limit = np.sqrt(max(0.0, 2 - 2 * best[0])) + SLACK if best[1] == k else np.inf
            group *= 4
        if report is not None:
            report.append({"read": int(self.sizes[order[:read]].sum()), "rows": int(self.sizes.sum())})
        chosen = [order[i] for i in range(read) if bound[order[i]] <= limit]
        if not chosen:
            return self.rows.where(F.lit(False))
        window = [(F.col("_cell") == int(c)) & F.col("_distance").between(float(max(0.0, to[c] - limit)), float(min(2.0, to[c] + limit) + SLACK)) for c in chosen]
        return self.rows.where(reduce(lambda x, y: x | y, window))


def write_vectors(vectors: DataFrame, folder: str, cells: int | None = None) -> None:
    """Writes vectors (id, embedding of one length, further columns) as a VectorIndex.

    Centres are fitted on the SAMPLE_ROWS rows with the smallest hashes of their ids, every row is put into the cell of its nearest centre.
    Null and zero vectors are left out: they have no similarity to anything.
    """
    spark = vectors.sparkSession
    real = vectors.where(F.col("embedding").isNotNull() & (dot(F.col("embedding"), F.col("embedding")) > 0))
    n = real.count()
    cells = cells or int(min(MOST_CELLS, max(1, n // CELL_ROWS)))
    sample = [r[0] for r in real.select("embedding", F.xxhash64("id").alias("mark")).orderBy("mark").limit(SAMPLE_ROWS).collect()]
    points = np.array(sample, float) if sample else np.zeros((0, 1))
    points = points / np.linalg.norm(points, axis=1, keepdims=True)
    centres = points[: min(cells, len(points))]
    for _ in range(10):
        at = (points @ centres.T).argmax(axis=1) if len(points) else np.zeros(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    shared = spark.sparkContext.broadcast(centres)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = unit_rows(batch.column(batch.schema.get_field_index("embedding")))
                cell = (rows @ shared.value.T).argmax(axis=1)
                distance = np.linalg.norm(rows - shared.value[cell], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(distance)], names=[*batch.schema.names, "_cell", "_distance"])

    schema = StructType([*real.schema.fields, StructField("_cell", IntegerType()), StructField("_distance", DoubleType())])
    real.mapInArrow(place, schema).repartitionByRange("_cell", "_distance").sortWithinPartitions("_cell", "_distance").write.mode("overwrite").option("parquet.block.size", str(4 << 20)).parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    bounds = rows.groupBy("_cell").agg(F.count("*").alias("n"), F.min("_distance").alias("least"), F.max("_distance").alias("most"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "_cell int, centre array<double>")
    table.join(bounds, "_cell", "left").na.fill({"n": 0, "least": 0.0, "most": 0.0}).write.mode("overwrite").parquet(f"{folder}/cells")


def read_vectors(spark: SparkSession, folder: str) -> VectorIndex:
    cells = sorted(spark.read.parquet(f"{folder}/cells").collect())  # MOST_CELLS rows at most
    column = lambda c: np.array([r[c] for r in cells], float)
    centres = np.array([r["centre"] for r in cells], float) if cells else np.zeros((0, 1))
    return VectorIndex(spark.read.parquet(f"{folder}/rows"), centres, column("n"), column("least"), column("most"))


def merge_best(best_s: np.ndarray, best_i: np.ndarray, q: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
    """Puts candidates (query's row, id, similarity) among the k best of their queries, in place: by similarity, then id."""
    k = best_s.shape[1]
    who, q = np.unique(q, return_inverse=True)
    q = np.concatenate([np.repeat(np.arange(len(who)), k), q])
    s, i = np.concatenate([best_s[who].ravel(), s]), np.concatenate([best_i[who].ravel(), i])
    order = np.lexsort((i, -s, q))
    q, s, i = q[order], s[order], i[order]
    place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(who)))[q]
    best_s[who], best_i[who] = s[place < k].reshape(-1, k), i[place < k].reshape(-1, k)


def compare(matrix: np.ndarray, ids: np.ndarray, who: np.ndarray, own: np.ndarray, own_ids: np.ndarray, best_s: np.ndarray, best_i: np.ndarray, exclude_self: bool) -> None:
    """Holds rows (own, own_ids) against the queries who of matrix, tile by tile, and keeps their k best: no more than TILE squared similarities at a time."""
    k = best_s.shape[1]
    for row in range(0, len(own), TILE):
        some, some_ids = own[row : row + TILE], own_ids[row : row + TILE]
        for first in range(0, len(who), TILE):
            at = who[first : first + TILE]
            s = matrix[at] @ some.T
            s[np.isnan(s)] = -np.inf  # a zero vector is like nothing
            if exclude_self:
                shared = np.flatnonzero(np.isin(some_ids, ids[at]))
                s[:, shared] = np.where(ids[at][:, None] == some_ids[shared][None, :], -np.inf, s[:, shared])
            least = best_s[at, -1]
            if s.shape[1] > k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(s, -k, axis=1)[:, -k])
            q, c = np.nonzero((s >= (least - SAME)[:, None]) & (s > -np.inf))
            if len(q):
                merge_best(best_s, best_i, at[q], some_ids[c], np.round(s[q, c], 12))


def semantic_search_many(vectors: DataFrame | VectorIndex, queries: DataFrame, k: int = K, exclude_self: bool = True, keep: Column | DataFrame | None = None, compared: Accumulator | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest rows of vectors (id, embedding), of those that keep leaves, for every query (query_id, embedding).

    Query vectors are broadcast in blocks of a set size, and each task compares tiles of a set size and keeps only its k best for each query before the merge by query. In a
    VectorIndex a task compares the rows of a cell only with the queries whose k best so far the cell can still better; each query's
    first bound comes from its nearest cells. Null and zero vectors are nobody's neighbours. compared, if given, adds up the pairs compared.
    """
    index = vectors if isinstance(vectors, VectorIndex) else None
    rows = kept(index.rows if index is not None else vectors, keep).where("embedding is not null")
    rows = rows.select(F.col("id").cast("long"), "embedding", (F.col("_cell") if index is not None else F.lit(0)).alias("_cell"))
    context = rows.sparkSession.sparkContext
    size = queries.select(F.size("embedding").alias("n")).agg(F.count("*"), F.max("n")).first()
    width = max(size[1] or 1, 0 if index is None else len(index.sizes))  # a query's numbers, and its bounds for the cells
    blocks = max(1, -(-(size[0] or 0) * width // BLOCK_NUMBERS))

    def best(rows: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, bound, limit = shared.value
            best_s = np.full((len(ids), k), -np.inf)
            best_i = np.zeros((len(ids), k), np.int64)
            marks = np.array(ids, np.int64)
            for batch in batches:
                if not len(ids) or not batch.num_rows:
                    continue
                cells = batch.column(2).to_numpy()
                for cell in np.unique(cells).tolist():
                    at = np.flatnonzero(cells == cell)
                    own_ids = batch.column(0).to_numpy()[at]
                    own = unit_rows(batch.column(1).take(pa.array(at)))
                    far = np.sqrt(np.maximum(0, 2 - 2 * best_s[:, -1])) + SLACK
                    who = np.flatnonzero(bound[:, cell] <= np.minimum(limit, far))
                    if compared is not None:
                        compared.add(len(who) * len(at))
                    compare(matrix, marks, who, own, own_ids, best_s, best_i, exclude_self)
            q, c = np.nonzero(np.isfinite(best_s))
            yield pa.RecordBatch.from_arrays([pa.array(marks[q]), pa.array(best_i[q, c]), pa.array(best_s[q, c])], names=["query_id", "id", "similarity"])

        return rows.mapInArrow(run, "query_id long, id long, similarity double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))

    def one(block: int) -> DataFrame:
        own = queries.where((F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) & F.col("embedding").isNotNull()).select("query_id", "embedding").collect()
        own = [r for r in own if any(r[1])]
        ids, matrix = [r[0] for r in own], np.array([r[1] for r in own], float).reshape(len(own), -1 if own else 1)
        matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        limit = np.full(len(ids), np.inf)
        if index is None or not len(ids) or not len(index.sizes):
            return best(rows, context.broadcast((ids, matrix, np.zeros((len(ids), 1 if index is None else max(1, len(index.sizes)))), limit)))
        to = np.sqrt(np.maximum(0, 2 - 2 * matrix @ index.centres.T))
        bound = np.maximum(0, np.maximum(to - index.most, index.least - to) - SLACK)
        # First the cells that are some query's nearest by their bounds, each held against those queries alone.
        order = np.argsort(bound, axis=1, kind="stable")
        enough = (np.cumsum(index.sizes[order], axis=1) < k + 1).sum(axis=1)
        near = np.full(bound.shape, np.inf)
        for i, n in enumerate(enough.tolist()):
            near[i, order[i, : n + 1]] = 0
        first = best(rows.where(F.col("_cell").isin(np.flatnonzero((near == 0).any(axis=0)).tolist())), context.broadcast((ids, matrix, near, np.zeros(len(ids)))))
        least = first.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", "similarity").collect()  # a number for each query of the block
        place = {q: i for i, q in enumerate(ids)}
        for q, s in least:
            limit[place[q]] = np.sqrt(max(0.0, 2 - 2 * s)) + SLACK
        return best(rows, context.broadcast((ids, matrix, bound, limit)))

    hits = reduce(DataFrame.unionByName, map(one, range(blocks)))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def embed_text_input(x: Column | str, prefix: str = "passage: ") -> Column:
    """What is handed to an embedding; queries take the prefix "query: "."""
    return F.concat(F.lit(prefix), F.col(x) if isinstance(x, str) else x)
