"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import written


def state_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Vertices of edges (u, v) with the smallest vertex of their component: (vertex, root).

    Alternates two steps until neither changes an edge: every vertex hands its larger neighbours, then its
    smaller ones, to the smallest vertex it knows. Each step is a minimum by key (combined before the shuffle)
    joined back by key, so a vertex with very many neighbours is never gathered in one group, and the join is
    one that Spark can split where the key is skewed. Rounds grow with the logarithm of the size. Every round
    is written to the shared folder. Self-loops, repeated edges and nulls count for nothing; an empty input gives
    an empty result.
    """
    now = written(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    before = state_of(now)
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = written(small)
        if (state := state_of(now)) == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(now.select("v", "v").distinct().toDF("vertex", "root"))
