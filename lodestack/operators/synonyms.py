"""Synonyms: the table of query expansions, and pairs found by word similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.text import nfkc_lower

#: Japanese particles that a word may not start or end with.
PARTICLES = "がでとにのはもを"


def sync_expansions(table: DataFrame, pairs: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(the new table, rejected rows): exactly the pairs given, with created_at kept for those already there.

    table: source, destination, created_at, updated_at; pairs: source, destination. Blank words are rejected.
    """
    now = F.current_timestamp() if now is None else now
    blank = (F.trim(F.coalesce("source", F.lit(""))) == "") | (F.trim(F.coalesce("destination", F.lit(""))) == "")
    old = table.groupBy("source", "destination").agg(F.min("created_at").alias("created_at"))
    kept = pairs.where(~blank).select("source", "destination").distinct().join(old, ["source", "destination"], "left")
    return kept.select("source", "destination", F.coalesce("created_at", now).alias("created_at"), now.alias("updated_at")), pairs.where(blank)


def list_expansions(table: DataFrame, order: str = "source", descending: bool = False, offset: int = 0, limit: int = 25) -> tuple[DataFrame, DataFrame]:
    """(a page, a row with the count), by source and destination or by created_at or updated_at first."""
    keys = [order, *[c for c in ("source", "destination") if c != order]]
    df = table.orderBy(F.desc(keys[0]) if descending else F.asc(keys[0]), *keys[1:])
    return df.offset(offset).limit(limit), table.agg(F.count("*").alias("n"))


def normalize_word(x: Column | str) -> Column:
    return F.trim(nfkc_lower(F.replace(F.col(x) if isinstance(x, str) else x, F.lit("▁"), F.lit(" "))))


def filter_similar_words(pairs: DataFrame, cosine: float = 0.99, engine: str | None = None, ascii_only: bool = False) -> DataFrame:
    """Pairs (source, destination, cosine, engine) of words that are worth being synonyms, normalised.

    Dropped: words with a space, of one character, of digits, punctuation and symbols only, or with a particle at either end;
    pairs with a word beyond ASCII where one holds the other; pairs below the least cosine (null passes) or of another engine.
    """
    lower = (lambda c: F.trim(F.lower(F.replace(F.col(c), F.lit("▁"), F.lit(" "))))) if ascii_only else normalize_word
    df = pairs.withColumns({"source": lower("source"), "destination": lower("destination")})
    for c in ("source", "destination"):
        df = df.where(~F.col(c).contains(" ") & (F.length(c) > 1) & ~F.col(c).rlike(r"^[\p{N}\p{P}\p{S}]*$") & ~F.col(c).rlike(f"^[{PARTICLES}]|[{PARTICLES}]$"))
    beyond = ~F.col("source").rlike(r"^[\x00-\x7F]*$") | ~F.col("destination").rlike(r"^[\x00-\x7F]*$")
    df = df.where(~(beyond & (F.col("source").contains(F.col("destination")) | F.col("destination").contains(F.col("source")))))
    if "cosine" in df.columns:
        df = df.where(F.col("cosine").isNull() | (F.col("cosine") >= cosine))
    return df.where(F.col("engine") == engine) if engine is not None and "engine" in df.columns else df


def symmetric_expansions(pairs: DataFrame) -> DataFrame:
    """(source, destination), sorted: both directions of every pair, and each word for itself if it has another."""
    p = pairs.select("source", "destination")
    both = p.union(p.select("destination", "source"))
    all_rows = both.union(both.select("source", F.col("source").alias("destination"))).distinct()
    n = F.count("*").over(Window.partitionBy("source"))
    return all_rows.withColumn("_n", n).where("_n > 1").drop("_n").orderBy("source", "destination")
