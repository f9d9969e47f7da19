"""Similar issues: assembled contents, and TF-IDF over them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions.text import tokenize
from lodestack.operators.vectors import merge_best
from lodestack.sources.folders import shared_dir

#: Weights are whole numbers of 1 / UNIT.
UNIT = 10_000
#: Rounds of similar_pairs: terms of up to FIRST_ROUND issues, then up to ROUND_FACTOR times as many each.
FIRST_ROUND, ROUND_FACTOR = 64, 8
#: A term's issues are dealt to a key for each so many.
BLOCK = 2_000
#: Pairs are made as rows for terms of up to so many issues; issues that need more frequent ones are held against all others by blocks.
PAIRED = 500
#: Terms of issues in one broadcast block, and candidates that a task holds before it keeps the best.
ASKED_ROWS, HELD = 2_000_000, 500_000


def build_issue_contents(issues: DataFrame, journals: DataFrame, attachments: DataFrame) -> DataFrame:
    """(issue_id, project_id, subject, status_id, content): subject, description, notes by id, attachments by id.

    A null description is an empty line; blank notes and null attachment descriptions are left out.
    """
    part = lambda df, key, order, ident, sub, text: df.select(F.col(key).alias("issue_id"), F.lit(order).alias("o"), F.col(ident).alias("i"), F.lit(sub).alias("s"), F.coalesce(text, F.lit("")).alias("t"))
    notes = journals.where((F.col("journalized_type") == "Issue") & (F.trim(F.coalesce("notes", F.lit(""))) != ""))
    files = attachments.where("container_type = 'Issue'")
    described = files.where((F.col("description").isNotNull()) & (F.trim("description") != ""))
    parts = (
        part(issues, "id", 0, "id", 0, F.col("subject"))
        .union(part(issues, "id", 1, "id", 0, F.col("description")))
        .union(part(notes, "journalized_id", 2, "id", 0, F.col("notes")))
        .union(part(files, "container_id", 3, "id", 0, F.col("filename")))
        .union(part(described, "container_id", 3, "id", 1, F.col("description")))
    )
    joined = parts.groupBy("issue_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "i", "s", "t"))), lambda x: x["t"]), "\n").alias("content"))
    head = issues.select(F.col("id").alias("issue_id"), "project_id", "subject", "status_id")
    return head.join(joined, "issue_id")


def refresh_issue_contents(contents: DataFrame, issues: DataFrame, journals: DataFrame, attachments: DataFrame, changed: DataFrame) -> DataFrame:
    """contents after a batch of changed (entity, id, issue_id, op): only what it touches is assembled anew.

    Issues, journals and removed attachments refresh their issue; an added attachment waits for its issue's next change.
    """
    touched = changed.where("not (entity = 'Attachment' and op = 'upsert')").select("issue_id").distinct()
    own = lambda df, key: df.join(touched.withColumnRenamed("issue_id", key), key, "left_semi")
    fresh = build_issue_contents(own(issues, "id"), own(journals, "journalized_id"), own(attachments, "container_id"))
    return contents.join(touched, "issue_id", "left_anti").unionByName(fresh.select(*contents.columns))


@dataclass
class Weights:
    """Term weights of a set of contents, stored twice: by term for finding issues, by issue for looking into them.

    A row (issue_id, project_id, term, w, df, rank) for every term of an issue with a weight over 0: w is tf times idf in units of
    1 / UNIT, a whole number, so that sums are exact and don't depend on their order; df is how many issues hold the term; rank is
    the term's place among its issue's, by weight, then term.
    """

    by_term: DataFrame
    by_issue: DataFrame


def term_weights(contents: DataFrame) -> DataFrame:
    """The rows of Weights. Terms that all issues hold have no weight and no row; null contents count as empty."""
    tf = contents.select("issue_id", "project_id", F.explode(tokenize(F.lower("content"))).alias("term")).groupBy("issue_id", "project_id", "term").agg(F.count("*").alias("tf"))
    n = contents.select(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).where("df < n").select("term", "df", F.log(F.col("n") / F.col("df")).alias("idf"))
    w = tf.join(df, "term").select("issue_id", "project_id", "term", F.floor(F.col("tf") * F.col("idf") * UNIT + 0.5).cast("double").alias("w"), "df").where("w > 0")
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("issue_id").orderBy(F.desc("w"), "term")))


def write_weights(contents: DataFrame, folder: str) -> None:
    """Writes the weights of contents: sorted by term (a frequent term's issues in several files) and by issue, so that a search reads only its own."""
    spark = contents.sparkSession
    term_weights(contents).repartitionByRange("issue_id").sortWithinPartitions("issue_id", "rank").write.mode("overwrite").parquet(f"{folder}/issues")
    by_issue = spark.read.parquet(f"{folder}/issues")
    by_issue.repartitionByRange("term", "issue_id").sortWithinPartitions("term", "issue_id").write.mode("overwrite").parquet(f"{folder}/terms")


def read_weights(spark: SparkSession, folder: str) -> Weights:
    return Weights(spark.read.parquet(f"{folder}/terms"), spark.read.parquet(f"{folder}/issues"))


def weights_of(contents: DataFrame | Weights) -> Weights:
    """Stored weights as they are; those of contents, written once to the shared folder."""
    if isinstance(contents, Weights):
        return contents
    folder = f"{shared_dir(contents.sparkSession)}/{uuid.uuid4().hex}"
    write_weights(contents, folder)
    return read_weights(contents.sparkSession, folder)


def similar_issues(contents: DataFrame | Weights, issue_id: int, limit: int = 5, projects: DataFrame | None = None, top_terms: int = 30) -> DataFrame:
    """(issue_id, score): other issues by the sum of tf-idf over the best terms of one issue, best first.

    Of stored weights only the rows of that issue and of its top_terms terms are read.
    """
    w = weights_of(contents)
    mine = {r["term"]: r["w"] for r in w.by_issue.where((F.col("issue_id") == issue_id) & (F.col("rank") <= top_terms)).select("term", "w").collect()}  # top_terms rows
    own = F.create_map(*[F.lit(x) for pair in mine.items() for x in pair])[F.col("term")] if mine else F.lit(0.0)
    hits = w.by_term.where(F.col("term").isin(sorted(mine)) & (F.col("issue_id") != issue_id))
    if projects is not None:
        hits = hits.join(projects.select("project_id").distinct(), "project_id", "left_semi")
    scored = hits.groupBy("issue_id").agg((F.sum(F.col("w") * own) / UNIT**2).alias("score"))
    return scored.orderBy(F.desc("score"), "issue_id").limit(limit)


def by_blocks(asked: DataFrame, weights: DataFrame, limit: int, kept: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(issue_id, other_id, score): for every issue of asked (issue_id, term, own, least) its limit best by all its terms, none of which is below least.

    A block of ASKED_ROWS terms of issues is broadcast, and a task sums up one other issue after the other for all issues of the block: no pair becomes
    a row but the task's best of each issue. The products grow with the square of the issues; rows, memory and what is shuffled don't.
    """
    spark = weights.sparkSession
    terms = kept(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    dealt = kept(weights.join(terms, "term").select(F.col("issue_id").cast("long").alias("other_id"), "t", "w").repartitionByRange("other_id").sortWithinPartitions("other_id"), "dealt")
    asked = kept(asked.join(terms, "term").select(F.col("issue_id").cast("long").alias("issue_id"), "t", "own", "least"), "asked")
    blocks = max(1, -(-asked.count() // ASKED_ROWS))

    def one(block: int) -> DataFrame:
        rows = asked.where(F.pmod(F.xxhash64("issue_id"), F.lit(blocks)) == block).toArrow()
        q, t, own, least = (rows.column(c).to_numpy() for c in ("issue_id", "t", "own", "least"))
        ids, first, q = np.unique(q, return_index=True, return_inverse=True)
        order = np.argsort(t, kind="stable")
        marks, starts = np.unique(t[order], return_index=True)
        shared = spark.sparkContext.broadcast((ids, least[first], marks, np.append(starts, len(t)), q[order].astype(np.int32), own[order]))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, least, marks, starts, q, own = shared.value
            best_s, best_i = np.full((len(ids), limit), -np.inf), np.zeros((len(ids), limit), np.int64)
            least = np.maximum(least, 0.5)  # sums are whole numbers
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

            def keep_best() -> None:
                if held:
                    merge_best(best_s, best_i, *map(np.concatenate, zip(*held)))
                    np.maximum(least, best_s[:, -1], out=least)
                    held.clear()

            def add(other: int, at: np.ndarray, w: np.ndarray) -> int:
                spans = [slice(starts[a], starts[a + 1]) for a in at]
                parts = np.concatenate([own[x] for x in spans])
                parts *= np.repeat(w, starts[at + 1] - starts[at])
                score = np.bincount(np.concatenate([q[x] for x in spans]), parts, len(ids))
                who = np.flatnonzero(score >= least)
                who = who[ids[who] != other]
                held.append((who, np.full(len(who), other), score[who]))
                return len(who)

            n = 0
            for other, t, w in whole(batches):
                at = np.searchsorted(marks, t)
                known = marks[np.minimum(at, len(marks) - 1)] == t if len(marks) else np.zeros(len(t), bool)
                if known.any():
                    n += add(other, at[known], w[known])
                if n > HELD:
                    keep_best()
                    n = 0
            keep_best()
            found, c = np.nonzero(np.isfinite(best_s))
            yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(best_i[found, c]), pa.array(best_s[found, c])], names=["issue_id", "other_id", "score"])

        return kept(dealt.mapInArrow(run, "issue_id long, other_id long, score double"), f"block{block}")

    return reduce(DataFrame.unionByName, map(one, range(blocks)))


def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(other_id, terms, weights) of issues whose rows follow each other, over the ends of batches."""
    rest = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns)]
        ends = np.flatnonzero(np.diff(columns[0])) + 1
        for a, b in zip(np.append(0, ends[:-1]), ends):
            yield int(columns[0][a]), columns[1][a:b], columns[2][a:b]
        rest = [c[ends[-1] if len(ends) else 0 :] for c in columns]
    if rest is not None and len(rest[0]):
        yield int(rest[0][0]), rest[1], rest[2]


def similar_pairs(contents: DataFrame | Weights, limit: int = 5, top_terms: int = 30, report: list[dict] | None = None) -> DataFrame:
    """(issue_id, other_id, score, rank): similar_issues() for every issue at once, exactly.

    An issue's terms are taken in the order of their frequency, in rounds. Rare terms bring other issues in; what the terms still to come can
    add at most (own weight times the term's largest) bounds every issue that has not been met. As soon as the limit-th
    best sum so far is above that, no unmet issue can be among the best: only those met that can still reach it are looked
    into, by issue, and the frequent terms' pairs are never made. Issues that terms of up to PAIRED issues don't settle are held against all others by
    blocks (by_blocks). A frequent term's issues are dealt to several keys, so no key has more than BLOCK squared of its pairs, about. report, if given, gets a row for each round: the greatest frequency, issues asked and pairs made.
    """
    w = weights_of(contents)
    spark = w.by_term.sparkSession
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    largest = w.by_term.groupBy("term").agg(F.max("w").alias("most"))
    source = w.by_issue.where(F.col("rank") <= top_terms).select("issue_id", "term", F.col("w").alias("own"), "df").join(largest, "term")
    source = kept(source.select("issue_id", "term", "own", "df", (F.col("own") * F.col("most")).alias("bound")), "source")
    other = w.by_term.select("term", F.col("issue_id").alias("other_id"), "w", "df")
    top = source.agg(F.max("df")).first()[0]
    if top is None:
        return spark.createDataFrame([], f"issue_id {source.schema['issue_id'].dataType.simpleString()}, other_id {source.schema['issue_id'].dataType.simpleString()}, score double, rank int")
    active, sums, done = source.select("issue_id").distinct(), None, []
    low, high, turn = 0, FIRST_ROUND, 0
    best = Window.partitionBy("issue_id").orderBy(F.desc("score"), "other_id")
    while True:
        mine = source.where((F.col("df") > low) & (F.col("df") <= high)).join(active, "issue_id", "left_semi")
        parts = F.ceil(F.col("df") / BLOCK).cast("int")  # keys that a term's issues are dealt to, on either side
        part = lambda c: F.pmod(F.xxhash64(c), parts).cast("int")
        all_parts = F.explode(F.sequence(F.lit(0), parts - 1))
        asked = mine.select("issue_id", "term", "own", part("issue_id").alias("part"), all_parts.alias("other_part"))
        dealt = other.where((F.col("df") > low) & (F.col("df") <= high)).select("term", "other_id", "w", part("other_id").alias("other_part"), all_parts.alias("part"))
        pairs = asked.join(dealt, ["term", "part", "other_part"]).where("issue_id <> other_id").select("issue_id", "other_id", (F.col("own") * F.col("w")).alias("s"))
        before = None if sums is None else sums.join(active, "issue_id", "left_semi").select("issue_id", "other_id", F.col("score").alias("s"), F.col("n"))
        new = pairs.withColumn("n", F.lit(1).cast("long"))
        sums = kept((new if before is None else new.unionByName(before)).groupBy("issue_id", "other_id").agg(F.sum("s").alias("score"), F.sum("n").alias("n")), f"sums{turn}")
        # What is still to come, and the limit-th best so far (0 where fewer were met).
        rest = source.join(active, "issue_id", "left_semi").groupBy("issue_id").agg(F.sum(F.when(F.col("df") > high, F.col("bound")).otherwise(0.0)).alias("rest"))
        least = sums.withColumn("r", F.row_number().over(best)).where(F.col("r") == limit).select("issue_id", F.col("score").alias("least"))
        state = kept(rest.join(least, "issue_id", "left").fillna(0.0, ["least"]).withColumn("settled", (F.col("rest") == 0) | (F.col("least") > F.col("rest"))), f"state{turn}")
        if report is not None:
            made = sums.agg(F.sum("n")).first()[0] or 0
            report.append({"most_df": min(high, top), "issues": active.count(), "pairs": made - (before.agg(F.sum("n")).first()[0] or 0 if before is not None else 0)})
        ready = state.where("settled")
        near = sums.join(ready, "issue_id").where("score + rest >= least").select("issue_id", "other_id", "score")
        if high < top:
            late = source.where(F.col("df") > high).join(ready.where("rest > 0"), "issue_id", "left_semi").select("issue_id", "term", "own")
            looked = near.join(late, "issue_id").join(w.by_issue.select(F.col("issue_id").alias("other_id"), "term", "w"), ["other_id", "term"])
            near = near.unionByName(looked.select("issue_id", "other_id", (F.col("own") * F.col("w")).alias("score"))).groupBy("issue_id", "other_id").agg(F.sum("score").alias("score"))
        done.append(kept(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit), f"best{turn}"))
        active = state.where("not settled").select("issue_id")
        if high >= top or active.isEmpty():
            break
        low, high, turn = high, high * ROUND_FACTOR, turn + 1
        if min(high, top) > PAIRED:
            asked = source.join(state.where("not settled").select("issue_id", "least"), "issue_id")
            if report is not None:
                report.append({"most_df": top, "issues": active.count(), "pairs": asked.agg(F.sum("df")).first()[0]})
            late = by_blocks(asked.select("issue_id", "term", "own", "least"), w.by_issue.select("issue_id", "term", "w"), limit, kept)
            kind = source.schema["issue_id"].dataType
            late = late.select(F.col("issue_id").cast(kind).alias("issue_id"), F.col("other_id").cast(kind).alias("other_id"), "score")
            done.append(late.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit))
            break
    return reduce(DataFrame.unionByName, done).select("issue_id", "other_id", (F.col("score") / UNIT**2).alias("score"), "rank")
