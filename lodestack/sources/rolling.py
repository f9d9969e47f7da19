"""Files that roll over at a size: which file each record of an ordered table goes to.

A writer fills a file until the next record would pass the cap, then opens another. That is a loop over all records, but a range of
records is a function of how full the file is when the range begins: up to some record the open file takes them in; from there
on new files open at places that no longer depend on the start. Every range makes a table of this function, tables are composed
block by block, and once each range knows how full its first file is, every record finds its file by itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.sources.folders import shared_dir

#: A range has the records of so many full files or more (or of one partition).
RANGE_FILES = 2
#: Ranges are broadcast up to so many (a few numbers each).
BROADCAST_RANGES = 500_000
#: How full "no file yet" is: the first record opens one.
NONE_OPEN = (1 << 62) - 1
TABLE = "lo long, hi long, opened long, fill long, added long"


def jumps(ends: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a file opened at each record: how many files are open by the end of the records, and where the last of them began.

    ends: bytes up to and including each record. Jumps from file to file are doubled until none is left.
    """
    n = len(ends)
    before = np.concatenate(([0], ends[:-1]))
    to = np.append(np.maximum(np.searchsorted(ends, before + cap, "right"), np.arange(1, n + 1)), n)
    opened, last = np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
    while (to < n).any():  # to is where the files counted so far lead
        opened, last, to = opened + opened[to], np.where(to < n, last[to], last), to[to]
    return opened[:n], last[:n]


def table_of(sizes: np.ndarray, cap: int) -> pd.DataFrame:
    """A range as a function of the open file's fill: for lo < fill <= hi it opens so many files and ends with the last filled so far.

    Where added isn't null the open file takes in the whole range, which adds so much to it.
    """
    ends = np.cumsum(sizes, dtype=np.int64)
    opened, last = jumps(ends, cap)
    fill = ends[-1] - np.concatenate(([0], ends[:-1]))[last]
    first = np.flatnonzero(np.concatenate(([0], ends[:-1])) <= cap)  # records that may open the range's first new file
    lo, hi = np.maximum(cap - ends[first], -1), np.concatenate(([NONE_OPEN], cap - ends[first[:-1]]))
    rows = pd.DataFrame({"lo": lo, "hi": hi, "opened": opened[first], "fill": fill[first], "added": pd.array([pd.NA] * len(first), "Int64")})
    if ends[-1] <= cap:
        rows.loc[len(rows)] = [-1, cap - ends[-1], 0, 0, ends[-1]]
    rows = rows[rows["lo"] < rows["hi"]].sort_values("lo", ignore_index=True)
    same = (rows["opened"] == rows["opened"].shift()) & (rows["fill"] == rows["fill"].shift()) & rows["added"].isna() & rows["added"].shift().isna()
    ends_there = ~same.shift(-1, fill_value=False)  # neighbours with one outcome are one interval
    return rows[~same].assign(hi=rows["hi"][ends_there].to_numpy()).reset_index(drop=True)


def after(table: pd.DataFrame, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many files a function opens from each fill, and how full the last is then."""
    at = np.searchsorted(table["hi"].to_numpy(np.int64), fill)
    added = table["added"].to_numpy(np.int64, na_value=-1)[at]
    return table["opened"].to_numpy(np.int64)[at], np.where(added >= 0, fill + added, table["fill"].to_numpy(np.int64)[at])


def composed(one: pd.DataFrame | None, two: pd.DataFrame) -> pd.DataFrame:
    """The function that applies one, then two."""
    if one is None:
        return two
    fixed = one[one["added"].isna()]
    opened, fill = after(two, fixed["fill"].to_numpy(np.int64))
    out = [fixed.assign(opened=fixed["opened"].to_numpy(np.int64) + opened, fill=fill)]
    for row in one[one["added"].notna()].itertuples():  # one at most
        moved = two.assign(lo=(two["lo"] - row.added).clip(lower=row.lo), hi=(two["hi"] - row.added).clip(upper=row.hi), added=two["added"] + row.added)
        out.append(moved[moved["lo"] < moved["hi"]])
    return pd.concat(out).sort_values("lo", ignore_index=True)


def tables_in(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[int, int, pd.DataFrame]]:
    """(block, range, table) from rows sorted by block, range and lo."""
    kept: list[pd.DataFrame] = []
    for frame in frames:
        for key, part in frame.groupby(["block", "range"], sort=True):
            if kept and (kept[0]["block"].iat[0], kept[0]["range"].iat[0]) != key:
                yield int(kept[0]["block"].iat[0]), int(kept[0]["range"].iat[0]), pd.concat(kept, ignore_index=True)
                kept = []
            kept.append(part)
    if kept:
        yield int(kept[0]["block"].iat[0]), int(kept[0]["range"].iat[0]), pd.concat(kept, ignore_index=True)


def rolled(rows: DataFrame, order: list[Column | str], size: Column, cap: int, gap: int = 0) -> DataFrame:
    """rows with _file, the number of the file that each goes to in this order, and _first, whether it is the first there.

    A file takes records while their sizes (and gap for each further record) come to cap at most; a larger record has a file of its
    own. Rows that are equal in order and size may change places. Sizes are above 0.

    The rows are written once, dealt by ranges of the order; only numbers and sizes are looked at after that. A task holds the sizes of
    a range (RANGE_FILES files or a partition) or two tables of ranges; the driver sees a row for each block, of which there are as many as the
    square root of the number of ranges.
    """
    spark = rows.sparkSession
    cap = cap + gap
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    dealt = rows.withColumn("_bytes", size.cast("long") + gap).repartitionByRange(*order, "_bytes").sortWithinPartitions(*order, "_bytes")
    dealt.withColumn("_row", F.monotonically_increasing_id()).write.parquet(f"{base}/rows")
    written = spark.read.parquet(f"{base}/rows")
    part = F.shiftright("_row", 33)  # as monotonically_increasing_id() numbers rows
    parts = written.groupBy(part.alias("_part")).agg(F.sum("_bytes").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")  # a row for each partition
    grid = F.floor(before / (RANGE_FILES * cap))
    parts.select("_part", grid.alias("_grid")).select("_part", (F.dense_rank().over(Window.orderBy("_grid")) - 1).cast("long").alias("range")).write.parquet(f"{base}/parts")
    parts = spark.read.parquet(f"{base}/parts")
    n = parts.agg(F.max("range")).first()[0]
    if n is None:
        return written.select(*rows.columns, F.lit(0).cast("long").alias("_file"), F.lit(True).alias("_first"))
    per_block = int(np.sqrt(n + 1)) + 1
    sizes = written.select("_row", "_bytes", part.alias("_part")).join(F.broadcast(parts), "_part").select("range", "_row", "_bytes")

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["range"].iat[0])
        own = table_of(pdf.sort_values("_row")["_bytes"].to_numpy(), cap)
        return own.assign(range=number, block=number // per_block)[["block", "range", *own.columns]]

    schema = f"block long, range long, {TABLE}"
    sizes.groupBy("range").applyInPandas(tabulate, schema).write.parquet(f"{base}/tables")

    def blocks() -> DataFrame:
        return spark.read.parquet(f"{base}/tables").repartitionByRange("block").sortWithinPartitions("block", "range", "lo")

    def compose(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None
        for block, _, own in tables_in(frames):
            own = own[["lo", "hi", "opened", "fill", "added"]].astype({"added": "Int64"})
            if block != at and total is not None:
                yield total.assign(block=at)
                total = None
            at, total = block, composed(total, own)
        if total is not None:
            yield total.assign(block=at)

    blocks().mapInPandas(compose, f"{TABLE}, block long").write.parquet(f"{base}/blocks")
    functions = spark.read.parquet(f"{base}/blocks")
    opened, fill, starts = -1, NONE_OPEN, {}
    for block in range(n // per_block + 1):  # one row of each block's table
        starts[block] = (opened, fill)
        row = functions.where((F.col("block") == block) & (F.col("lo") < fill) & (F.col("hi") >= fill)).first()
        if row is not None:  # a block without records
            opened, fill = opened + row["opened"], row["fill"] if row["added"] is None else fill + row["added"]

    def enter(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, out, state = None, [], (0, 0)
        for block, number, own in tables_in(frames):
            if block != at:
                at, state = block, starts[block]
            out.append((number, *state))
            more, full = after(own.astype({"added": "Int64"}), np.array([state[1]]))
            state = (state[0] + int(more[0]), int(full[0]))
        if out:
            yield pd.DataFrame(out, columns=["range", "opened", "fill"])

    blocks().mapInPandas(enter, "range long, opened long, fill long").write.parquet(f"{base}/entered")

    def open_files(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row")
        ends, places = np.cumsum(pdf["_bytes"].to_numpy(np.int64)), pdf["_row"].to_numpy(np.int64)
        at, found = int(np.searchsorted(ends, cap - int(pdf["fill"].iat[0]), "right")), []
        while at < len(ends):
            found.append(int(places[at]))
            at = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + cap, "right")))
        return pd.DataFrame({"range": [int(pdf["range"].iat[0])], "opened": [int(pdf["opened"].iat[0])], "starts": [found]})

    entered = spark.read.parquet(f"{base}/entered")
    sizes.join(F.broadcast(entered) if n < BROADCAST_RANGES else entered, "range").groupBy("range").applyInPandas(open_files, "range long, opened long, starts array<long>").write.parquet(f"{base}/files")
    files = spark.read.parquet(f"{base}/files").join(parts, "range").select("_part", "opened", "starts")
    placed = written.withColumn("_part", part).join(F.broadcast(files) if n < BROADCAST_RANGES else files, "_part")
    own = F.size(F.filter("starts", lambda s: s <= F.col("_row")))
    return placed.select(*rows.columns, (F.col("opened") + own).alias("_file"), F.array_contains("starts", F.col("_row")).alias("_first"))
