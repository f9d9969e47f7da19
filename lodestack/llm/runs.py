"""Periodic runs of words, found in a grammar of the text.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that is long enough (LEAST_WORDS words
and LEAST_PERIODS times q) and that no neighbouring word extends keeping the period.

Re-Pair turns a text's word ids into a grammar: pairs of neighbouring symbols that occur twice or more give way to a symbol of
their own, the most frequent first, until none does. What is left of a text gets a balanced tree on top. A run crosses the middle
of exactly one smallest symbol or node that holds it, so for each of them, once, the runs across its middle are computed: such a
run has a square (q words twice) on one side of the middle. They are translated to all places where the symbol was put, and of
intervals with one period those that others hold go.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import named, table, text_batches

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: (Middle, period) pairs that are looked at together.
STEP = 1 << 20
PRIME = (1 << 31) - 1
RUNS = "array<struct<start:long,length:long,period:long>>"


@cache
def powers(n: int, base: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo PRIME; n is a power of two."""
    out = np.ones(n, np.int64)
    size, factor = 1, base
    while size < n:
        out[size : 2 * size] = out[:size] * factor % PRIME
        size, factor = 2 * size, factor * factor % PRIME
    return out


class Blocks:
    """Tells whether stretches of words are alike, by their polynomial hashes. Equal ones always are; unequal ones may seem so."""

    def __init__(self, words: np.ndarray, seed: int):
        self.base = 1_000_003 + 7_919 * seed
        self.powers = powers(1 << max(1, len(words) - 1).bit_length(), self.base)
        mixed = (words.astype(np.uint64) + np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(PRIME)).astype(np.int64)
        self.sums = np.concatenate(([0], np.cumsum(mixed * self.powers[: len(words)] % PRIME)))

    def alike(self, at: np.ndarray, apart: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the size words at these places equal those that are so far apart from them."""
        one = (self.sums[at + size] - self.sums[at]) % PRIME
        two = (self.sums[at + apart + size] - self.sums[at + apart]) % PRIME
        return one * self.powers[apart] % PRIME == two

    def reach(self, at: np.ndarray, apart: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from each place (or, going back, before it) equal those so far apart, up to most."""
        done = np.zeros(len(at), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            tried = done + (1 << bit)
            fits = np.flatnonzero(tried <= most)
            size = tried[fits]
            fits = fits[self.alike(at[fits] - size if back else at[fits], apart[fits], size)]
            done[fits] = tried[fits]
        return done


def grammar(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Re-Pair: starts, middles and ends of one place of each rule, where rules were put (rules, places), and where the symbols left start.

    Each round replaces, at once, the pairs that are more frequent than those that overlap them (among equals the order is a hash's).
    A pair that occurs once is looked at again only when one of its symbols gives way.
    """
    n, rules = len(words), 0
    symbol = np.append(words.astype(np.int64), -1)
    following, before = np.arange(1, n + 2), np.arange(-1, n)
    following[-1] = n
    rank = np.zeros(n + 1, np.int64)
    next_symbol = int(words.max(initial=0)) + 1
    begin, middle, end, put = [], [], [], []
    places = np.arange(max(n - 1, 0))
    while len(places):
        follower = following[places]
        pairs, which = np.unique(symbol[places] << 32 | symbol[follower], return_inverse=True)
        chained = np.concatenate(([False], (follower[:-1] == places[1:]) & (which[1:] == which[:-1])))
        at = np.arange(len(places))
        even = (at - np.maximum.accumulate(np.where(chained, 0, at))) % 2 == 0  # of a a a a the first and third pair
        count = np.bincount(which[even], minlength=len(pairs))
        kept = count[which] > 1
        places, follower, which, even = places[kept], follower[kept], which[kept], even[kept]
        own = count[which] << 32 | (which * 0x9E3779B1 & 0xFFFFFFFF)
        rank[places] = own
        chosen = even & (own >= rank[before[places]]) & (own >= rank[follower])
        rank[places] = 0
        chosen &= np.bincount(which[chosen], minlength=len(pairs))[which] > 1
        left, right = places[chosen], follower[chosen]
        if len(left):
            _, first, rule = np.unique(which[chosen], return_index=True, return_inverse=True)
            after = following[right]
            begin.append(left[first])
            middle.append(right[first])
            end.append(after[first])
            put.append((rule + rules, left))
            symbol[left] = next_symbol + rule
            symbol[right] = -1
            following[left] = after
            before[after] = left
            rules += len(first)
            next_symbol += len(first)
            places = np.unique(np.concatenate([places[symbol[places] >= 0], left, before[left][before[left] >= 0]]))
            places = places[following[places] < n]
        else:
            places = places[:0]
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return joined(begin), joined(middle), joined(end), put, np.flatnonzero(symbol[:n] >= 0)


def crossing(words: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray, blocks: Blocks) -> tuple[np.ndarray, ...]:
    """The runs in words[low:high] across mid, for each of the given: (number of the given, start, end, period)."""
    found = [np.zeros((4, 0), np.int64)]
    most = (high - low) // LEAST_PERIODS
    for right in (True, False):
        room = np.minimum(most, (high - mid if right else mid - low) // 2)
        room[high - low < LEAST_WORDS] = 0
        edge = mid if right else mid - 1
        given = np.flatnonzero(room)
        total = np.cumsum(room[given])
        cuts = np.searchsorted(total, np.arange(STEP, (total[-1] if len(total) else 0) + STEP, STEP))
        for i, j in zip([0, *(cuts[:-1] + 1)], [*(cuts[:-1] + 1), len(given)], strict=True):
            some = given[i:j]
            sizes = room[some]
            period = np.arange(1, sizes.sum() + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            place = np.repeat(edge[some], sizes)
            same = np.flatnonzero(words[place] == words[place + period if right else place - period])
            period, of = period[same], np.repeat(some, sizes)[same]
            anchor = mid[of] if right else mid[of] - period
            square = blocks.alike(anchor if right else anchor - period, period, period)
            period, of, anchor = period[square], of[square], anchor[square]
            end = anchor + period + blocks.reach(anchor, period, high[of] - anchor - period, False)
            start = anchor - blocks.reach(anchor, period, anchor - low[of], True)
            good = (start < mid[of]) & (end > mid[of]) & (end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period))
            found.append(np.stack([of, start, end, period])[:, good])
    of, start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start, of))
    of, start, end, period = of[order], start[order], end[order], period[order]
    new = np.ones(len(of), bool)  # multiples of a period cover the same stretch
    new[1:] = (of[1:] != of[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return of[new], start[new], end[new], period[new]


def runs_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the runs of several texts in a row, by start and period.

    words are ids that no two texts share; bounds say where each text starts and where the last ends.
    """
    begin, middle, end, put, left = grammar(words)
    # A balanced tree over the symbols left of each text: the node whose middle is the i-th reaches as far as the lowest bit of i.
    text = np.searchsorted(bounds, left, "right") - 1
    first = np.searchsorted(left, bounds[:-1])[text]
    last = np.searchsorted(left, bounds[1:])[text]
    own = np.arange(len(left))
    inner = own > first
    low_bit = (own - first) & (first - own)
    starts = np.append(left, len(words))
    over = own + low_bit < last
    node_end = np.where(over, starts[np.minimum(own + low_bit, len(left))], bounds[1:][text] if len(left) else 0)
    low = np.concatenate([begin, starts[own - low_bit][inner]])
    mid = np.concatenate([middle, left[inner]])
    high = np.concatenate([end, node_end[inner]])
    for seed in range(64):
        of, start, stop, period = crossing(words, low, mid, high, Blocks(words, seed))
        if all(np.array_equal(words[a : b - q], words[a + q : b]) for a, b, q in zip(start.tolist(), stop.tolist(), period.tolist(), strict=True)):
            break
    else:
        raise RuntimeError("hashes of different stretches agree for 64 bases")
    # To every place of a rule; those of nodes have one place.
    of_rule = of < len(begin)
    parts = [np.stack([start, stop, period])[:, ~of_rule]]
    if of_rule.any():
        rule, place = (np.concatenate(x) for x in zip(*put, strict=True))
        order = np.argsort(rule, kind="stable")
        rule, place = rule[order], place[order]
        a, b = np.searchsorted(rule, of[of_rule]), np.searchsorted(rule, of[of_rule], "right")
        which = np.repeat(np.flatnonzero(of_rule), b - a)
        at = place[np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)]
        shift = at - begin[of[which]]
        parts.append(np.stack([start[which] + shift, stop[which] + shift, period[which]]))
    start, stop, period = np.concatenate(parts, axis=1)
    # Of intervals with one period the maximal ones.
    order = np.lexsort((-stop, start, period))
    start, stop, period = start[order], stop[order], period[order]
    new_period = np.cumsum(np.concatenate(([0], period[1:] != period[:-1]))) if len(period) else period
    reached = np.maximum.accumulate(stop + new_period * (len(words) + 1)) if len(stop) else stop
    maximal = np.ones(len(stop), bool)
    maximal[1:] = stop[1:] + new_period[1:] * (len(words) + 1) > reached[:-1]
    start, stop, period = start[maximal], stop[maximal], period[maximal]
    order = np.lexsort((period, start))
    return start[order], stop[order], period[order]


def word_ids(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts in a row, ids of them that no two texts share, and where each text's words start (and the last's end)."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = split.flatten()
    sizes = split.value_lengths().to_numpy()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate(([0], np.cumsum(real)))[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))]
    if not real.all():  # white space at either end of a text leaves an empty word
        words = words.filter(pa.array(real))
    coded = words.dictionary_encode()
    key = coded.indices.to_numpy().astype(np.int64) + np.repeat(np.arange(len(texts)), np.diff(bounds)) * max(1, len(coded.dictionary))
    return words, np.unique(key, return_inverse=True)[1], bounds


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, collapsed) of every row of docs: runs by start and period, and the text with each run cut to its first period.

    Words are what white space (0x20, 0x09-0x0D) parts; runs have their start as a word's number, their length and period in words.
    collapsed are the words that no run holds beyond its first period, joined by single spaces. Null texts count as empty and have no
    runs; rows that repeat are each answered; an empty table gives an empty result; further columns are not read. A text is held
    whole by its task, with some 200 bytes of memory for each word; time grows with words times the logarithm of their number.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2 << 20):
            words, ids, bounds = word_ids(batch.column(1))
            start, stop, period = runs_of(ids, bounds)
            of = np.searchsorted(bounds, start, "right") - 1
            struct = pa.StructArray.from_arrays([pa.array(x) for x in (start - bounds[of], stop - start, period)], names=["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32()), struct)
            change = np.bincount(start + period, minlength=len(ids) + 1) - np.bincount(stop, minlength=len(ids) + 1)
            kept = np.cumsum(change)[:-1] == 0
            places = np.concatenate(([0], np.cumsum(kept)))[bounds]
            words = words.filter(pa.array(kept)) if len(start) else words
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(places, pa.int32()), words), " ")
            yield pa.RecordBatch.from_arrays([batch.column(0), runs, collapsed], names=["key", "runs", "collapsed"])

    picked = named(docs, key, text)
    return picked.mapInArrow(run, f"key {picked.schema[0].dataType.simpleString()}, runs {RUNS}, collapsed string").withColumnRenamed("key", key)


def with_repeats(doc_id: Column, text: Column) -> Column:
    """The text, of one document in ten with a stretch of its words repeated to its end: which and how is told by the id's checksum.

    Such a text's words come joined by single spaces. Documents without an id or without words stay as they are.
    """
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int"))), " "))

    return F.coalesce(F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), F.lit(0))), text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = collapse_runs(docs).withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
