"""Language-model scores from a lattice of subwords.

The vocabulary is that of an existing tokenizer. Its pieces never reach across white space, so the probability of a
text is that of its words (each with a space before it) and of the end, and the probability of a word is the sum over
all ways to cut it into pieces, found by a forward recursion in log space over its bytes. Single bytes are pieces too,
so every word has a probability.

The vocabulary's own scores are ranks; they weigh the segmentations first (a piece of rank r by 1 / (r + 3)). One
round of expectation over the distinct words of the training texts, each as often as it occurs, gives the expected
number of uses of each piece, and these with the first weights as pseudo-counts make the probabilities.

Beside it stands the base score: the words' own counts in the training texts with half added to each.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from math import exp, log, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import OUT_ROWS, named, table, text_batches, words_of, written

VOCABULARY = "piece_bpe_32k.model"
#: Total weight of the pseudo-counts, and the share of words that makes a word common: there are at most that many.
PRIOR_WEIGHT, COMMON_SHARE = 32_000.0, 400_000
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 300_000
RANK_OFFSET = 3
#: From so many bytes on the pieces of a word aren't kept: it takes some ten bytes of memory for each of its own.
LONG_WORD = 1000
LN10 = log(10)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


@cache
def vocabulary(name: str) -> tuple[list[bytes], np.ndarray]:
    """The pieces as bytes (a space where a word starts), and their first weights, which sum to 1."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    rank: dict[bytes, float] = {}
    last = float(model.vocab_size())
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if piece.rfind(b" ") <= 0:
            rank[piece] = min(rank.get(piece, last), -model.get_score(i))
    for b in range(256):
        rank.setdefault(bytes([b]), last)
    pieces = sorted(rank)
    weights = np.array([1 / (rank[p] + RANK_OFFSET) for p in pieces])
    return pieces, weights / weights.sum()


@dataclass
class Lattice:
    """Pieces by their bytes: (place, log-probability); a place of -1 marks what only begins longer pieces."""

    arcs: dict[bytes, tuple[int, float]]

    @classmethod
    def of(cls, pieces: list[bytes], weights: np.ndarray) -> Lattice:
        arcs: dict[bytes, tuple[int, float]] = {}
        for p in pieces:
            for n in range(1, len(p)):
                arcs.setdefault(p[:n], (-1, 0.0))
        arcs.update((p, (i, w)) for i, (p, w) in enumerate(zip(pieces, np.log(weights).tolist(), strict=True)))
        return cls(arcs)

    def pieces_in(self, word: bytes) -> list[list[tuple[int, int, float]]]:
        """For every place of word the pieces that start there: (end, piece, log-probability)."""
        get, n, out = self.arcs.get, len(word), []
        for i in range(n):
            own = []
            for j in range(i + 1, n + 1):
                arc = get(word[i:j])
                if arc is None:
                    break
                if arc[0] >= 0:
                    own.append((j, *arc))
            out.append(own)
        return out

    def forward(self, found: list[list[tuple[int, int, float]]]) -> list[float]:
        """The log-probability of reaching each place over all segmentations."""
        terms: list[list[float]] = [[] for _ in range(len(found) + 1)]
        terms[0] = [0.0]
        out = []
        for i, own in enumerate(terms):
            out.append(at := own[0] if len(own) == 1 else log_sum(own))
            if i < len(found):
                for j, _, w in found[i]:
                    terms[j].append(at + w)
        return out

    def arcs_at(self, word: bytes, i: int) -> list[tuple[int, int, float]]:
        get, own = self.arcs.get, []
        for j in range(i + 1, len(word) + 1):
            arc = get(word[i:j])
            if arc is None:
                break
            if arc[0] >= 0:
                own.append((j, *arc))
        return own

    def ahead(self, word: bytes) -> array:
        """forward() without keeping the pieces: the sums that are open reach no further than the longest piece."""
        open_sums, out = {0: [0.0]}, array("d")
        for i in range(len(word) + 1):
            out.append(at := log_sum(open_sums.pop(i)))
            for j, _, w in self.arcs_at(word, i):
                open_sums.setdefault(j, []).append(at + w)
        return out

    def score(self, word: bytes) -> float:
        word = b" " + word
        return self.ahead(word)[-1] if len(word) > LONG_WORD else self.forward(self.pieces_in(word))[-1]

    def expected(self, word: bytes, times: int, into: dict[int, float]) -> None:
        """Adds the expected number of uses of each piece in so many occurrences of word."""
        word = b" " + word
        is_long = len(word) > LONG_WORD
        found = None if is_long else self.pieces_in(word)
        ahead = self.ahead(word) if is_long else self.forward(found)
        behind = array("d", bytes(8 * len(ahead)))
        for i in range(len(word) - 1, -1, -1):
            own = self.arcs_at(word, i) if is_long else found[i]
            behind[i] = log_sum([w + behind[j] for j, _, w in own])
            for j, k, w in own:
                into[k] += times * exp(ahead[i] + w + behind[j] - ahead[-1])


def log_sum(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    top = max(terms)
    return top + log(sum([exp(t - top) for t in terms]))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, trained, occurs): how often each word of docs (doc_id, text) occurs in training texts and in all."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained: Counter = Counter()
        tested: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for words, mine in ((trained, 1), (tested, 0)):
                keys, counts = list(words), list(words.values())
                for i in range(0, len(keys), OUT_ROWS):
                    n = np.array(counts[i : i + OUT_ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + OUT_ROWS], pa.binary()), pa.array(n * mine), pa.array(n)], names=["word", "trained", "occurs"])
                words.clear()

        for batch in text_batches(batches):
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (tested if held_out(doc) else trained).update(words_of(text))
                if len(trained) + len(tested) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, "word binary, trained long, occurs long").groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("occurs").alias("occurs"))


@dataclass
class Model:
    lattice: Lattice
    end: float  # natural logarithm
    train_tokens: int
    distinct: int
    end_count: int

    def base(self, count: int) -> float:
        return log10((count + 0.5) / (self.train_tokens + 0.5 * (self.distinct + 1)))


def fit(words: DataFrame, documents: int, name: str = VOCABULARY) -> Model:
    """The model of the training words of words (word, trained, ...) and of so many training texts."""

    def uses(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice.of(*vocabulary(name)), defaultdict(float)
        for batch in batches:
            for word, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lattice.expected(word, times, total)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.float64())], names=["piece", "uses"])

    trained = words.where("trained > 0").select("word", "trained")
    sums = trained.agg(F.sum("trained"), F.count("*")).first()
    pieces, weights = vocabulary(name)
    counts = weights * PRIOR_WEIGHT
    for r in trained.mapInArrow(uses, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():  # a row for each piece at most
        counts[r["piece"]] += r["uses"]
    all_uses = counts.sum() + documents + 1
    return Model(Lattice.of(pieces, counts / all_uses), log((documents + 1) / all_uses), (sums[0] or 0) + documents, sums[1] + (documents > 0), documents)


def score_texts(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """A row for every row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are base-10 logarithms. Trained on the documents that aren't held out (by a checksum of doc_id; a null doc_id counts as
    empty text). Null and empty texts are the end alone; repeated rows are scored each; an empty table gives an empty result;
    further columns are not read. Words that make up a set share of all words or more are sent to all tasks; there can't
    be more of them than that share allows. All others meet their counts in a join by word, which has no frequent keys.
    """
    docs = named(docs, "doc_id", "text")
    spark = docs.sparkSession
    words = written(word_counts(docs))
    is_training = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) != 1
    documents = docs.where(is_training).count()
    model = fit(words, documents, name)
    shared = spark.sparkContext.broadcast(model)  # as large as the vocabulary
    total = words.agg(F.sum("occurs")).first()[0] or 0
    common_from = max(1, total / COMMON_SHARE)

    def worth(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            rows = [(w, c, m.base(c), m.lattice.score(w) / LN10) for w, c in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary(), pa.int64(), pa.float64(), pa.float64()], strict=True)], names=["word", "trained", "base", "score"])

    def valued(some: DataFrame) -> DataFrame:
        return some.select("word", "trained").mapInArrow(worth, "word binary, trained long, base double, score double")

    common = {bytes(r["word"]): (int(r["trained"] > 0), r["base"], r["score"]) for r in valued(words.where(F.col("occurs") >= common_from)).collect()}  # COMMON_SHARE rows at most
    common = spark.sparkContext.broadcast(common)

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with its common words and end summed up, and a row for each other word in it."""
        m, get, row = shared.value, common.value.get, TaskContext.get().partitionId() << 40
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        for batch in text_batches(batches, 1 << 20):
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                known, base, score = int(m.end_count > 0), m.base(m.end_count), m.end / LN10
                for word, n in Counter(words).items():
                    if value := get(word):
                        known += n * value[0]
                        base += n * value[1]
                        score += n * value[2]
                    else:
                        rows.append((row, doc, word, n, None, None, None))
                rows.append((row, doc, b" %d" % row, len(words) + 1, known, base, score))  # no word has a space
                row += 1
            for i in range(0, len(rows), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + OUT_ROWS], strict=True), types, strict=True)], names=["row", "doc_id", "word", "n", "known", "own_base", "own_score"])

    spelt = docs.mapInArrow(spell, "row long, doc_id long, word binary, n long, known long, own_base double, own_score double")
    met = spelt.join(valued(words.where(F.col("occurs") < common_from)), "word", "left")
    sums = met.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("own_score").isNotNull(), F.col("n"))).alias("n_tokens"),
        F.sum(F.coalesce("known", F.when(F.col("trained") > 0, F.col("n")).otherwise(0))).alias("n_known"),
        F.sum(F.coalesce("own_base", F.col("n") * F.col("base"))).alias("base_score"),
        F.sum(F.coalesce("own_score", F.col("n") * F.col("score"))).alias("score"),
    )
    return sums.select("doc_id", (~is_training).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_subword_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
