"""Language identification by Bayesian fusion of evidence.

  text      naive Bayes over hashed byte trigrams of the lower-cased text, trained on labelled rows
  declared  the language that the markup (or a column) names, by how often texts of each language name it
  address   a prior for the host, smoothed towards the prior of its suffix and that towards the prior of all rows

Confusions and priors are grouped sums of the text's posteriors over all rows; a row's own share is taken out of the
priors it is judged by. Besides the languages there is "und", a uniform model of bytes: a row whose text it explains
better than any language does is rejected, as is a row without letters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import table, text_batches, without_rows, written

UNDETERMINED = "und"
#: Labelled rows that the text model is fitted on: those with the smallest hashes of their keys.
TRAIN_ROWS = 4000
#: Where that gives a label fewer than this share of TRAIN_ROWS (200 rows), its own rows are added up to about so many.
LABEL_SHARE = 1 / 20
#: Labels that become languages: all of them, and beyond so many (256 KB of memory each) those with the most rows.
MOST_LABELS = 1000
CELLS, SMOOTHING = 1 << 16, 0.5
#: Neighbouring trigrams share letters: their likelihood counts by this power.
TEMPER = 1 / 3
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 20.0, 50.0, 10.0
UNDETERMINED_PRIOR, DECLARED_TRUE = 0.001, 0.9

#: Bytes as the model sees them: ASCII letters and all of UTF-8's other bytes stay, the rest is a space.
FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)


def cells_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cells of all texts in a row, whether each counts, and where each text's trigrams start and end."""
    raw = [f" {t or ''} ".lower().encode("utf-8", "surrogatepass") for t in texts]
    data = FOLD[np.frombuffer(b"".join(raw) + b"  ", np.uint8)].astype(np.uint32)
    a, b, c = data[:-2], data[1:-1], data[2:]
    cells = ((a << 16 | b << 8 | c) * np.uint32(2654435761)) >> np.uint32(16)
    ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    return cells, (b != 32), np.stack([starts, np.maximum(starts, ends - 2)])


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # of each language and "und", by cell

    @property
    def names(self) -> list[str]:
        return [*self.languages, UNDETERMINED]

    def likelihoods(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (texts by names) and the number of trigrams of each text."""
        cells, counts, (starts, ends) = cells_of(texts)

        def sums(x: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0.0], np.cumsum(x, dtype=np.float64)))
            return total[ends] - total[starts]

        return np.stack([sums(own[cells] * counts) for own in self.logs], axis=1), sums(counts).round().astype(np.int64)


def train(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> TextModel:
    """Fits the text model on rows (key, text, label) that have both; without any there are no languages.

    A label of however few rows is a language; smoothing keeps its likelihoods near those of no knowledge."""
    rows = rows.where("text is not null and label is not null")
    mark = F.xxhash64("key")
    last = rows.select(mark.alias("mark")).orderBy("mark").limit(train_rows).agg(F.max("mark")).first()[0]
    if last is None:
        return TextModel([], np.full((1, CELLS), -np.log(CELLS), np.float32))
    labels = rows.groupBy("label").agg(F.count("*").alias("n"), F.min(mark).alias("low")).orderBy(F.desc("n"), "label").limit(MOST_LABELS)
    # Hashes are spread evenly over 64 bits, so a share of their range holds that share of a label's rows.
    limits = {r["label"]: max(last, r["low"], min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, LABEL_SHARE * train_rows / r["n"])))) for r in labels.collect()}  # a row a language
    languages = sorted(limits)
    bounds = F.broadcast(rows.sparkSession.createDataFrame(sorted(limits.items()), "label string, most long"))
    sample = rows.join(bounds, "label").where(mark <= F.col("most"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in text_batches(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells, counts, _ = cells_of([text])
                n = np.bincount(cells[counts], minlength=CELLS)
                total[label] = total[label] + n if label in total else n
        for label, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["label", "cell", "n"])

    counted = sample.select("label", "text").mapInArrow(count, "label string, cell int, n long")
    table = np.full((len(languages) + 1, CELLS), SMOOTHING)
    for r in counted.groupBy("label", "cell").agg(F.sum("n").alias("n")).toLocalIterator():  # CELLS rows a language at most
        table[languages.index(r["label"]), r["cell"]] += r["n"]
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32))


def posterior(logs: np.ndarray) -> np.ndarray:
    top = np.exp(logs - logs.max(axis=1, keepdims=True))
    return top / top.sum(axis=1, keepdims=True)


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """(key, language, confidence, text_language, accepted) of every row of rows (key, text, declared, host).

    language is the most probable of the model's languages or "und" (the first by name among equals); accepted is
    false for "und". Null or empty texts and texts without letters are "und" with confidence 1. A null or unknown declared
    language and a null host carry no evidence of their own. Repeated rows are answered each; an empty table gives an empty
    result. Hosts may be very unequal: sums by host are combined before they are shuffled, and texts take no part in the join.
    """
    names, k = model.names, len(model.names)
    key_type = rows.schema["key"].dataType.simpleString()
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(model)  # CELLS numbers for each language

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2 << 20):
            logs, n = shared.value.likelihoods(batch.column(1).to_pylist())
            post = posterior(logs * TEMPER) * (n > 0)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(n), *map(pa.array, (logs * TEMPER).T), *map(pa.array, post.T)], names=columns)

    columns = ["key", "declared", "host", "n", *(f"l{i}" for i in range(k)), *(f"p{i}" for i in range(k))]
    schema = f"key {key_type}, declared string, host string, n long, " + ", ".join(f"l{i} double" for i in range(k)) + ", " + ", ".join(f"p{i} double" for i in range(k))
    known = F.when(F.col("declared").isin(model.languages), F.col("declared")).when(F.col("declared").isNotNull(), "other")
    scored = rows.select("key", "text", F.lower("declared").alias("declared"), F.lower("host").alias("host")).withColumn("declared", known)
    scored = written(scored.mapInArrow(score, schema))
    suffix = F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise("")
    scored = scored.withColumn("suffix", suffix)

    sums = [F.count("*").alias("rows"), *(F.sum(f"p{i}").alias(f"s{i}") for i in range(k - 1))]
    hosts = written(scored.where("host is not null").groupBy("host", "suffix").agg(*sums))
    suffixes = hosts.groupBy("suffix").agg(F.count("*").alias("hosts"), *(F.sum(f"s{i}").alias(f"x{i}") for i in range(k - 1)))
    confusion = {r["declared"]: [r[f"s{i}"] for i in range(k - 1)] for r in scored.groupBy("declared").agg(*sums).collect()}  # a row a language, and two
    everything = np.sum([v for v in confusion.values()], axis=0) if confusion else np.zeros(k - 1)
    overall = (everything + 1) / (everything + 1).sum() if k > 1 else everything
    declared_logs = {None: np.zeros(k)}
    seen = np.sum([v for d, v in confusion.items() if d is not None], axis=0) if len(confusion) > (None in confusion) else np.zeros(k - 1)
    for d in [*model.languages, "other"]:
        prior = np.array([DECLARED_TRUE if d == x else (1 - DECLARED_TRUE) / max(1, k - 1) for x in model.languages])
        share = (np.array(confusion.get(d, np.zeros(k - 1))) + DECLARED_WEIGHT * prior) / (seen + DECLARED_WEIGHT)
        declared_logs[d] = np.log(np.append(share, 1 / (k + 1)))

    def fuse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c, m: np.stack([np.nan_to_num(batch.column(f"{c}{i}").to_numpy(zero_copy_only=False).astype(float)) for i in range(m)], axis=1) if m else np.zeros((batch.num_rows, 0))
            logs, own, n = get("l", k), get("p", k - 1), batch.column("n").to_numpy()
            has_host = np.array([h is not None for h in batch.column("host").to_pylist()], float)[:, None]
            above = np.maximum(get("x", k - 1) - own * has_host, 0)
            above = (above + SUFFIX_WEIGHT * overall) / (above.sum(axis=1, keepdims=True) + SUFFIX_WEIGHT)
            host = np.maximum(get("s", k - 1) - own * has_host, 0)
            host = (host + HOST_WEIGHT * above) / (host.sum(axis=1, keepdims=True) + HOST_WEIGHT)
            prior = np.log(np.concatenate([host * (1 - UNDETERMINED_PRIOR), np.full((len(n), 1), UNDETERMINED_PRIOR)], axis=1))
            declared = np.stack([declared_logs[d] for d in batch.column("declared").to_pylist()])
            post = posterior(logs + prior + declared)
            post[n == 0] = np.eye(k)[k - 1]
            best, text = post.argmax(axis=1), np.where(n == 0, k - 1, logs.argmax(axis=1))
            out = [batch.column("key"), pa.array([names[i] for i in best], pa.string()), pa.array(post.max(axis=1)), pa.array([names[i] for i in text], pa.string()), pa.array(best < k - 1)]
            yield pa.RecordBatch.from_arrays(out, names=["key", "language", "confidence", "text_language", "accepted"])

    joined = scored.join(hosts.drop("suffix"), "host", "left").join(F.broadcast(suffixes) if suffixes.count() <= 10_000 else suffixes, "suffix", "left")
    return joined.mapInArrow(fuse, f"key {key_type}, language string, confidence double, text_language string, accepted boolean")


def document_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The evidence in documents: their text, the language they declare, and their source as the host."""
    return docs.select(F.col(key).alias("key"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))


def page_rows(pages: DataFrame) -> DataFrame:
    """The evidence in web pages: text without markup, the lang attribute of <html>, and the host of the address.

    A script, a style or a comment that isn't closed reaches to the end, so every character of a page is passed once.
    """
    plain = F.regexp_replace("html", r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[^<>]*+>?|&#?[a-zA-Z0-9]+;", " ")
    declared = F.nullif(F.lower(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    return pages.select(F.col("page_id").alias("key"), plain.alias("text"), declared.alias("declared"), host.alias("host"))


def labelled(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("key"), "text", F.lower("lang").alias("label"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(document_rows(docs), train(labelled(docs))).withColumnRenamed("key", "doc_id")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(labelled(table(spark, sf_dir, "documents")))
    return identify(page_rows(table(spark, sf_dir, "pages")), model).withColumnRenamed("key", "page_id")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows that are rejected. A row that declares a language which the model doesn't know stays."""

    def gone(rows: DataFrame, number: str) -> DataFrame:
        model = train(labelled(docs))
        evidence = document_rows(rows, number)
        judged = identify(evidence.where(F.lower("declared").isin(model.languages) | F.col("declared").isNull() | F.trim(F.coalesce("text", F.lit(""))).eqNullSafe("")), model)
        return judged.where("not accepted").select(F.col("key").alias(number))

    return without_rows(docs, gone)
