"""Secrets by pattern and by character Markov models, with DataFrame functions only.

Base kinds are the leftmost non-overlapping matches of a pattern that pass a check:
  assign  a password, secret, token or key that is given a value of six characters or more
  access  AKIA and capitals or digits, 20 characters or more
  hex     lower-case hexadecimal digits, 24 characters or more

The kind the method adds:
  markov  a run of letters, digits, + / _ = and - of 20 characters or more with a letter or a digit in it, outside all
          base spans, that the Markov model of random strings explains better than that of ordinary identifiers by
          a set log-likelihood ratio, summed over the whole run

Both models are first-order over 65 characters, trained from labelled samples: random strings are the hex and access
spans and the values of assign spans of all documents, identifiers are the other long words of a sample of documents.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import named, table

KINDS = ("assign", "access", "hex", "markov")
#: The patterns of the base kinds and of candidates, for java.util.regex.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Any other character, and the start of a string, are the place 0.
PLACES = len(ALPHABET) + 1
#: Documents that identifiers are taken from (those with the smallest hashes of their ids), and their least length.
TRAIN_ROWS, IDENTIFIER_CHARS = 2000, 6
SMOOTHING, LEAST_RATIO = 0.5, 10.0


def spans(text: str, pattern: str, kind: str, keep: str = "true") -> str:
    """SQL for the spans of a pattern's matches: split gives what lies between them, and lengths add up to places."""
    pattern = pattern.replace("\\", "\\\\").replace("'", "\\'")
    between, matches = f"split({text}, '{pattern}', -1)", f"regexp_extract_all({text}, '{pattern}', 0)"
    return f"""filter(aggregate(
        zip_with(slice({between}, 1, size({matches})), {matches}, (b, m) -> struct(length(b) as skip, m as found)),
        cast(struct(0 as at, array() as out) as struct<at: int, out: array<struct<kind: string, start: int, end: int, found: string>>>),
        (acc, x) -> struct(acc.at + x.skip + length(x.found) as at, concat(acc.out, array(struct('{kind}' as kind, acc.at + x.skip as start, acc.at + x.skip + length(x.found) as end, x.found as found))) as out),
        acc -> acc.out), s -> {keep})"""


NONE = "cast(array() as array<struct<kind: string, start: int, end: int, found: string>>)"


def base_spans(text: str = "text") -> Column:
    """The base spans of a column of texts, by start and then by kind; none in null and empty texts."""
    value = ASSIGN_VALUE.replace("\\", "\\\\").replace("'", "\\'")
    assign = f"case when {text} rlike '(?i:passw|secret|token|api_?key)' then {spans(text, ASSIGN, 'assign', f"length(regexp_extract(s.found, '{value}', 1)) >= 6")} else {NONE} end"
    access = f"case when contains({text}, 'AKIA') then {spans(text, ACCESS, 'access')} else {NONE} end"
    hexes = f"case when {text} rlike '{HEX}' then {spans(text, HEX, 'hex')} else {NONE} end"
    order = "array_sort(concat(a, b, c), (x, y) -> case when x.start <> y.start then x.start - y.start else array_position(array('assign', 'access', 'hex'), x.kind) - array_position(array('assign', 'access', 'hex'), y.kind) end)"
    together = order.replace("concat(a, b, c)", f"concat({assign}, {access}, {hexes})").replace("array_position(array('assign', 'access', 'hex'), x.kind) - array_position(array('assign', 'access', 'hex'), y.kind)", "cast(array_position(array('assign', 'access', 'hex'), x.kind) - array_position(array('assign', 'access', 'hex'), y.kind) as int)")
    return F.expr(f"case when {text} is null then {NONE} else {together} end")


def transitions(strings: DataFrame) -> DataFrame:
    """(a, b, n): how often place b follows place a in the strings of column s."""
    place = lambda i: f"instr('{ALPHABET}', substring(s, {i}, 1))"
    pairs = strings.where("length(s) > 0").select(F.expr(f"explode(transform(sequence(1, length(s)), i -> struct(if(i = 1, 0, {place('i - 1')}) as a, {place('i')} as b))) as p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def ratios(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """Log-likelihood ratios of every transition, row by row, from samples of random strings and of identifiers."""
    tables = []
    for sample in (random, ordinary):
        n = [[SMOOTHING] * PLACES for _ in range(PLACES)]
        for r in transitions(sample).collect():  # PLACES squared rows at most
            n[r["a"]][r["b"]] += r["n"]
        tables.append([[log(x / sum(row)) for x in row] for row in n])
    return [x - y for own, other in zip(*tables, strict=True) for x, y in zip(own, other, strict=True)]


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, added): arrays of (kind, start, end, found) for every row of docs, in code points, end exclusive.

    base is by start, then kind in the order of KINDS; added is by start. Null and empty texts have none; repeated
    rows are answered each; an empty table gives an empty result; further columns are not read. Texts are searched whole.
    """
    docs = named(docs, key, text).toDF("key", "text")
    based = docs.withColumn("base", base_spans())
    value = F.expr("case when s.kind = 'assign' then regexp_extract(s.found, '" + ASSIGN_VALUE.replace("\\", "\\\\").replace("'", "\\'") + "', 1) else s.found end")
    random = based.where("size(base) > 0").select(F.explode("base").alias("s")).select(value.alias("s"))
    mark = F.xxhash64("key")
    last = docs.select(mark.alias("mark")).orderBy("mark").limit(TRAIN_ROWS).agg(F.max("mark")).first()[0]
    sample = docs.where(mark <= F.lit(0 if last is None else last))
    words = sample.select(F.explode(F.expr(f"regexp_extract_all(text, '[A-Za-z0-9+/_=-]{{{IDENTIFIER_CHARS},}}+', 0)")).alias("s"))
    ordinary = words.where(f"not s rlike '{HEX}|{ACCESS}' and not (s rlike '[0-9]' and length(s) >= 16)")
    ratio = ratios(random, ordinary)
    array = "array(" + ", ".join(f"{x!r}D" for x in ratio) + ")"
    place = f"instr('{ALPHABET}', c)"
    gain = f"""aggregate(regexp_extract_all(s.found, '.', 0), cast(struct(0 as at, 0D as sum) as struct<at: int, sum: double>),
        (acc, c) -> struct({place} as at, acc.sum + element_at({array}, {PLACES} * acc.at + {place} + 1) as sum), acc -> acc.sum)"""
    outside = "not exists(base, b -> b.start < s.end and s.start < b.end)"
    found = f"case when text rlike '{CANDIDATE}' then {spans('text', CANDIDATE, 'markov')} else {NONE} end"
    likely = based.withColumn("candidates", F.expr(f"filter({found}, s -> s.found rlike '[0-9A-Za-z]')"))
    return likely.select("key", "base", F.expr(f"filter(candidates, s -> {outside} and {gain} >= {LEAST_RATIO}D)").alias("added")).withColumnRenamed("key", key)


def op10_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    joined = lambda s: f"array_join(transform({s}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    every = "array_sort(concat(base, added), (x, y) -> case when x.start <> y.start then x.start - y.start else cast(array_position(array('assign', 'access', 'hex', 'markov'), x.kind) - array_position(array('assign', 'access', 'hex', 'markov'), y.kind) as int) end)"
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.expr(f"sha2({joined('base')}, 256)").alias("base_sha256"), F.expr(joined(every)).alias("spans"))
