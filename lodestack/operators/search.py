"""Full-text search over the corpus: postings, condition trees, scores, pages, drilldowns, highlights."""

from __future__ import annotations

import html
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from lodestack.functions.text import escape_html, tokenize, truncate_words, widened
from lodestack.operators.corpus import KEY
from lodestack.operators.visibility import Dims, Request, is_true, select_types, unselected, visible, without
from lodestack.sources.folders import shared_dir

TITLE_WEIGHT, CONTENT_CAP = 100, 5


@dataclass(frozen=True)
class Word:
    """Words that must follow one another (one word, or a phrase), or any of several such (synonyms).

    With prefix the last of them need only start so.
    """

    forms: tuple[tuple[str, ...], ...]
    prefix: bool = False


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Some:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Where:
    """A condition on the corpus' columns, as SQL."""

    sql: str


PLAIN_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}ー々"
PLAIN_TOKEN = regex.compile(rf"(?V1)[{PLAIN_CJK}]+|[\p{{L}}--[{PLAIN_CJK}]]+|\p{{N}}+")


def plain_tokens(text: str) -> list[str]:
    """Tokens of a query word, as tokenize() makes them of a column."""
    out = []
    for run in PLAIN_TOKEN.findall(text.lower()):
        pairs = len(run) > 1 and regex.match(f"[{PLAIN_CJK}]", run)
        out += [run[i : i + 2] for i in range(len(run) - 1)] if pairs else [run]
    return out


def word(text: str, prefix: bool = False) -> Word:
    return Word((tuple(plain_tokens(text)),), prefix)


def parse(text: str, nfkc: bool = False) -> All | None:
    """A plain string as a condition: its words, all of them; a word of several tokens is a phrase. Never an error."""
    words = [w for w in map(word, (unicodedata.normalize("NFKC", text) if nfkc else text).split()) if w.forms[0]]
    return All(tuple(words)) if words else None


def plain_negations(tree: object, negated: bool = False) -> object:
    """The same condition with Not on words and columns' conditions alone, and never twice."""
    if isinstance(tree, Not):
        return plain_negations(tree.part, not negated)
    if isinstance(tree, All | Some):
        return (Some if isinstance(tree, All) == negated else All)(tuple(plain_negations(p, negated) for p in tree.parts))
    return Not(tree) if negated else tree


def leaves(tree: object) -> list[Word]:
    if isinstance(tree, Word):
        return [tree]
    if isinstance(tree, Not):
        return leaves(tree.part)
    return [x for p in tree.parts for x in leaves(p)] if isinstance(tree, All | Some) else []


def positive_leaves(tree: object) -> list[Word]:
    if isinstance(tree, Not):
        return []
    return [tree] if isinstance(tree, Word) else [x for p in getattr(tree, "parts", ()) for x in positive_leaves(p)]


def expand_query(tree: object, expansions: DataFrame) -> object:
    """The tree with each word that is a synonym's source replaced by any of its destinations.

    The word itself stays only if it is one of them. Only the synonyms of the query's own words are fetched.
    """
    words = sorted({" ".join(f) for x in leaves(tree) for f in x.forms if not x.prefix})
    found = expansions.where(F.lower("source").isin(words)).select(F.lower("source"), "destination").distinct().collect()
    table: dict[str, list[tuple[str, ...]]] = {}
    for source, destination in sorted(map(tuple, found)):
        table.setdefault(source, []).append(tuple(plain_tokens(destination)))

    def go(t: object) -> object:
        if isinstance(t, Word) and not t.prefix:
            return Word(tuple(dict.fromkeys(f for own in t.forms for f in table.get(" ".join(own), [own]))))
        if isinstance(t, Not):
            return Not(go(t.part))
        return type(t)(tuple(map(go, t.parts))) if isinstance(t, All | Some) else t

    return go(tree)


def expand_preview(queries: DataFrame, expansions: DataFrame) -> DataFrame:
    """(query, expanded) of every row of queries (query): words replaced by (a OR b) where they have synonyms."""
    words = queries.select("query", F.posexplode(F.split("query", r"\s+")).alias("pos", "word"))
    e = expansions.select(F.lower("source").alias("_source"), "destination").distinct()
    found = words.join(e, F.lower("word") == F.col("_source"), "left").groupBy("query", "pos", "word").agg(F.sort_array(F.collect_list("destination")).alias("to"))
    shown = F.when(F.size("to") == 0, F.col("word")).otherwise(F.concat(F.lit("("), F.array_join("to", " OR "), F.lit(")")))
    return found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("pos", shown.alias("shown")))).alias("w")).select("query", F.array_join(F.col("w.shown"), " ").alias("expanded"))


def with_tokens(corpus: DataFrame, normalized: bool = True) -> DataFrame:
    """corpus with the tokens of its title and content; normalized false runs the full normalisation first.

    The tokens pass through an explode of one element: filters on them can't be pushed below it, so a row is tokenised once
    and not again inside every condition.
    """
    lowered = (lambda c: F.lower(c)) if normalized else (lambda c: F.col(c))
    empty = F.array().cast("array<string>")
    found = F.struct(*[F.coalesce(tokenize(lowered(c), normalized), empty).alias(c) for c in ("title", "content")])
    return corpus.select("*", F.explode(F.array(found)).alias("_t")).select(*corpus.columns, F.col("_t.title").alias("_title_tokens"), F.col("_t.content").alias("_content_tokens"))


def same_word(form: str, prefix: bool) -> Callable[[Column], Column]:
    return lambda t: t.startswith(form) if prefix else t == form


def follows(form: str, prefix: bool) -> Callable[[Column, Column], Column]:
    return lambda before, t: before & same_word(form, prefix)(t)


def occurrences(tokens: Column, x: Word) -> Column:
    """How often any form of a word occurs in an array of tokens."""
    total = F.lit(0)
    for form in x.forms:
        if not form:
            continue
        if len(form) == 1:
            total = total + F.size(F.filter(tokens, same_word(form[0], x.prefix)))
        else:
            flags = F.transform(tokens, same_word(form[0], False))
            for k, own in enumerate(form[1:], 1):
                flags = F.zip_with(flags, F.slice(tokens, k + 1, F.greatest(F.size(tokens) - k, F.lit(0))), follows(own, x.prefix and k == len(form) - 1))
            total = total + F.size(F.filter(flags, lambda f: F.coalesce(f, F.lit(False))))
    return total


def counts(tokened: DataFrame, tree: object) -> tuple[DataFrame, dict[Word, tuple[Column, Column]]]:
    """Columns with each leaf's occurrences in title and content, made in one pass over the rows."""
    found = list(dict.fromkeys(leaves(tree)))
    columns = {f"_{c}_{i}": occurrences(F.col(f"_{c}_tokens"), x) for i, x in enumerate(found) for c in ("title", "content")}
    return tokened.withColumns(columns), {x: (F.col(f"_title_{i}"), F.col(f"_content_{i}")) for i, x in enumerate(found)}


def holds(tree: object, found: dict[Word, tuple[Column, Column]], titles_only: bool = False) -> Column:
    """Whether a row meets a condition: each word in any column, all words together."""
    if isinstance(tree, Word):
        title, content = found[tree]
        return title > 0 if titles_only else (title > 0) | (content > 0)
    if isinstance(tree, Where):
        return is_true(F.expr(tree.sql))
    if isinstance(tree, Not):
        return ~holds(tree.part, found, titles_only)
    return reduce((lambda a, b: a & b) if isinstance(tree, All) else (lambda a, b: a | b), [holds(p, found, titles_only) for p in tree.parts])


def identifier_match(tree: object) -> Column:
    """Whether the name of a tag of type identifier meets the query by itself."""
    if not positive_leaves(tree):
        return F.lit(False)

    def meets(t: object, name: Column) -> Column:
        if isinstance(t, Word):
            ends = "" if t.prefix else " "
            return reduce(lambda a, b: a | b, [name.contains(f" {' '.join(f)}{ends}") for f in t.forms])
        if isinstance(t, Where):
            return F.lit(True)
        if isinstance(t, Not):
            return ~meets(t.part, name)
        return reduce((lambda a, b: a & b) if isinstance(t, All) else (lambda a, b: a | b), [meets(p, name) for p in t.parts])

    named = F.filter(F.coalesce("tags", F.array().cast("array<struct<type:string,name:string>>")), lambda t: t["type"] == "identifier")
    names = F.transform(named, lambda t: F.concat(F.lit(" "), F.array_join(tokenize(F.lower(t["name"])), " "), F.lit(" ")))
    return F.exists(names, lambda n: meets(tree, n))


def may_hold(tree: object, text: Column) -> Column:
    """What a lower-cased text must contain to meet a condition: a cheap test before it is tokenised."""
    if isinstance(tree, Word):
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [text.contains(w) for w in f]) for f in tree.forms if f], F.lit(False))
    if isinstance(tree, Not | Where):
        return F.lit(True)
    return reduce((lambda a, b: a & b) if isinstance(tree, All) else (lambda a, b: a | b), [may_hold(p, text) for p in tree.parts])


def match(corpus: DataFrame, tree: object, titles_only: bool = False, normalized: bool = True) -> DataFrame:
    """Rows of corpus that meet the condition, with their score before the constant.

    A word scores 100 for every time it is in the title and 1 for every time in the content, up to 5; with titles_only 1 for every
    time in the title. A matching identifier tag adds 1, and matches by itself. The corpus is read once, without a shuffle.
    """
    tree = plain_negations(tree)
    by_tag = identifier_match(tree)
    if normalized:
        text = F.lower(F.concat_ws("\n", "title", *([] if titles_only else ["content"])))
        corpus = corpus.where(may_hold(tree, text) | by_tag)
    tokened, found = counts(with_tokens(corpus, normalized), tree)
    parts = [found[x] for x in dict.fromkeys(positive_leaves(tree))]
    of = [t if titles_only else t * TITLE_WEIGHT + F.least(c, F.lit(CONTENT_CAP)) for t, c in parts]
    score = reduce(lambda a, b: a + b, of, F.lit(0)) + by_tag.cast("int")
    return tokened.where(holds(tree, found, titles_only) | by_tag).withColumn("score", score.cast("long")).select(*corpus.columns, "score")


POSTING = "term string, field string, source_type string, source_id long, tf long, positions array<int>"


#: Rows are looked through for up to so many words before they are tokenised.
LOOKED_FOR = 20


def grouped_positions(terms: list[str] | None = None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes postings, all or those of some terms, of rows (source_type, source_id, field, tokens): a row's tokens are sorted among themselves, nothing is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if terms is None else pa.array(terms, pa.string())
        for batch in batches:
            step = max(1, int(batch.num_rows * (8 << 20) / max(batch.nbytes, 1)))
            for own in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                sizes = own.column(3).value_lengths().to_numpy(zero_copy_only=False)
                coded = own.column(3).flatten().dictionary_encode()
                codes, row = coded.indices.to_numpy(), np.repeat(np.arange(own.num_rows), sizes)
                positions = (np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
                if wanted is not None:
                    kept = pc.is_in(coded.dictionary, wanted).to_numpy(zero_copy_only=False)[codes]
                    codes, row, positions = codes[kept], row[kept], positions[kept]
                key = row * max(1, len(coded.dictionary)) + codes
                order = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.diff(key[order], prepend=-1))
                of, ends = row[order][starts], np.append(starts, len(key))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(positions[order]))
                columns = [coded.dictionary.take(pa.array(codes[order][starts])), *(own.column(c).take(pa.array(of)) for c in (2, 0, 1)), pa.array(np.diff(ends), pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "field", *KEY, "tf", "positions"])

    return run


def build_postings(corpus: DataFrame, normalized: bool = True, terms: list[str] | None = None) -> DataFrame:
    """(term, field, source_type, source_id, tf, positions): the inverted index of title, content and tag names.

    A target's n-th identifier has a field "identifier n" of its own besides, as it must meet a query by itself. With terms only their
    postings are made; of few terms, rows that don't contain any aren't tokenised.
    """
    if terms is not None and normalized and len(terms) <= LOOKED_FOR:
        names = F.transform(F.coalesce("tags", F.array().cast("array<struct<type:string,name:string>>")), lambda t: t["name"])
        text = F.lower(F.concat_ws("\n", "title", "content", names))
        corpus = corpus.where(reduce(lambda a, b: a | b, [text.contains(t) for t in terms], F.lit(False)))
    tokened = with_tokens(corpus, normalized)
    tags = F.coalesce("tags", F.array().cast("array<struct<type:string,name:string>>"))
    tag_tokens = F.flatten(F.transform(tags, lambda t: tokenize(F.lower(t["name"]))))
    fields = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("tokens")) for n, c in (("title", F.col("_title_tokens")), ("content", F.col("_content_tokens")), ("tag", tag_tokens))])
    identifiers = F.transform(
        F.filter(tags, lambda t: t["type"] == "identifier"), lambda t, n: F.struct(F.concat(F.lit("identifier "), n.cast("string")).alias("field"), tokenize(F.lower(t["name"])).alias("tokens"))
    )
    each = tokened.select(*KEY, F.explode(F.concat(fields, identifiers)).alias("f")).where("size(f.tokens) > 0").select(*KEY, "f.field", "f.tokens")
    return each.mapInArrow(grouped_positions(terms), POSTING)


#: Bytes of texts whose postings one task sorts (some 200 MB), and rows of a page, which a search passes over by its terms.
SORTED_TEXT, PAGE_ROWS = 16 << 20, "4000"


def dealt_by_text(corpus: DataFrame) -> int:
    """How many tasks have SORTED_TEXT bytes of the corpus' texts each, or one task a core if that is more."""
    size = corpus.agg(F.sum(F.coalesce(F.octet_length("title"), F.lit(0)) + F.coalesce(F.octet_length("content"), F.lit(0)))).first()[0] or 0
    return max(corpus.sparkSession.sparkContext.defaultParallelism, -(-size // SORTED_TEXT))


def write_sorted(postings: DataFrame, folder: str) -> None:
    """Writes postings, which are dealt by target, sorted by term within each task: none of them is shuffled for it."""
    writer = postings.sortWithinPartitions("term", "field", *KEY).write.mode("overwrite")
    writer.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.block.size", str(SORTED_TEXT)).parquet(folder)


def write_postings(corpus: DataFrame, folder: str, normalized: bool = True) -> None:
    """Writes the index in parts, each of some targets and sorted by term, so that a search reads only its terms' pages of every part.

    Texts are dealt, which are smaller than their postings, and a row is tokenised once; a task sorts SORTED_TEXT bytes of texts, however many there are.
    """
    write_sorted(build_postings(corpus.select(*KEY, "title", "content", "tags").repartition(dealt_by_text(corpus), *KEY), normalized), folder)


def read_postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def met(tree: object, leaf: Callable[[Word], bool]) -> bool:
    """Whether a condition of words is met where leaf tells which of them occur."""
    if isinstance(tree, Word):
        return leaf(tree)
    if isinstance(tree, Not):
        return not met(tree.part, leaf)
    return (all if isinstance(tree, All) else any)([met(p, leaf) for p in tree.parts])


def has_where(tree: object) -> bool:
    parts = tree.parts if isinstance(tree, All | Some) else (tree.part,) if isinstance(tree, Not) else ()
    return isinstance(tree, Where) or any(map(has_where, parts))


def match_postings(postings: DataFrame, tree: object, titles_only: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """(source_type, source_id, score) of what meets a condition of words, from an inverted index: what match() finds.

    Only the query's terms are read (the parts of the written index are sorted by term, so others are skipped). Words of a phrase meet
    by target, and the positions where the phrase would start are intersected. A condition that a target can meet without any of its words (a negation) needs targets, all rows
    with their keys and tags; for others the index is enough. A condition on columns (Where) can't be met from an index.
    """
    if has_where(tree):
        raise ValueError("a condition on columns can't be met from postings")
    tree = plain_negations(tree)
    found = list(dict.fromkeys(leaves(tree)))
    unseen = met(tree, lambda _: False)
    if unseen and targets is None:
        raise ValueError("this condition is met by targets without its words: give targets")
    asked = [(i, k, j, t, len(f), x.prefix and j == len(f) - 1) for i, x in enumerate(found) for k, f in enumerate(x.forms) for j, t in enumerate(f)]
    term = F.col("term")
    same = [term.startswith(t) if prefix else term == t for *_, t, _, prefix in asked]
    exact = sorted({t for *_, t, _, prefix in asked if not prefix})
    some = reduce(lambda a, b: a | b, [c for c, a in zip(same, asked, strict=True) if a[5]], term.isin(exact))
    fields = F.col("field") == "title" if titles_only else F.col("field").isin("title", "content")
    parts = [F.when(c, F.struct(F.lit(i).alias("leaf"), F.lit(k).alias("form"), F.lit(j).alias("place"), F.lit(n).alias("size"))) for c, (i, k, j, _, n, _) in zip(same, asked, strict=True)]
    p = postings.where(some & (fields | F.col("field").startswith("identifier "))).select(*KEY, "field", "tf", "positions", F.explode(F.array_compact(F.array(*parts))).alias("a"))
    hit = p.where("a.size = 1").select(*KEY, "field", "a.leaf", "tf")
    if any(a[4] > 1 for a in asked):
        shifted = F.struct(F.col("a.place"), F.transform("positions", lambda at: at - F.col("a.place")).alias("starts"))
        placed = p.where("a.size > 1").select(*KEY, "field", "a.leaf", "a.form", "a.size", shifted.alias("p")).groupBy(*KEY, "field", "leaf", "form", "size").agg(F.collect_list("p").alias("all"))
        starts = lambda place: F.flatten(F.transform(F.filter("all", lambda p: p["place"] == place), lambda p: p["starts"]))
        whole = F.aggregate(F.sequence(F.lit(1), F.col("size") - 1), starts(F.lit(0)), lambda before, place: F.array_intersect(before, starts(place)))
        times = placed.select(*KEY, "field", "leaf", F.size(whole).cast("long").alias("tf")).where("tf > 0")
        hit = hit.unionByName(times)
    at = {x: (F.col(f"_title_{i}"), F.col(f"_content_{i}")) for i, x in enumerate(found)}
    flags = [F.sum(F.when((F.col("leaf") == i) & (F.col("field") == c), F.col("tf")).otherwise(0)).alias(f"_{c}_{i}") for i in range(len(found)) for c in ("title", "content")]
    named = F.collect_set(F.when(F.col("field").startswith("identifier "), F.struct("field", "leaf"))).alias("_named")
    df = hit.groupBy(*KEY).agg(*flags, named)
    if unseen:
        df = targets.select(*KEY, identifier_match(tree).alias("_by_tag")).join(df, KEY, "left").fillna(0, [f"_{c}_{i}" for i in range(len(found)) for c in ("title", "content")])
        by_tag = F.col("_by_tag")
    else:
        by_tag = F.exists(F.array_distinct(F.transform("_named", lambda t: t["field"])), lambda name: _meets_leaves(tree, found, name))
    of = [at[x][0] if titles_only else at[x][0] * TITLE_WEIGHT + F.least(at[x][1], F.lit(CONTENT_CAP)) for x in dict.fromkeys(positive_leaves(tree))]
    score = reduce(lambda a, b: a + b, of, F.lit(0)) + by_tag.cast("int")
    return df.where(holds(tree, at, titles_only) | by_tag).select(*KEY, score.cast("long").alias("score"))


def _meets_leaves(tree: object, found: list[Word], name: Column) -> Column:
    """Whether one identifier, of those in _named, holds words that meet the condition."""
    if isinstance(tree, Word):
        return F.array_contains(F.col("_named"), F.struct(name.alias("field"), F.lit(found.index(tree)).alias("leaf")))
    if isinstance(tree, Not):
        return ~_meets_leaves(tree.part, found, name)
    return reduce((lambda a, b: a & b) if isinstance(tree, All) else (lambda a, b: a | b), [_meets_leaves(p, found, name) for p in tree.parts])


def sort_columns(request: Request) -> list[Column]:
    """The order of hits; the newest first among equals, then by id."""
    way = (lambda c: F.desc(c)) if request.descending else (lambda c: F.asc(c))
    by = {"date": ["last_modified_at"], "last_modified_time": ["last_modified_at"], "registered_time": ["registered_at"]}.get(request.order)
    first = [way(by[0])] if by else [way("score"), F.desc("last_modified_at")]
    return [*first, *KEY]


def page(hits: DataFrame, request: Request) -> DataFrame:
    df = hits.orderBy(*sort_columns(request)).offset(request.offset)
    return df if request.limit < 0 else df.limit(request.limit)


def page_offset(number: int, limit: int = 10) -> int:
    return (max(number, 1) - 1) * limit


def query_words(tree: object) -> list[str]:
    """What to mark: the condition's words and phrases, the longest first; the start of a word ends in *."""
    return sorted({" ".join(f) + "*" * x.prefix for x in positive_leaves(tree) for f in x.forms if f}, key=lambda w: (-len(w), w)) if tree is not None else []


def marking(words: list[str]) -> str:
    """A pattern, for Java and Python alike, of the words as they stand in a text.

    Pairs of CJK characters are put together to the run they come from, and have no word boundaries; tokens of a phrase have
    anything but letters and digits between them, or nothing where their kinds differ.
    """
    bound, cjk = r"[\p{L}\p{N}]", regex.compile(rf"[{PLAIN_CJK}]+")
    out = []
    for w in words:
        runs: list[str] = []
        for token in w.rstrip("*").split(" "):
            joined = runs and len(token) == 2 and cjk.fullmatch(token) and cjk.fullmatch(runs[-1]) and runs[-1][-1] == token[0]
            runs[-1:] = [runs[-1] + token[1]] if joined else [*runs[-1:], token]
        before = "" if cjk.fullmatch(runs[0]) else f"(?<!{bound})"
        after = "" if w.endswith("*") or cjk.fullmatch(runs[-1]) else f"(?!{bound})"
        whole = regex.escape(runs[0])
        for last, own in zip(runs, runs[1:], strict=False):
            touch = last[-1].isalpha() != own[0].isalpha() or bool(cjk.match(last[-1])) != bool(cjk.match(own[0]))
            whole += r"[^\p{L}\p{N}]" + "+*"[touch] + regex.escape(own)
        out.append(before + whole + after)
    return "(" + "|".join(out) + ")"


def highlight(x: Column | str, words: list[str]) -> Column:
    """Escaped text with every word of the query in <span class="keyword">."""
    if not words:
        return escape_html(x)
    marked = F.regexp_replace(F.translate(x, "\x01\x02", ""), "(?iu)" + marking(words), "\x01$1\x02")  # in the text itself, then escaped
    return F.replace(F.replace(escape_html(marked), F.lit("\x01"), F.lit('<span class="keyword">')), F.lit("\x02"), F.lit("</span>"))


def snippets_of(text: str | None, words: list[str], size: int = 200, most: int = 3) -> list[str]:
    """Up to so many fragments of size bytes around hits, one after another, escaped and highlighted."""
    if not text or not words:
        return []
    pattern = regex.compile("(?i)" + marking(words))
    out, at = [], 0
    for m in pattern.finditer(text):
        if len(out) == most:
            break
        if m.start() < at:
            continue
        start = max(at, m.start() - size // 4)
        own = text[start : start + size].encode()[:size].decode("utf-8", "ignore")
        if m.end() > start + len(own):
            start = m.start()
            own = text[start : start + size].encode()[:size].decode("utf-8", "ignore")
        at = start + len(own)
        parts, end = [], 0
        for k in pattern.finditer(own):
            parts += [html.escape(own[end : k.start()]), f'<span class="keyword">{html.escape(k[0])}</span>']
            end = k.end()
        out.append("".join(parts) + html.escape(own[end:]))
    return out


def snippets(hits: DataFrame, words: list[str], content: str = "content", out: str = "snippets") -> DataFrame:
    """hits (a page of them) with fragments of their content; a cut of the content where no word is in it."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(**{out: pdf[content].map(lambda t: snippets_of(t, words))})

    found = hits.mapInPandas(run, widened(hits, out, ArrayType(StringType())))
    return found.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(F.array_compact(F.array(truncate_words(content)))))


def type_drilldown(hits: DataFrame) -> DataFrame:
    """(type, n): hits by source type and by container type, both counted."""
    return hits.select(F.explode(F.array("source_type", "container_type")).alias("type")).where("type is not null").groupBy("type").agg(F.count("*").alias("n"))


def tag_drilldown(hits: DataFrame, tag_dim: DataFrame, top: int | None = 10) -> DataFrame:
    """(type, name, value, n): hits by tag, the most frequent of each tag type; tags that the dim lacks are left out."""
    n = hits.select(F.explode("tags").alias("t")).groupBy("t.type", "t.name").agg(F.count("*").alias("n"))
    known = n.join(tag_dim.select("type", "name", "value"), ["type", "name"])
    if top is None:
        return known
    rank = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), "name"))
    return known.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def hit_counts(hits: DataFrame, types: list[str], one_project: bool = False) -> DataFrame:
    """(n_hits, total_n_hits): after and before the choice of types, in one pass."""
    out = unselected(types, one_project)
    chosen = without(F.col("source_type").isin(out)) & without(F.col("container_type").isin(out)) if out else F.lit(True)
    return hits.agg(F.count_if(chosen).alias("n_hits"), F.count("*").alias("total_n_hits"))


@dataclass
class Result:
    """What a search gives. close() lets go of the hits that were kept for it; with "with" that is done at its end."""

    page: DataFrame
    counts: DataFrame
    types: DataFrame
    tags: DataFrame | None
    kept: DataFrame | None = None

    def close(self) -> None:
        if self.kept is not None:
            self.kept.unpersist()

    def __enter__(self) -> Result:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def condition(request: Request, expansions: DataFrame | None = None) -> object:
    """A request's query as a tree, its synonyms in place."""
    tree = parse(request.query, request.nfkc) if isinstance(request.query, str) else request.query
    tree = tree if tree is None or expansions is None else expand_query(tree, expansions)
    return None if tree is None else plain_negations(tree)


def find(corpus: DataFrame, request: Request, dims: Dims, expansions: DataFrame | None = None, postings: DataFrame | None = None) -> DataFrame:
    """All hits before the choice of types, with their scores (a constant 1 for the filter, 1 more with types chosen).

    With postings (of the same corpus, built with normalized=not request.nfkc) no text is read; a condition on columns still scans.
    """
    seen = visible(corpus, request, dims)
    tree = condition(request, expansions)
    if tree is None:
        hits = seen.withColumn("score", F.lit(0).cast("long"))
    elif postings is not None and not has_where(tree):
        hits = seen.join(match_postings(postings, tree, request.titles_only, seen), KEY)
    else:
        hits = match(seen, tree, request.titles_only, not request.nfkc)
    return hits.withColumn("score", F.col("score") + 1 + int(bool(request.types)))


def search(corpus: DataFrame, request: Request, dims: Dims, tag_dim: DataFrame | None = None, expansions: DataFrame | None = None, keep: bool = True, postings: DataFrame | None = None) -> Result:
    """A whole search: the hit set is kept once and feeds the page, the counts and both drilldowns.

    Texts take no part in sorting: keys and scores are ranked and cut, then joined back to the corpus and highlighted.
    """
    narrow = find(corpus, request, dims, expansions, postings).select(*KEY, "container_type", "last_modified_at", "registered_at", "tags", "score")
    if keep:
        narrow = narrow.persist()
    one = request.project_id is not None
    chosen = select_types(narrow, request.types, one)
    top = page(chosen if request.has_condition() else chosen.limit(0), request)
    words = query_words(condition(request, expansions))
    rows = corpus.drop("last_modified_at", "registered_at", "tags", "container_type").join(F.broadcast(top) if request.limit >= 0 else top, KEY)
    shown = snippets(rows, words).withColumn("highlighted", highlight("title", words)).orderBy(*sort_columns(request))
    return Result(shown, hit_counts(narrow, request.types, one), type_drilldown(narrow), None if tag_dim is None else tag_drilldown(chosen, tag_dim), narrow if keep else None)


#: Postings of a word that one key of search_many() holds, about.
DEALT = 50_000
#: Words of queries are broadcast up to so many.
BROADCAST_WORDS = 200_000


def search_many(corpus: DataFrame | None, queries: DataFrame, k: int | None = 10, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, source_type, source_id, score, rank) of the k best rows for every query (query_id, text), all words required.

    Without k all rows that are found come, and no rank. A word's score is as in match(). The words meet postings (of the corpus, which is
    then not read) or those made of the corpus on the way. A query starts from the rows that hold its rarest word; only they
    are looked up, by word and row, among the postings of its other words. A frequent word's postings are dealt to several keys.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokenize(F.lower("text")))).alias("term"))
    wanted = asked.select("term").distinct()
    few = wanted.limit(BROADCAST_WORDS + 1).collect() if postings is None else None
    terms = sorted(r["term"] for r in few) if few is not None and len(few) <= BROADCAST_WORDS else None  # with them the other words' postings aren't made
    if terms is None:
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_WORDS else wanted
    p = (build_postings(corpus, terms=terms) if postings is None else postings).where(F.col("field").isin("title", "content"))
    p = p if terms is not None else p.join(wanted, "term", "left_semi")
    weight = F.when(F.col("field") == "title", F.col("tf") * TITLE_WEIGHT).otherwise(F.least("tf", F.lit(CONTENT_CAP)))
    found = p.groupBy("term", *KEY).agg(F.sum(weight).cast("long").alias("s"))
    folder = f"{shared_dir(queries.sparkSession)}/{uuid.uuid4().hex}"
    found.write.parquet(folder)  # the asked words' rows alone; read twice
    found = queries.sparkSession.read.parquet(folder)
    asked = asked.join(found.groupBy("term").agg(F.count("*").alias("df")), "term", "left").fillna(0, ["df"])
    order = Window.partitionBy("query_id").orderBy("df", "term")
    asked = asked.withColumn("place", F.row_number().over(order)).withColumn("least", F.first("df").over(order))
    asked = asked.withColumn("words", F.count("*").over(Window.partitionBy("query_id"))).where("least > 0")  # a word that no row holds ends its query
    dealt = F.ceil(F.greatest("df", F.lit(1)) / DEALT).cast("int")
    keys = F.explode(F.sequence(F.lit(0), dealt - 1))
    first = asked.where("place = 1").select("query_id", "term", "words", "df", keys.alias("part"))
    size = asked.select("term", "df").distinct()
    parted = found.join(size, "term").withColumn("part", F.pmod(F.xxhash64(*KEY), dealt).cast("int"))
    start = parted.join(first.drop("df"), ["term", "part"]).select("query_id", "words", *KEY, "s")
    others = asked.where("place > 1").select("query_id", "term")
    looked = start.select("query_id", *KEY).join(others, "query_id").join(found, ["term", *KEY]).select("query_id", *KEY, "s", F.lit(None).cast("long").alias("words"))
    hits = start.unionByName(looked).groupBy("query_id", *KEY).agg(F.sum("s").alias("score"), F.count("*").alias("found"), F.max("words").alias("words")).where("found = words")
    if k is None:
        return hits.select("query_id", *KEY, "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", *KEY, "score", "rank")
