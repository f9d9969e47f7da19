"""Text functions over columns: extraction clean-up, normalisation, tokens, sizes, sentences, snippets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType

WHITE = " \t\n\v\f\r"
#: Scripts whose runs are indexed as pairs of characters.
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー々"
TOKEN = rf"[{CJK}]+|[\p{{L}}&&[^{CJK}]]+|\p{{N}}+"
ASCII = r"^[\x00-\x7F]*$"
MAX_BYTES = 4 << 20
#: Rows that Python turns into results at a time.
SLICE_BYTES = 1 << 20


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def widened(df: DataFrame, name: str, kind: DataType) -> StructType:
    return StructType([*(f for f in df.schema.fields if f.name != name), StructField(name, kind)])


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about size bytes, of a row at least."""
    step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
    return (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def with_column(df: DataFrame, name: str, out: str, kind: DataType, arrow: pa.DataType, f: Callable[[str | None], object]) -> DataFrame:
    """df with f of a text column; Python holds SLICE_BYTES of rows and their results at a time, however many a batch has."""
    others = [c for c in df.columns if c != out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                made = pa.array([f(x.as_py()) for x in part.column(name)], arrow)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), made], names=[*others, out])

    return df.mapInArrow(run, widened(df, out, kind))


class BodyText(HTMLParser):
    """Text inside body (or of a fragment without one), without scripts and without what a wiki anchor holds directly."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
    SILENT = frozenset(("script", "style", "head", "title"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.forget()

    def forget(self) -> None:
        """No element is open. places: where each tag's open elements stand; silent: how many of the open ones hide their text."""
        self.open: list[tuple[str, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self.forget()
            self.parts = []
        if tag not in self.VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append((tag, "wiki-anchor" in (dict(attrs).get("class") or "").split()))
            self.silent += tag in self.SILENT

    def handle_endtag(self, tag: str) -> None:
        if self.places.get(tag):
            last = self.places[tag][-1]
            while len(self.open) > last:  # every element is closed once
                own = self.open.pop()[0]
                self.places[own].pop()
                self.silent -= own in self.SILENT

    def handle_data(self, data: str) -> None:
        if not self.silent and not (self.open and self.open[-1][1]):
            self.parts.append(data)


NAMED = re.compile("&([A-Za-z][A-Za-z0-9]*);?")


def body_text(html: str | None) -> str | None:
    """Text of a page. Named references are those that end in a semicolon, others (as in a title cut short: "R&amp") stay as written."""
    if html is None:
        return None
    parser = BodyText()
    parser.feed(NAMED.sub(lambda m: m[0] if m[0][1:] in html5 and m[0][-1] == ";" else f"&amp;{m[0][1:]}", html))
    parser.close()
    return "".join(parser.parts).strip(f"{WHITE}\0")


def markup_to_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """df with the text of an HTML column; blank becomes "", null stays null."""

    return with_column(df, html, out, StringType(), pa.string(), body_text)


def clean_text(x: Column | str) -> Column:
    """Without characters that aren't valid UTF-8 and without NUL."""
    valid = F.regexp_replace(F.call_function("make_valid_utf8", col(x)), "�", "")
    return F.replace(valid, F.lit("\0"), F.lit(""))


def truncate_bytes(x: Column | str, n: int = MAX_BYTES) -> Column:
    """The most characters that fit in n bytes of UTF-8."""
    cut = F.substring(F.encode(col(x), "UTF-8"), 1, n).cast("string")
    whole = F.regexp_replace(F.call_function("make_valid_utf8", cut), "�+$", "")
    return F.when(F.octet_length(col(x)) > n, whole).otherwise(col(x))


def join_parts(*parts: Column | str) -> Column:
    """The parts that aren't null or empty, joined by newlines."""
    return F.concat_ws("\n", *[F.nullif(col(p), F.lit("")) for p in parts])


def tag(kind: str, name: Column | str) -> Column:
    """A tag struct, null where its name is."""
    return F.when(col(name).isNotNull(), F.struct(F.lit(kind).alias("type"), col(name).cast("string").alias("name")))


def extraction_state(tags: Column | str, content: Column | str) -> Column:
    """Tags without those about extraction, and with the error tag where there is no content."""
    kept = F.filter(col(tags), lambda t: t["type"] != "text-extraction")
    return F.when(col(content).isNull(), F.array_append(kept, tag("text-extraction", F.lit("error")))).otherwise(kept)


def path_extension(path: Column | str) -> Column:
    """The last extension in lower case, null where there is none (as in ".project")."""
    return F.nullif(F.lower(F.regexp_extract(col(path), r"[^./][^/]*\.([^./]+)$", 1)), F.lit(""))


def resolve_content_type(content_type: Column | str, path: Column | str) -> Column:
    tar = col(content_type) == "application/x-tar"
    return (
        F.when(tar & F.lower(col(path)).endswith(".gz"), "application/gzip")
        .when(tar & F.lower(col(path)).endswith(".bz2"), "application/x-bzip2")
        .otherwise(col(content_type))
    )


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).lower())


def nfkc_lower(x: Column | str) -> Column:
    """NFKC in lower case; rows of ASCII alone never leave the JVM's own functions."""
    x = col(x)
    return F.when(x.rlike(ASCII), F.lower(x)).otherwise(_nfkc(F.when(~x.rlike(ASCII), x)))


def tokenize(x: Column | str, normalized: bool = True) -> Column:
    """Index terms: runs of letters, runs of digits, and pairs of neighbours in runs of CJK characters.

    Rows without CJK characters take a plainer pattern and no step for each token.
    """
    x = col(x) if normalized else nfkc_lower(x)
    runs = F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))
    paired = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]") & (F.length(r) > 1), pairs(r)).otherwise(F.array(r))))
    return F.when(x.rlike(f"[{CJK}]"), paired).otherwise(F.regexp_extract_all(x, F.lit(r"\p{L}+|\p{N}+"), F.lit(0)))


def escape_html(x: Column | str) -> Column:
    x = col(x)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def parse_size(x: Column | str) -> Column:
    """Bytes from text such as "1.5MiB", "2 GB" or "10B"."""
    number = F.regexp_extract(col(x), r"^\s*(-?[0-9.]+)", 1).try_cast("double")
    unit = F.regexp_extract(col(x), r"^\s*-?[0-9.]+\s*([KMG]i?)?B?\s*$", 1)
    scale = F.lit(1.0)
    for i, u in enumerate("KMG", 1):
        scale = F.when(unit == u, 1000.0**i).when(unit == f"{u}i", 1024.0**i).otherwise(scale)
    return number * scale


def format_size(x: Column | str) -> Column:
    x = col(x)
    size = F.abs(x)
    return (
        F.when(size < 1024, F.format_string("%d", x.cast("long")))
        .when(size < 1024**2, F.format_string("%.2fKiB", x / 1024.0))
        .when(size < 1024**3, F.format_string("%.2fMiB", x / 1024.0**2))
        .otherwise(F.format_string("%.2fGiB", x / 1024.0**3))
    )


def parse_elapsed(x: Column | str) -> Column:
    """Seconds from text such as "12ms", "1.5s", "3", "2m" or "1h"."""
    number = F.regexp_extract(col(x), r"^\s*([0-9.]+)", 1).try_cast("double")
    unit = F.regexp_extract(col(x), r"^\s*[0-9.]+\s*(ms|s|m|h)?\s*$", 1)
    return number * F.when(unit == "ms", 0.001).when(unit == "m", 60.0).when(unit == "h", 3600.0).otherwise(1.0)


def format_elapsed(x: Column | str) -> Column:
    x = col(x)
    return (
        F.when(x < 1, F.format_string("%.2fms", x * 1000.0))
        .when(x < 60, F.format_string("%.2fs", x))
        .when(x < 3600, F.format_string("%.2fm", x / 60.0))
        .otherwise(F.format_string("%.2fh", x / 3600.0))
    )


NUMBERED = regex.compile(rf"[{WHITE}]*\p{{Ps}}?\p{{N}}")
MAX_SENTENCE_BYTES = 2048


def paragraphs(text: str) -> Iterator[str]:
    """Lines put together up to a blank line, a change of indent, or a numbered line; without white space at their ends.

    Lines end at line feeds alone, and white space is ASCII's alone: an ideographic space is no indent.
    """
    held: list[str] = []
    indent = ""
    for line in text.split("\n"):
        bare = line.strip(WHITE)
        own = line[: len(line) - len(line.lstrip(WHITE))]
        if held and (not bare or own != indent or NUMBERED.match(line)):
            yield "\n".join(held)
            held = []
        if bare:
            indent = own
            held.append(bare)
    if held:
        yield "\n".join(held)


UNENDED = re.compile(r"(?:[0-9. ]|\([0-9]\)|\bMr)$")


def ends_sentence(text: str, at: int, start: int = 0) -> bool:
    """Whether the full stop at this place ends the sentence that starts at start.

    Not after a digit, a space, another full stop, (1) or Mr, nor before a Latin letter or another full stop.
    """
    if text[at] == "。":
        return True
    after = text[at + 1 : at + 2]
    if after == "." or (after.isascii() and after.isalpha()):
        return False
    return UNENDED.search(text[max(start, at - 3) : at]) is None


def sentences_of(text: str | None) -> list[str]:
    """Sentences that end in an ideographic full stop and fit the size limit."""
    out = []
    for paragraph in paragraphs(text or ""):
        start = 0
        for m in re.finditer("[。.]", paragraph):
            if ends_sentence(paragraph, m.start(), start):
                out.append(paragraph[start : m.end()])
                start = m.end()
        out.append(paragraph[start:])
    out = [s.replace("\n", " ").strip(WHITE) for s in out]
    return [s for s in out if s.endswith("。") and len(s.encode()) <= MAX_SENTENCE_BYTES]


def split_sentences(df: DataFrame, text: str = "content", out: str = "sentences") -> DataFrame:
    """df with an array of the sentences of a text column."""

    return with_column(df, text, out, ArrayType(StringType()), pa.list_(pa.string()), sentences_of)


def truncate_words(x: Column | str, n: int = 255) -> Column:
    """The first n characters, the last three of them dots where something was cut; escaped."""
    x = col(x)
    return escape_html(F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n - 3)), F.lit("..."))).otherwise(x))
