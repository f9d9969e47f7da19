"""Personal data by anchor expansion.

An Aho-Corasick automaton walks each text once and reports anchors: at-signs, schemes, identifier cues, digits and
plus signs. From an anchor a local parser finds the bounds of what it stands in and checks it. Nothing between
anchors is looked at, and every parser is deterministic.

Kinds, in this order. The first four are the base: the leftmost non-overlapping matches of a pattern that pass a check.
  email    an at-sign with a local part and a domain of two labels or more
  ip       four dotted numbers up to 255
  card     13 to 19 digits, single spaces or hyphens between them, that pass the Luhn check
  phone    a plus sign and 9 to 15 digits
  iban     after the cue "iban": country, check digits and body that pass the mod-97 check
  account  after a cue such as "account", "acct", "konto": 6 to 17 digits
  ssn      after "ssn" or "social security": a number of the form 3-2-4 with valid parts
  tel      after "tel", "phone", "fax", "mobile": 7 to 15 digits without a plus sign
  login    a URL whose authority names a user before an at-sign
  obscured a mail address written with (at) or [at]
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import named, table, text_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "ssn", "tel", "login", "obscured")

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NUMERIC = frozenset("0123456789 ().+-")
NUMERIC_RUN = re.compile(r"[0-9 ().+-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
GAP = r"(?:\s*(?:no|nr|number|num|code)\b\.?)?[\s:#=.]{1,4}"
#: Letters are spelled out in both cases: when case is ignored, [a-z] also means U+0130, U+0131, U+017F and U+212A.
CUED = {
    "iban": re.compile(r"[\s:=.]{1,4}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})"),
    "account": re.compile(GAP + r"([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I),
    "ssn": re.compile(GAP + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])", re.I),
    "tel": re.compile(GAP + r"(\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14})(?![0-9])", re.I),
}
LOGIN = re.compile(r"://[^\s/@:?#<>\"']+(?::[^\s/@?#<>\"']*)?@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s<>\"']*")
OBSCURED = re.compile(r"\s?[\[(][Aa][Tt][\])]\s?[A-Za-z0-9-]+(?:(?:\.|\s?[\[(][Dd][Oo][Tt][\])]\s?)[A-Za-z0-9-]+)+")
#: What the automaton looks for besides single characters, and the parser of each.
CUES = {
    "iban": "iban", "account": "account", "acct": "account", "konto": "account", "kontonummer": "account", "cuenta": "account",
    "ssn": "ssn", "social security": "ssn",
    "tel": "tel", "phone": "tel", "telephone": "tel", "fax": "tel", "mobile": "tel",
    "https://": "login", "http://": "login", "ftp://": "login", "ssh://": "login",
    "[at]": "obscured", "(at)": "obscured",
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in "0123456789+":
        found.add_word(c, ("number", 1))
    found.add_word("@", ("email", 1))
    for cue, kind in CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def folded(text: str) -> str:
    """text in lower case, character by character, so that places stay."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def low_byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid_iban(text: str) -> bool:
    plain = text.replace(" ", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def cued(kind: str, text: str, end: int) -> tuple[int, int] | None:
    """The bounds of the identifier that follows a cue ending at end."""
    m = CUED[kind].match(text, end)
    if not m:
        return None
    a, b = m.span(1)
    if kind == "iban":
        while b > a and not valid_iban(text[a:b]):  # letters of the next words may have been taken in
            b = text.rfind(" ", a, b)
        return (a, b) if b > a else None
    if kind == "ssn":
        area, group, serial = text[a:b].split("-")
        return (a, b) if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000" else None
    return a, b


def find(text: str | None, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(kind as its place in KINDS, start, end) in code points, by kind and start; none in a null or empty text."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    zone_end = mail_end = 0
    last = dict.fromkeys(KINDS, 0)
    for at, (kind, size) in anchors.iter(folded(text)):
        first = at - size + 1
        if kind == "number":
            if at < zone_end:
                continue
            start = at
            while start > zone_end and text[start - 1] in NUMERIC:
                start -= 1
            zone_end = NUMERIC_RUN.match(text, at).end()
            if zone_end - start < 7:
                continue
            zone = text[start:zone_end]
            out += [(1, start + m.start(), start + m.end()) for m in IP.finditer(zone) if all(map(low_byte, m[0].split(".")))]
            out += [(2, start + m.start(), start + m.end()) for m in CARD.finditer(zone) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
            out += [(3, start + m.start(), start + m.end()) for m in PHONE.finditer(zone) if 9 <= len(digits_of(m[0])) <= 15]
        elif kind == "email":
            start = at
            while start > mail_end and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, at) if start < at else None
            if m:
                mail_end = m.end()
                out.append((0, start, mail_end))
        elif kind in CUED:
            if first and text[first - 1].isalnum():
                continue
            if (span := cued(kind, text, at + 1)) and span[0] >= last[kind]:
                last[kind] = span[1]
                out.append((KINDS.index(kind), *span))
        elif kind == "login":
            m = LOGIN.match(text, at - 2)
            if m and first >= last[kind]:
                last[kind] = m.end()
                out.append((KINDS.index(kind), first, m.end()))
        else:
            start = max(first - 1, 0) if first and text[first - 1] == " " else first
            m, begin = OBSCURED.match(text, start), start
            while begin > last[kind] and text[begin - 1] in LOCAL:
                begin -= 1
            if m and begin < start:
                last[kind] = m.end()
                out.append((KINDS.index(kind), begin, m.end()))
    return sorted(out)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of every row of docs, spans by kind in the order of KINDS, then start.

    Null and empty texts have no spans; rows that repeat are each answered; an empty table gives an empty result;
    further columns of docs are not read, so their names don't matter. Very long texts are walked whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in text_batches(batches):
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in find(t, anchors)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], names=["key", "spans"])

    picked = named(docs, key, text)
    return picked.mapInArrow(run, f"key {picked.schema[0].dataType.simpleString()}, spans {SPANS}").withColumnRenamed("key", key)


def op1_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def covered(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint spans: of overlapping ones the earliest, then the longest, grown to the end of those that it overlaps."""
    out: list[tuple[int, int, int]] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if out and a < out[-1][2]:
            out[-1] = (*out[-1][:2], max(b, out[-1][2]))
        else:
            out.append((k, a, b))
    return out


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with every span of personal data in text replaced by its kind in brackets, as in [EMAIL].

    Rows, their number and all columns stay; texts without personal data stay as they are, null stays null. If length
    names a column, it becomes the length of the new text in the rows that changed.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in text_batches(batches):
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            lengths = batch.column(size := batch.schema.get_field_index(length)).to_pylist() if length else None
            for i, t in enumerate(texts):
                if spans := covered(find(t, anchors)):
                    parts, end = [], 0
                    for k, a, b in spans:
                        parts += [t[end:a], f"[{KINDS[k].upper()}]"]
                        end = b
                    texts[i] = "".join(parts) + t[end:]
                    if length:
                        lengths[i] = len(texts[i])
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if length:
                batch = batch.set_column(size, batch.schema.field(size), pa.array(lengths, batch.schema.field(size).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
