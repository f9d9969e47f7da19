import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import pii

SF = "/root/testdata/sf0.001"
ANCHORS = pii.automaton()


def brute(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def base(text):
    return [(pii.KINDS[k], a, b) for k, a, b in pii.find(text, ANCHORS) if pii.KINDS[k] in pii.BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="01249.+-() @ab_%é\n", max_size=60))
def test_base_equals_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["4111 1111 1111 1111", "10.0.0.255", "1.2.3.256", "+1 (523) 555-1055", "a.b@c.de", "@", ".", " ", "x", "+", "-", "12", "1.1.1.1.1", "5"]), max_size=14))
def test_base_equals_patterns_on_parts(parts):
    assert base("".join(parts)) == brute("".join(parts))


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = pii.op1_pii_anchor_expansion(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.BASE)
    assert any(r.n_email for r in rows) and any(r.n_card for r in rows)


def test_added_kinds():
    def got(text):
        return [(pii.KINDS[k], text[a:b]) for k, a, b in pii.find(text, ANCHORS)]

    assert got("IBAN: DE89 3704 0044 0532 0130 00 is mine") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert got("iban DE88 3704 0044 0532 0130 00") == []
    assert got("Account no. 12345678.") == [("account", "12345678")]
    assert got("accountant 12345678") == []
    assert got("SSN 123-45-6789, ssn 000-45-6789") == [("ssn", "123-45-6789")]
    assert got("Tel: 030 1234567") == [("tel", "030 1234567")]
    assert got("see https://bob:pw@host.example/x and https://host.example/y") == [("email", "pw@host.example"), ("login", "https://bob:pw@host.example/x")]
    assert got("write to bob [at] example [dot] com") == [("obscured", "bob [at] example [dot] com")]
    assert got("") == [] and got("plain words only, 12 of them.") == []


def test_redaction_and_edges(spark):
    long = "word " * 200_000 + "a@b.cd"
    rows = [(1, None, 0), (2, "", 0), (3, "mail a@b.cd now", 15), (3, "mail a@b.cd now", 15), (4, "clean text", 10), (5, long, len(long)), (None, "10.1.2.3", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("spans", F.lit("clash")).withColumn("key", F.lit(1))
    out = pii.redact(docs, length="n_chars")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)
    want = [(1, None, 0), (2, "", 0), (3, "mail [EMAIL] now", 16), (3, "mail [EMAIL] now", 16), (4, "clean text", 10), (5, "word " * 200_000 + "[EMAIL]", 1_000_007), (None, "[IP]", 4)]
    assert got == sorted(want, key=str)
    assert pii.find_pii(docs).count() == 7 and pii.find_pii(docs.limit(0)).count() == 0


def test_long_numbers_and_cues_in_any_case():
    anchors = pii.automaton()
    for text in ("1" * 5000 + ".1.1.1", "1.2.3." + "9" * 6000):
        assert not [x for x in pii.find(text, anchors) if x[0] == 1]
    assert (1, 0, 5008) in pii.find("0" * 5000 + "1.1.1.25", anchors)
    for text in ("Social Security 123-45-6789", "İ SOCIAL security: 123-45-6789", "sOcIaL sEcUrItY 123-45-6789"):
        assert [text[a:b] for k, a, b in pii.find(text, anchors) if pii.KINDS[k] == "ssn"] == ["123-45-6789"]


def test_letters_beyond_ascii_after_cues(spark):
    odd = [chr(c) for c in range(128, 0x10000) if chr(c).lower() != chr(c).upper() and not 0xD800 <= c < 0xE000]
    for cue, number in (("IBAN", "DE8937040044053201{}000"), ("IBAN", "D{}89370400440532013000"), ("konto", "1234{}5678"), ("tel", "030 12{}34567"), ("ssn", "123-45-67{}89"), ("https://a{}:b@c", ".de"), ("bob [at] ex{}", "ample.com")):
        for c in odd:
            pii.find(f"{cue} {number}".replace("{}", c), ANCHORS)
    assert pii.find("bob [at] ex\u212aample [dot] com", ANCHORS) == []
    docs = spark.createDataFrame([(i, f"IBAN DE8937040044053201{c}000", 0) for i, c in enumerate("\u0130\u0131\u017f\u212a")], "doc_id long, text string, n_chars long")
    assert [r.text for r in pii.redact(docs).orderBy("doc_id").collect()] == [r.text for r in docs.orderBy("doc_id").collect()]
