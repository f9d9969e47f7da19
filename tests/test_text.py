import pyarrow as pa
from pyspark.sql import functions as F

from lodestack.functions import text as t


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f("x").alias("y")).first()[0]


def test_bytes_and_cleaning(spark):
    assert one(spark, "こんにちは", lambda x: t.truncate_bytes(x, 7)) == "こん"
    assert one(spark, "abc", lambda x: t.truncate_bytes(x, 7)) == "abc"
    assert one(spark, "A\0B\n", t.clean_text) == "AB\n"
    assert one(spark, bytearray(b"A\xffB"), lambda x: t.clean_text(F.col(x).cast("string")), "binary") == "AB"
    assert one(spark, None, t.clean_text) is None


def test_extensions_and_types(spark):
    got = [one(spark, p, t.path_extension) for p in (".project", "a.tar.gz", "X.TXT", "/d.ir/file", "a/b.c", None)]
    assert got == [None, "gz", "txt", None, "c", None]
    df = spark.createDataFrame([("application/x-tar", "a.tar.gz"), ("application/x-tar", "a.tar.bz2"), ("application/x-tar", "a.tar"), ("text/plain", "a.gz")], "c string, p string")
    assert [r[0] for r in df.select(t.resolve_content_type("c", "p")).collect()] == ["application/gzip", "application/x-bzip2", "application/x-tar", "text/plain"]


def test_normalise_and_tokenize(spark):
    assert one(spark, "ＡＢＣ ｶﾞ Å", t.nfkc_lower) == "abc ガ å"
    assert one(spark, "Plain ASCII", t.nfkc_lower) == "plain ascii"
    assert one(spark, "Hello, wörld 42 東京都 a", lambda x: t.tokenize(x, normalized=False)) == ["hello", "wörld", "42", "東京", "京都", "a"]
    assert one(spark, "犬", t.tokenize) == ["犬"] and one(spark, "", t.tokenize) == []


def test_sizes_and_times(spark):
    assert [one(spark, s, t.parse_size) for s in ("1KB", "1KiB", "1.5MiB", "2GB", "10B", "7", "x")] == [1000, 1024, 1.5 * 1024**2, 2e9, 10, 7, None]
    assert [one(spark, s, t.parse_elapsed) for s in ("12ms", "1.5s", "3", "2m", "1h")] == [0.012, 1.5, 3, 120, 3600]
    assert [one(spark, s, t.format_size, "double") for s in (12.0, 2048.0, 3 * 1024.0**2, 1024.0**3)] == ["12", "2.00KiB", "3.00MiB", "1.00GiB"]
    assert [one(spark, s, t.format_elapsed, "double") for s in (0.5, 2.0, 90.0, 7200.0)] == ["500.00ms", "2.00s", "1.50m", "2.00h"]


def test_html(spark):
    page = '<html><head><title>T</title></head><body><h1>One<a class="wiki-anchor" href="#x">&para;</a></h1> two &lt;b&gt; <script>var x;</script></body></html>'
    assert t.body_text(page) == "One two <b>" and t.body_text("<p> </p>") == "" and t.body_text(None) is None
    assert t.body_text('<a class="wiki-anchor"><b>kept</b>gone</a>') == "kept"
    df = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    assert {r.id: r.text for r in t.markup_to_text(df).collect()} == {1: "One two <b>", 2: None}
    assert one(spark, "<a href='x'>&\"", t.escape_html) == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"


def test_references_end_in_semicolons():
    assert t.body_text("<p>a &amp;&amp;&amp</p><p>R&am, &notit; &quo &amp; &copy;&#39; x&ampy; &nosuch;</p>") == "a &&&ampR&am, &notit; &quo & ©' x&ampy; &nosuch;"
    assert t.body_text('<a class="wiki-anchor" href="?a&amp=1&b">x</a>&nbsp;end&nbsp;\n') == "\xa0end\xa0"
    assert t.body_text("<script>a && b &amp</script>c &") == "c &"


def test_parts_and_tags(spark):
    df = spark.createDataFrame([("a", "", "c")], "a string, b string, c string")
    assert df.select(t.join_parts("a", "b", "c")).first()[0] == "a\nc"
    df = spark.sql("select array(named_struct('type','extension','name','txt'), named_struct('type','text-extraction','name','yet')) as tags, cast(null as string) as content")
    assert [tuple(x) for x in df.select(t.extraction_state("tags", "content")).first()[0]] == [("extension", "txt"), ("text-extraction", "error")]
    assert [tuple(x) for x in df.select(t.extraction_state("tags", F.lit("x"))).first()[0]] == [("extension", "txt")]


def test_sentences_and_words(spark):
    assert t.sentences_of("一つ。二つ。\nThree.\n\n四つ。") == ["一つ。", "二つ。", "四つ。"]
    assert t.sentences_of("Mr. 田中は v1.2 を使う。") == ["Mr. 田中は v1.2 を使う。"]
    assert t.sentences_of("一行目\n二行目。") == ["一行目 二行目。"] and t.sentences_of("前。\n(1) 次。") == ["前。", "(1) 次。"]
    assert t.sentences_of("終わり.次の文。") == ["次の文。"] and t.sentences_of("前\n１ 次。\n（① 後。\n\t続き。") == ["１ 次。", "（① 後。", "続き。"]
    assert t.sentences_of("(1). 次。") == ["(1). 次。"] and t.sentences_of("tar.gz を..使う。") == ["tar.gz を..使う。"]
    assert t.sentences_of("あ" * 700 + "。") == [] and t.sentences_of(None) == []
    assert one(spark, "x" * 300, t.truncate_words) == "x" * 252 + "..." and one(spark, "<", t.truncate_words) == "&lt;"
    df = spark.createDataFrame([(1, "一つ。二つ。")], "id long, content string")
    assert t.split_sentences(df).first().sentences == ["一つ。", "二つ。"]


def test_lines_end_at_line_feeds_and_white_space_is_ascii():
    assert t.sentences_of("\u3000最初の行\n次の行。") == ["\u3000最初の行 次の行。"]
    assert t.sentences_of("一\u2028二\x85三。\r\n四\f\r\n五。") == ["一\u2028二\x85三。", "四 五。"]
    assert t.sentences_of("  字下げ\n  続き。\n別の段落。") == ["字下げ 続き。", "別の段落。"]


def test_unclosed_and_nested_elements_take_linear_time():
    import time

    began = time.perf_counter()
    assert t.body_text("<b>x" * 100_000) == "x" * 100_000
    assert t.body_text("<i>" * 50_000 + "</b>" * 50_000 + "y" + "</i>" * 50_000) == "y"
    assert t.body_text("<p><title>a</p>b" * 30_000) == "b" * 30_000
    assert time.perf_counter() - began < 20
    assert t.body_text("<div>a<title>b</div>c") == "ac"


def test_python_holds_a_slice_of_a_batch(spark):
    """A batch of 24 MB of texts comes back in parts, each of about the bytes that a task may hold, with all rows in their order."""
    df = spark.range(600).coalesce(1).select("id", F.repeat(F.lit("一つ。"), 4_000).alias("content"))
    found = t.split_sentences(df)
    got = found.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.column(0)[0].as_py()])], names=["n", "first"]) for b in batches), "n long, first long").collect()
    assert found.agg(F.sum(F.size("sentences")), F.count("*")).first()[:] == (600 * 4_000, 600)
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(["一つ。" * 4_000] * 600)], names=["id", "content"])
    parts = list(t.slices(batch, t.SLICE_BYTES))
    assert len(parts) > 15 and max(p.nbytes for p in parts) <= t.SLICE_BYTES and sum((p.column(0).to_pylist() for p in parts), []) == list(range(600))
    assert sum(r.n for r in got) == 600
