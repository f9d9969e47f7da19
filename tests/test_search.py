from datetime import datetime

import pytest


from lodestack.operators import search as s
from lodestack.operators import synonyms, visibility
from lodestack.operators.corpus import CORPUS
from lodestack.operators.search import All, Not, Some, Where, word
from lodestack.operators.visibility import Dims, Request

T = datetime(2024, 1, 1)


def corpus(spark, *rows):
    """Rows of (id, type, title, content) and then further columns by name."""
    names = CORPUS.fieldNames()
    full = []
    for i, kind, title, content, *more in rows:
        full.append(tuple(({"source_id": i, "source_type": kind, "project_id": 1, "title": title, "content": content, "last_modified_at": T, "registered_at": T, "tags": []} | (more[0] if more else {})).get(n) for n in names))
    return spark.createDataFrame(full, CORPUS)


def scores(df):
    return {r.source_id: r.score for r in df.collect()}


def found(df, query, **more):
    return scores(s.find(df, Request(query, **more), Dims()))


def test_golden_scores(spark):
    df = corpus(
        spark,
        (6, "Issue", "Issue of a private subproject", "this private subproject"),
        (1, "Issue", "Cannot print recipes", "unable to print recipes"),
        (4, "Journal", None, "a private version"),
    )
    query = Some((word("print"), All((word("private"), Some((word("subproject"), word("version")))))))
    assert found(df, query) == {6: 203, 1: 102, 4: 3}
    df = corpus(spark, (1, "Message", "First post", "the first post here"), (3, "Message", "First post again", "nothing"), (2, "Message", "First reply", "reply to the first post"))
    assert found(df, "first post") == {1: 203, 3: 201, 2: 103}
    df = corpus(spark, (1, "Project", "eCookbook", None, {"tags": [("identifier", "ecookbook")]}), (5, "Project", "Private eCookbook", None), (6, "Project", "Other", None, {"tags": [("identifier", "project6")]}))
    assert found(df, Some((word("project6"), word("eCookbook")))) == {1: 102, 5: 101, 6: 2}


def test_counts_and_their_cap(spark):
    df = corpus(spark, *[(n, "Issue", "t", "word " * n) for n in (1, 2, 3, 7)])
    assert found(df, "word") == {1: 2, 2: 3, 3: 4, 7: 6} and found(df, "word", types=["issues"])[1] == 3
    assert found(corpus(spark, (1, "Issue", "word word", "word")), "word", titles_only=True) == {1: 3}


def test_conditions(spark):
    df = corpus(spark, (1, "Issue", "AAA aaa(zzz ZZZ", None), (2, "Issue", "title one", "content two"), (3, "News", "東京都庁", None), (4, "Issue", "two one", None))
    assert sorted(found(df, "aaa(zzz")) == [1] and sorted(found(df, "one two")) == [2, 4]
    assert sorted(found(df, Not(word("one")))) == [1, 3] and sorted(found(df, word("tit", prefix=True))) == [2]
    assert sorted(found(df, "東京")) == [3] and sorted(found(df, "京都庁")) == [3] and sorted(found(df, "東庁")) == []
    assert sorted(found(df, All((word("one"), Where("source_id > 2"))))) == [4]
    assert found(df, "") == {1: 1, 2: 1, 3: 1, 4: 1}
    p = s.build_postings(df)
    for q in (All((word("one"), word("two"))), s.parse("aaa(zzz"), s.parse("京都庁"), word("tit", prefix=True)):
        plain = {k: v - 1 for k, v in found(df, q).items()}
        assert {r.source_id: r.score for r in s.match_postings(p, q).collect()} == plain


def test_written_postings_find_what_a_scan_finds(spark, tmp_path):
    tagged = {"tags": [("identifier", "red-shop"), ("tracker", "1"), ("identifier", "blue fish")]}
    df = corpus(
        spark, (1, "Issue", "red fish red fish", "green"), (2, "Issue", "blue", "fish red"), (3, "News", "greenhouse", None), (4, "Issue", None, None), (5, "Project", "Shop", "none", tagged),
        (6, "Issue", "m² and 東京都庁", "red fishes " * 9),
    )
    s.write_postings(df, str(tmp_path / "p"))
    p = s.read_postings(spark, str(tmp_path / "p"))
    fish = s.parse("red-fish")
    trees = [
        Not(word("red")), Some((word("green"), Not(word("red")))), Some((fish, word("gre", prefix=True))), word("red-fi", prefix=True), All((word("blue"), word("shop"))), word("red"),
        All((word("fish"), Not(word("red")))), s.parse("m²"), s.parse("京都"), Some((word("nothing"), word("shop"))), All((word("fish"), Not(fish))), word("red-sh", prefix=True), s.Word((("green",), ("red", "fish"))),
    ]
    for tree in trees:
        for titles in (False, True):
            request = Request(tree, titles_only=titles)
            assert scores(s.find(df, request, Dims(), postings=p)) == scores(s.find(df, request, Dims())), tree
    plan = s.match_postings(p, All((word("red"), word("fish"))))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [fish,red])" in plan
    with pytest.raises(ValueError):
        s.match_postings(p, Not(word("red")))
    with pytest.raises(ValueError):
        s.match_postings(p, Where("source_id = 1"))


def test_full_width_words_meet_after_nfkc(spark):
    df = corpus(spark, (1, "Issue", "ＡＢＣ ㌔", None), (2, "Issue", "abc", None), (3, "Issue", "abd", None))
    wide = s.build_postings(df, normalized=False)
    for query in ("abc", "ＡＢＣ"):
        assert sorted(found(df, query, nfkc=True)) == [1, 2] == sorted(scores(s.find(df, Request(query, nfkc=True), Dims(), postings=wide)))
    assert sorted(found(df, "abc")) == [2] and sorted(found(df, "キロ", nfkc=True)) == [1]


def test_marks_of_cjk_runs_and_of_starts_of_words(spark):
    df = spark.createDataFrame([("東京都庁へ greenhouse ofthe of the v2",)], "title string")
    words = s.query_words(Some((s.parse("京都庁"), word("gre", prefix=True), s.parse("of-the"), s.parse("v2"))))
    k = '<span class="keyword">'
    want = f"東{k}京都庁</span>へ {k}gre</span>enhouse ofthe {k}of the</span> {k}v2</span>"
    assert df.select(s.highlight("title", words)).first()[0] == want and s.snippets_of(df.first()[0], words) == [want]


def test_synonyms(spark):
    df = corpus(spark, (1, "Issue", "press", None), (2, "Issue", "print", None))
    pairs = lambda *x: spark.createDataFrame(list(x), "source string, destination string")
    hits = lambda p: sorted(scores(s.find(df, Request("Press"), Dims(), p)))
    assert hits(pairs(("press", "press"), ("press", "print"))) == [1, 2] and hits(pairs(("press", "print"))) == [2] and hits(pairs(("x", "y"))) == [1]
    shown = s.expand_preview(spark.createDataFrame([("press on",)], "query string"), pairs(("press", "press"), ("press", "print")))
    assert shown.first().expanded == "(press OR print) on"


def test_sort_and_page(spark):
    later = datetime(2024, 2, 1)
    df = corpus(spark, (1, "Issue", "a", "word"), (2, "Issue", "word", None), (3, "Issue", "b", "word", {"last_modified_at": later, "registered_at": datetime(2023, 1, 1)}))
    order = lambda **k: [r.source_id for r in s.page(s.find(df, Request("word", **k), Dims()), Request("word", **k)).collect()]
    assert order() == [2, 3, 1] and order(descending=False) == [3, 1, 2] and order(order="date") == [3, 1, 2] and order(order="registered_time") == [1, 2, 3]
    assert order(offset=1, limit=1) == [3] and order(limit=-1) == [2, 3, 1] and s.page_offset(3, 10) == 20
    empty = s.search(df, Request(""), Dims(), keep=False)
    assert empty.page.count() == 0 and empty.types.collect()[0].n == 3


def test_highlight_and_snippets(spark):
    df = spark.createDataFrame([("The <b> theory of THE",)], "x string")
    assert df.select(s.highlight("x", ["the"])).first()[0] == '<span class="keyword">The</span> &lt;b&gt; theory of <span class="keyword">THE</span>'
    text = "x " * 200 + "needle " + "y " * 300 + "needle" + " <z>" * 100
    got = s.snippets_of(text, ["needle"])
    assert len(got) == 2 and all('<span class="keyword">needle</span>' in g for g in got)
    assert s.snippets_of("none here", ["needle"]) == [] and s.snippets_of(None, ["x"]) == []
    page = s.snippets(corpus(spark, (1, "Issue", "t", "w" * 300), (2, "Issue", "t", "a needle")), ["needle"])
    assert {r.source_id: r.snippets for r in page.collect()} == {1: ["w" * 252 + "..."], 2: ['a <span class="keyword">needle</span>']}


def test_drilldowns(spark):
    df = corpus(spark, (1, "Issue", "a", None, {"tags": [("tracker", "1")]}), (2, "Journal", None, "b", {"container_type": "Issue", "tags": [("tracker", "1"), ("user", "9")]}), (3, "News", "c", None))
    assert {r.type: r.n for r in s.type_drilldown(df).collect()} == {"Issue": 2, "Journal": 1, "News": 1}
    dim = spark.createDataFrame([("tracker", "1", "Bug")], "type string, name string, value string")
    assert [tuple(r) for r in s.tag_drilldown(df, dim).select("type", "value", "n").collect()] == [("tracker", "Bug", 2)]
    assert tuple(s.hit_counts(df, ["news"]).first()) == (1, 3)


def test_negations_keep_nulls(spark):
    df = corpus(spark, (1, "Issue", "a", None, {"is_private": None, "tags": None}), (2, "Issue", "b", None, {"is_private": True}), (3, None, "c", None, {"tags": [("issue-status", "5")]}), (4, "Attachment", "d", None, {"container_type": "Issue", "custom_field_id": 3}))
    ids = lambda d: sorted(r.source_id for r in d.collect())
    assert ids(visibility.hide_private(df)) == [1, 3, 4]
    statuses = spark.createDataFrame([(5, True), (6, False)], "id long, is_closed boolean")
    assert ids(visibility.open_issues(df, statuses)) == [1, 2, 4]
    assert ids(visibility.attachments(df, "0")) == [1, 2, 3] and ids(visibility.attachments(df, "only")) == [1, 2, 3, 4]
    assert ids(visibility.select_types(df, ["news"])) == [3] and ids(visibility.select_types(df, [])) == [1, 2, 3, 4]
    assert ids(visibility.visible_fields(df, spark.createDataFrame([(3,)], "custom_field_id long"))) == [1, 2, 3]
    p = spark.createDataFrame([(1,)], "project_id long")
    none = spark.createDataFrame([], "project_id long, search_type string")
    assert ids(visibility.permitted(df, p, none)) == [3] and ids(visibility.with_tags(df, [("issue-status", "5")])) == [3]


def test_scopes(spark):
    df = corpus(spark, *[(i, "Project" if i == 9 else "Issue", "a", None, {"project_id": p}) for i, p in ((1, 1), (2, 2), (3, 3), (4, 4), (9, 2))])
    projects = spark.createDataFrame([(1, None, "active"), (2, 1, "active"), (3, 2, "active"), (4, 1, "archived")], "id long, parent_id long, status string")
    of = lambda *x: spark.createDataFrame([(i,) for i in x], "project_id long")
    dims = Dims(projects=projects, visible=of(1, 2, 3), mine=of(3, 4))
    ids = lambda **k: sorted(r.source_id for r in visibility.visible(df, Request(**k), dims).collect())
    assert ids() == [1, 2, 3, 9] and ids(scope="my_projects") == [3] and ids(scope="subprojects", project_id=2) == [2, 3, 9] and ids(scope="project", project_id=2) == [2]


def test_similar_words(spark):
    rows = [("▁Press", "print", 0.995), ("a b", "c", 1.0), ("x", "yy", 1.0), ("12", "yy", 1.0), ("本が", "本棚", 1.0), ("東京", "東京都", 1.0), ("low", "cosine", 0.5), ("no", "cosine", None), ("ＷＩＤＥ", "narrow", 1.0), ("", "empty", 1.0)]
    got = synonyms.filter_similar_words(spark.createDataFrame(rows, "source string, destination string, cosine double"))
    assert {(r.source, r.destination) for r in got.collect()} == {("press", "print"), ("no", "cosine"), ("wide", "narrow")}
    both = synonyms.symmetric_expansions(spark.createDataFrame([("a", "b"), ("c", "c")], "source string, destination string"))
    assert [tuple(r) for r in both.collect()] == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]
    table = spark.createDataFrame([("a", "b", T, T), ("old", "x", T, T)], "source string, destination string, created_at timestamp, updated_at timestamp")
    new, bad = synonyms.sync_expansions(table, spark.createDataFrame([("a", "b"), ("c", "d"), (" ", "x"), ("y", None)], "source string, destination string"))
    assert {r.source: r.created_at == T for r in new.collect()} == {"a": True, "c": False} and bad.count() == 2


def test_highlight_marks_the_text_and_not_its_entities(spark):
    df = spark.createDataFrame([("R&D <amp> lt",), (None,)], "title string")
    got = [r[0] for r in df.select(s.highlight("title", ["amp", "lt"])).collect()]
    assert got == ['R&amp;D &lt;<span class="keyword">amp</span>&gt; <span class="keyword">lt</span>', None]
