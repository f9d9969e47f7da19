import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestack.operators import index as ix
from lodestack.operators import search as s
from lodestack.operators import sync
from lodestack.operators.corpus import CORPUS, map_issues
from lodestack.operators.search import All, Not, Some, Where, word
from lodestack.operators.visibility import Dims, Request

T = datetime(2024, 1, 1)
WORDS = ["red", "blue", "ab12", "fish", "v2", "東京都"]


def row(i, title, content, tags=(), kind="Issue", project=1):
    given = {"source_id": i, "source_type": kind, "project_id": project, "title": title, "content": content, "tags": list(tags), "last_modified_at": T, "registered_at": T}
    return tuple(given.get(n) for n in CORPUS.fieldNames())


def some_rows(rng, ids):
    text = lambda: rng.choice([None, "", " ".join(rng.choices([*WORDS, "other", "red-fish", "redfish"], k=rng.randrange(1, 9)))])
    return [row(i, text(), text(), [("identifier", rng.choice([*WORDS, "red fish"])) for _ in range(rng.randrange(3))], rng.choice(["Issue", "News"])) for i in ids]


def tree(rng, depth=3):
    kind = rng.randrange(4 if depth else 1)
    if kind == 0:
        return rng.choice([word(rng.choice(WORDS)), word("re", prefix=True), s.parse("red-fish").parts[0], s.Word((("blue",), ("red", "fish")))])
    if kind == 1:
        return Not(tree(rng, depth - 1))
    return (All if kind == 2 else Some)(tuple(tree(rng, depth - 1) for _ in range(rng.randrange(1, 3))))


def hits(df):
    return sorted((r.source_type, r.source_id, r.score) for r in df.collect())


def test_random_conditions_find_on_an_index_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(6)
    df = spark.createDataFrame(some_rows(rng, range(40)), CORPUS).repartition(2).persist()
    ix.write_index(df, str(tmp_path / "i"))
    index = ix.read_index(spark, str(tmp_path / "i"))
    trees = [Not(Not(word("ab12"))), Not(All((Not(word("ab12")), Not(word("red"))))), *(tree(rng) for _ in range(22))]
    for x in trees:
        for titles in (False, True):
            request = Request(x, titles_only=titles)
            assert hits(s.find(index.keys, request, Dims(), postings=index.postings)) == hits(s.find(df, request, Dims())), x
    df.unpersist()


def test_an_index_that_was_changed_answers_as_one_made_anew(spark, tmp_path):
    rng = random.Random(7)
    old, folder = some_rows(rng, range(30)), str(tmp_path / "i")
    by_key = {(r[1], r[0]): r for r in old}
    ix.write_index(spark.createDataFrame(list(by_key.values()), CORPUS), folder)
    for step in range(3):
        fresh = {(r[1], r[0]): r for r in some_rows(rng, rng.sample(range(40), 9))}
        gone = rng.sample(sorted(set(by_key) - set(fresh)), 4) + [("Issue", 999)]
        by_key = {k: v for k, v in (by_key | fresh).items() if k not in gone}
        ix.change_index(folder, spark.createDataFrame(list(fresh.values()), CORPUS), spark.createDataFrame(gone, "source_type string, source_id long"))
        if step == 2:
            ix.merge_index(spark, folder)
            assert len(ix.segments(spark, folder)) == 1
        index = ix.read_index(spark, folder)
        now = spark.createDataFrame(list(by_key.values()), CORPUS)
        posted = lambda p: sorted(map(str, p.select("term", "field", "source_type", "source_id", "tf", "positions").collect()))
        assert posted(index.postings) == posted(s.build_postings(now))
        assert sorted(map(str, index.corpus().collect())) == sorted(map(str, now.collect()))
        for q in ("red fish", "ab12"):
            assert hits(s.find(index.keys, Request(q), Dims(), postings=index.postings)) == hits(s.find(now, Request(q), Dims()))


def test_an_index_follows_synchronisation(spark, tmp_path):
    schema = "id long, project_id long, tracker_id long, author_id long, status_id long, subject string, description string, is_private boolean, created_on timestamp, updated_on timestamp"
    issue = lambda i, subject, at=T, project=1: (i, project, 1, 1, 1, subject, "text", False, T, at)
    before = spark.createDataFrame([issue(1, "red"), issue(2, "blue"), issue(3, "green")], schema)
    after = spark.createDataFrame([issue(1, "red"), issue(2, "red now", datetime(2024, 2, 1)), issue(4, "red too"), issue(5, "red", project=9)], schema)
    projects = spark.createDataFrame([(1, "active"), (9, "archived")], "id long, status string")
    corpus, folder = map_issues(before).persist(), str(tmp_path / "i")
    ix.write_index(corpus, folder)
    changed = sync.find_new(after, corpus, "Issue", projects).select(*after.columns).unionByName(sync.find_outdated(after, corpus, "Issue"))
    assert sorted(r.id for r in changed.collect()) == [2, 4]
    ix.change_index(folder, map_issues(changed), sync.find_orphans(after, corpus, "Issue", projects))
    index = ix.read_index(spark, folder)
    now = sync.synchronize(corpus, {"Issue": (after, map_issues)}, projects)
    assert hits(s.find(index.keys, Request("red"), Dims(), postings=index.postings)) == hits(s.find(now, Request("red"), Dims())) == [("Issue", 1, 101), ("Issue", 2, 101), ("Issue", 4, 101)]


def test_a_whole_search_reads_the_texts_of_its_page_alone(spark, tmp_path):
    rng = random.Random(8)
    rows = [row(i, f"red {i}", "the fish " * rng.randrange(1, 4), [("label", "x")], ["Issue", "News"][i % 2], i % 5) for i in range(3000)]
    df = spark.createDataFrame(rows, CORPUS)
    ix.write_index(df, str(tmp_path / "i"))
    index = ix.read_index(spark, str(tmp_path / "i"))
    dims = Dims(visible=spark.createDataFrame([(1,), (2,)], "project_id long"))
    dim = spark.createDataFrame([("label", "x", "X")], "type string, name string, value string")
    for request in (Request("red fish", limit=7, offset=3), Request("fish", types=["news"], limit=-1), Request("fish", limit=0), Request("nothing"), Request(tags=[("label", "x")], limit=3), Request(All((word("red"), Where("source_id < 30"))), limit=5)):
        with ix.search_index(index, request, dims, dim) as got:
            want = s.search(df, request, dims, dim, keep=False)
            shown = lambda r: [(x.source_type, x.source_id, x.score, x.highlighted, x.snippets) for x in r.page.collect()]
            assert shown(got) == shown(want)
            assert [tuple(r) for r in got.counts.collect()] == [tuple(r) for r in want.counts.collect()]
            for part in ("types", "tags"):
                assert sorted(map(str, getattr(got, part).collect())) == sorted(map(str, getattr(want, part).collect()))
    plan = ix.search_index(index, Request("red fish", limit=2), dims, keep=False).page._jdf.queryExecution().executedPlan().toString()
    assert plan.count("content") and "In(source_id" in plan and "/postings" not in plan and "/keys" not in plan
    with pytest.raises(ValueError):
        ix.search_index(index, Request("red", nfkc=True), dims)


def test_an_empty_index(spark, tmp_path):
    folder = str(tmp_path / "i")
    with pytest.raises(ValueError):
        ix.read_index(spark, folder)
    ix.write_index(spark.createDataFrame([], CORPUS), folder)
    ix.change_index(folder, spark.createDataFrame([row(1, "red", None)], CORPUS))
    assert [r.source_id for r in ix.search_index(ix.read_index(spark, folder), Request("red"), Dims(), keep=False).page.collect()] == [1]


def test_many_queries_on_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(s, "DEALT", 20)
    rng = random.Random(9)
    rows = [row(i, f"hot {rng.choice(WORDS)}", " ".join(["hot"] * rng.randrange(8) + rng.choices([*WORDS, f"rare{i % 50}"], k=4))) for i in range(200)]
    df = spark.createDataFrame(rows, CORPUS)
    queries = spark.createDataFrame([(1, "hot"), (2, "hot rare7"), (3, "red Hot blue"), (4, "missing hot"), (5, ""), (6, None), (7, "rare3 rare3"), (8, "red-fish v2")], "query_id long, text string")
    s.write_postings(df, str(tmp_path / "p"))
    stored = s.read_postings(spark, str(tmp_path / "p"))
    tokens = lambda t: s.plain_tokens(t or "")
    want = set()
    for q, text in ((r.query_id, r.text) for r in queries.collect()):
        words = set(tokens(text))
        for r in df.collect():
            title, content = tokens(r.title), tokens(r.content)
            if words and all(w in title or w in content for w in words):
                want.add((q, r.source_id, sum(100 * title.count(w) + min(content.count(w), 5) for w in words)))
    for many in (s.search_many(None, queries, None, postings=stored), s.search_many(df, queries, None)):
        assert {(r.query_id, r.source_id, r.score) for r in many.collect()} == want
    best = s.search_many(None, queries, 3, postings=stored).collect()
    assert {(r.query_id, r.source_id) for r in best if r["rank"] == 1} == {(q, min(i for p, i, n in want if p == q and n == max(m for o, _, m in want if o == q))) for q in {x[0] for x in want}}
    looked = s.search_many(None, queries, None, postings=stored)._jdf.queryExecution().executedPlan().toString()
    assert "p/part" not in looked  # the postings were met before; what is left reads the asked words' rows


def test_postings_of_some_terms_are_those_among_all(spark):
    corpus = spark.createDataFrame([("Issue", 1, "Of the", "the of the x", [("identifier", "The")]), ("Issue", 2, "none", None, None), ("Issue", 3, None, "other", [("label", "of 7")])], "source_type string, source_id long, title string, content string, tags array<struct<type:string,name:string>>")
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(s.build_postings(corpus).where("term in ('of', 'the')"))
    assert rows(s.build_postings(corpus, terms=["of", "the"])) == want and len(want) == 7
    assert rows(s.build_postings(corpus, terms=["of", "the", *(f"w{i}" for i in range(30))])) == want and not rows(s.build_postings(corpus, terms=[]))


def test_postings_of_a_row_are_written_where_it_was_tokenised(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def title(i):
        made.add(1)
        return f"the the the fish{i % 9} of{i}"

    df = spark.createDataFrame([row(i, "", "red the the") for i in range(300)], CORPUS).withColumn("title", F.udf(title, "string")("source_id"))
    ix.write_index(df, str(tmp_path / "i"))
    assert made.value <= 2 * 300  # one pass finds the ranges of ids, one writes the rows
    index = ix.read_index(spark, str(tmp_path / "i"))
    files = index.postings.select("source_id", F.input_file_name().alias("file")).distinct().collect()
    assert len(files) == 300 and len({r.file for r in files}) > 1
    for phrase in (s.Word((("the", "the"),)), s.Word((("the", "fis"),), prefix=True), s.Word((("fish", "0"), ("red", "the", "the")))):
        assert hits(s.find(index.keys, Request(phrase), Dims(), postings=index.postings)) == hits(s.find(index.corpus(), Request(phrase), Dims()))
