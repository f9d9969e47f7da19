from datetime import datetime

from pyspark.sql import functions as F

from lodestack.operators import corpus as c
from lodestack.operators import sync
from lodestack.plans.queries import QUERIES

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
ISSUE = "id long, project_id long, tracker_id long, status_id long, author_id long, subject string, description string, is_private boolean, created_on timestamp, updated_on timestamp"


def tagged(r):
    return [(t.type, t.name) for t in r.tags or []]


def issue_rows(spark):
    return spark.createDataFrame([(1, 7, 2, 3, 4, "S", "D", False, T1, T2), (2, 8, None, 3, None, "S2", None, True, T1, T2)], ISSUE)


def test_issues_and_journals(spark):
    issues = issue_rows(spark)
    got = {r.source_id: r for r in c.map_issues(issues).collect()}
    assert (got[1].title, got[1].content, got[1].last_modified_at, got[1].registered_at) == ("S", "D", T2, T1)
    assert tagged(got[1]) == [("tracker", "2"), ("user", "4"), ("issue-status", "3")] and tagged(got[2]) == [("issue-status", "3")]
    j = spark.createDataFrame([(10, 1, 9, "Issue", "note", True, T1, T2), (11, 2, 9, "Issue", "x", False, T1, T2), (12, 1, 9, "Other", "x", False, T1, T2)], "id long, journalized_id long, user_id long, journalized_type string, notes string, private_notes boolean, created_on timestamp, updated_on timestamp")
    got = {r.source_id: r for r in c.map_journals(j, issues).collect()}
    assert sorted(got) == [10, 11] and got[10].is_private and got[11].is_private and got[10].title is None
    assert (got[10].container_type, got[10].container_id, got[10].project_id) == ("Issue", 1, 7) and tagged(got[10]) == [("user", "9"), ("tracker", "2"), ("issue-status", "3")]


def test_attachments(spark):
    none = spark.createDataFrame([], "id long, board_id long, wiki_id long, project_id long")
    projects = spark.createDataFrame([(5,)], "id long")
    pages, wikis = spark.createDataFrame([(30, 3)], "id long, wiki_id long"), spark.createDataFrame([(3, 77)], "id long, project_id long")
    containers = c.container_projects(issue_rows(spark), none, none, projects, pages, wikis, none)
    rows = [(1, 2, "Issue", "A.TXT"), (2, 5, "Project", ".project"), (3, 30, "WikiPage", "b.tar.gz"), (4, 1, "Unknown", "x"), (5, None, None, "y")]
    a = spark.createDataFrame([(*r, "d", T1) for r in rows], "id long, container_id long, container_type string, filename string, description string, created_on timestamp")
    got = {r.source_id: r for r in c.map_attachments(a, containers).collect()}
    assert sorted(got) == [1, 2, 3] and got[1].is_private and got[2].is_private is None and got[3].project_id == 77
    assert tagged(got[1]) == [("issue-status", "3"), ("extension", "txt"), ("text-extraction", "yet")] and tagged(got[2]) == [("text-extraction", "yet")]


def test_custom_values_and_projects(spark):
    projects = spark.createDataFrame([(8, "P", "proj", "about", T1, T2), (9, "Q", "", None, T1, T2)], "id long, name string, identifier string, description string, created_on timestamp, updated_on timestamp")
    values = spark.createDataFrame([(1, 1, 2, "Issue", "v"), (2, 1, 8, "Project", "w"), (3, 2, 2, "Issue", "hidden"), (4, 1, 99, "Issue", "gone"), (5, 1, 1, "User", "u")], "id long, custom_field_id long, customized_id long, customized_type string, value string")
    fields = spark.createDataFrame([(1, True), (2, False)], "id long, searchable boolean")
    got = {r.source_id: r for r in c.map_custom_values(values, fields, issue_rows(spark), projects).collect()}
    assert sorted(got) == [1, 2] and got[1].is_private and got[2].is_private is None and got[2].project_id == 8
    assert {r.source_id: tagged(r) for r in c.map_projects(projects).collect()} == {8: [("identifier", "proj")], 9: []}


def test_changes_follow_the_newest_and_deletions(spark):
    sets = spark.createDataFrame([(i, 1, f"r{i}", T1) for i in range(1, 7)], "id long, repository_id long, revision string, committed_on timestamp")
    repos = spark.createDataFrame([(1, 5)], "id long, project_id long")
    rows = [(1, 1, "A", "/dir/a.txt", None), (2, 1, "A", "/dir/b.txt", None), (3, 2, "M", "/dir/a.txt", None), (4, 3, "D", "/dir/b.txt", None), (5, 4, "A", "/other/dir.txt", None)]
    ch = spark.createDataFrame(rows, "id long, changeset_id long, action string, path string, from_path string").withColumn("from_revision", F.lit(None).cast("string"))
    assert {r.title for r in c.map_changes(ch, sets, repos).collect()} == {"/dir/a.txt@r2", "/dir/b.txt@r1", "/other/dir.txt@r4"}
    assert {r.path for r in c.latest_changes(ch, sets).collect()} == {"/dir/a.txt", "/other/dir.txt"}
    dated = ch.withColumn("repository_id", F.lit(1).cast("long")).withColumn("revision", F.concat(F.lit("r"), "changeset_id"))
    live = dated.where("action <> 'D'")
    left = lambda more: {r.id for r in c.apply_deletions(live, dated.unionByName(spark.createDataFrame(more, ch.schema).withColumn("repository_id", F.lit(1).cast("long")).withColumn("revision", F.concat(F.lit("r"), "changeset_id")))).collect()}
    assert left([(6, 5, "D", "/dir", None, None)]) == {5}
    assert left([(6, 5, "D", "/dir", None, None), (7, 5, "A", "/renamed", "/dir", "r2")]) == {1, 3, 5}
    moved = spark.createDataFrame([(8, 6, "A", "/new.txt", "/dir/a.txt", "r2")], ch.schema).withColumn("repository_id", F.lit(1).cast("long"))
    assert {r.id for r in c.rename_follow(live, moved).collect()} == {1, 2, 5}
    assert spark.createDataFrame([("file.txt@2026@r9",)], "title string").select(c.change_path()).first()[0] == "file.txt@2026"


def test_synchronise_twice_changes_nothing(spark):
    projects = spark.createDataFrame([(7, "active"), (8, "archived")], "id long, status string")
    issues = issue_rows(spark)
    old = c.map_issues(issues).withColumn("last_modified_at", F.lit(T1)).unionByName(c.map_issues(issues).withColumn("source_id", F.lit(99).cast("long")))
    once = sync.synchronize(old, {"Issue": (issues, c.map_issues)}, projects)
    twice = sync.synchronize(once, {"Issue": (issues, c.map_issues)}, projects)
    assert [(r.source_id, r.last_modified_at) for r in once.collect()] == [(1, T2)] and once.collect() == twice.collect()


def test_cascade_and_labels(spark):
    rows = spark.createDataFrame([("Issue", 1, None, None, None), ("CustomValue", 2, "Issue", 1, 5), ("CustomValue", 3, "Issue", 4, None), ("WikiPage", 6, None, None, None)], "source_type string, source_id long, container_type string, container_id long, custom_field_id long").withColumn("tags", F.lit(None).cast("array<struct<type:string,name:string>>"))
    gone = spark.createDataFrame([("Issue", 1)], "source_type string, source_id long")
    assert {r.source_id for r in sync.cascade_delete(rows, gone).collect()} == {3, 6}
    labels = spark.createDataFrame([(6, "a"), (6, "a"), (6, "b")], "page_id long, label string")
    more = sync.add_label(rows, labels)
    assert {r.source_id: tagged(r) for r in more.collect()}[6] == [("label", "a"), ("label", "b")]
    less = sync.remove_label(more, labels.where("label = 'a'"))
    assert {r.source_id: tagged(r) for r in less.collect()}[6] == [("label", "b")]


def test_synchronizing_joins_each_side_by_id_alone(spark):
    row = "id long, project_id long, tracker_id long, status_id long, author_id long, subject string, description string, is_private boolean, created_on timestamp, updated_on timestamp"
    issues, projects = spark.createDataFrame([], row), spark.createDataFrame([], "id long, status string")
    plan = sync.synchronize(c.map_issues(issues), {"Issue": (issues, c.map_issues)}, projects)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") <= 6, plan


def test_tag_dim_reads_the_corpus_once(spark):
    rows = spark.createDataFrame([([("issue-status", "1"), ("label", "a")],), ([("issue-status", "9"), ("user", "3"), ("tracker", "2")],)], "tags array<struct<type:string,name:string>>")
    dim = sync.build_tag_dim(rows, spark.createDataFrame([(1, "New")], "id long, name string"), None, spark.createDataFrame([(3, None)], "id long, name string"))
    assert {tuple(r) for r in dim.collect()} == {("issue-status", "1", "New"), ("label", "a", "a"), ("user", "3", None)}
    assert dim._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_attach_text_of_negative_ids(spark, tmp_path):
    """As in the query's SQL: a remainder other than 0 and 1, -1 and -2 too, is a failed extraction."""
    spark.createDataFrame([(i, f"text {i}") for i in range(-3, 4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.source_id: (r.content, r.tags) for r in QUERIES["attach_text"](spark, str(tmp_path)).collect()}
    yet, failed = ("about", ["text-extraction:yet"]), ("about", ["text-extraction:error"])
    assert got == {-3: yet, -2: failed, -1: failed, 0: yet, 1: ("about\ntext 1", []), 2: failed, 3: yet}
