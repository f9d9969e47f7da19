import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from lodestack.operators import exports
from lodestack.operators.exports import issue_histories
from lodestack.sources import sinks

T = datetime(2024, 1, 2, 3, 4, 5)


def tables(spark):
    issues = spark.createDataFrame([(1, 5, "first", None, 7, 8, 2, 3, T, T, 1.5), (2, 5, "bare", "d", None, None, None, None, T, T, None), (3, 6, "other", "d", 99, None, 2, None, T, T, None)], "id long, project_id long, subject string, description string, author_id long, assigned_to_id long, status_id long, priority_id long, created_on timestamp, updated_on timestamp, estimated_hours double")
    journals = spark.createDataFrame([(12, 1, "Issue", 7, "later id, earlier time", datetime(2023, 1, 1)), (11, 1, "Issue", 9, "", T), (13, 1, "Page", 7, "no issue's", T)], "id long, journalized_id long, journalized_type string, user_id long, notes string, created_on timestamp")
    rows = [(5, 11, "attr", "status_id", "1", "2"), (3, 11, "attr", "category_id", None, "4"), (4, 11, "attr", "fixed_version_id", "6", "77"), (2, 11, "cf", "31", "a", None), (9, 11, "attachment", "8", None, "f.txt"), (1, 12, "attr", "subject", "old", "new"), (6, 11, "attr", "assigned_to_id", "7", "")]
    details = spark.createDataFrame(rows, "id long, journal_id long, property string, prop_key string, old_value string, value string")
    names = lambda *x: spark.createDataFrame(list(x), "id long, name string")
    dims = {"author": names((7, "Ann")), "assigned_to": names((7, "Ann"), (8, "Bob")), "category": names((4, "UI")), "fixed_version": names((6, "v6"))}
    dims["status"] = spark.createDataFrame([(1, "New", False), (2, "Done", True)], "id long, name string, is_closed boolean")
    dims["priority"] = spark.createDataFrame([(3, "High", 1)], "id long, name string, number long")
    hours = spark.createDataFrame([(1, 0.5), (1, 2.0)], "issue_id long, hours double")
    return issues, journals, details, dims, hours, names((31, "Area"))


def test_records_name_what_changed_in_the_order_of_ids(spark):
    got = {r.issue.id: r.issue.asDict(True) for r in issue_histories(*tables(spark)).collect()}
    one = got[1]
    assert [h["comment"] for h in one["history"]] == ["", "later id, earlier time"] and one["elapsed_hours"] == 2.5
    full = lambda **k: dict.fromkeys(("type", "id", "name", "is_closed", "number", "text")) | k
    assert one["history"][0]["changes"] == [
        {"type": "custom_field", "custom_field": {"id": "31", "name": "Area"}, "old": full(text="a"), "new": None},
        {"type": "category", "custom_field": None, "old": None, "new": full(type="category", id="4", name="UI")},
        {"type": "fixed_version", "custom_field": None, "old": full(type="version", id="6", name="v6"), "new": full(type="version", id="77")},
        {"type": "status", "custom_field": None, "old": full(type="status", id="1", name="New", is_closed=False), "new": full(type="status", id="2", name="Done", is_closed=True)},
        {"type": "assigned_to", "custom_field": None, "old": full(type="user", id="7", name="Ann"), "new": full(type="user", id="")},
        {"type": "attachment", "custom_field": None, "old": None, "new": full(text="f.txt")},
    ]
    assert one["history"][1]["changes"] == [{"type": "subject", "custom_field": None, "old": full(text="old"), "new": full(text="new")}]
    assert one["author"] == full(type="user", id="7", name="Ann") and one["assignee"]["name"] == "Bob" and one["priority"]["number"] == 1 and one["status"]["is_closed"]
    assert one["history"][0]["user"] == full(type="user", id="9") and got[2]["author"] is None and got[2]["history"] == [] and got[3]["author"]["name"] is None


def test_a_projects_files_are_one_array(spark, tmp_path):
    issues, *rest = tables(spark)
    many = issues.where("id = 1").crossJoin(spark.range(10, 400).select(F.col("id").alias("n"))).withColumn("id", F.col("n")).drop("n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.export_issue_histories(issue_histories(issues.unionByName(many), *rest), str(tmp_path / "out"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {}
    for folder in sorted(Path(tmp_path / "out").glob("project=*")):
        parts = sorted(folder.glob("part-*"))
        found[folder.name] = json.loads("".join(p.read_text() for p in parts))
    assert [i["id"] for i in found["project=5"]] == [1, 2, *range(10, 400)] and [i["id"] for i in found["project=6"]] == [3]
    assert len(list(Path(tmp_path / "out" / "project=5").glob("part-*"))) > 1
    first = found["project=5"][0]
    assert first["history"][0]["changes"][1] == {"type": "category", "new": {"type": "category", "id": "4", "name": "UI"}} and "description" not in first
    assert first["created_at"].startswith("2024-01-02T03:04:05")
    empty = issue_histories(issues.limit(0), *rest)
    sinks.export_issue_histories(empty, str(tmp_path / "none"))
    assert not list(Path(tmp_path / "none").glob("project=*"))


def test_notes_and_changes_meet_by_issue_once(spark):
    """Nothing that holds a history is shuffled, and details that know their issue aren't joined to their journals."""
    issues, journals, details, *rest = tables(spark)
    own = journals.select(F.col("id").alias("journal_id"), F.col("journalized_id").alias("issue_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = issue_histories(issues, journals, details.join(F.broadcast(own), "journal_id"), *rest)
        shuffles = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(shuffles) <= 3, shuffles  # notes with changes, issues, hours
    assert sorted(map(str, found.collect())) == sorted(map(str, issue_histories(issues, journals, details, *rest).collect()))


def test_names_too_many_to_broadcast_meet_narrow_rows(spark, monkeypatch):
    """They shuffle notes or details alone; the wide rows of an issue stay where its narrow ones met."""
    expected = sorted(map(str, issue_histories(*tables(spark)).collect()))
    monkeypatch.setattr(exports, "BROADCAST_NAMES", 0)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = issue_histories(*tables(spark))
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(str, found.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert rows == expected and "BroadcastHashJoin" not in plan
    assert not [x for x in shuffles if "journal_id" in x and "_issue" in x], shuffles


def test_files_may_be_compressed(spark, tmp_path):
    sinks.export_issue_histories(issue_histories(*tables(spark)), str(tmp_path / "out"), "gzip")
    assert list(Path(tmp_path / "out").glob("project=5/part-*.gz"))
    lines = spark.read.text(str(tmp_path / "out")).orderBy("project", "value").select("value").collect()
    assert len(lines) == 3 and sum(r.value.startswith("[") for r in lines) == 2 and sum(r.value.endswith("]") for r in lines) == 2
