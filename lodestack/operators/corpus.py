"""The corpus: one row shape for every kind of entity, and the projections that make it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType, TimestampType
from pyspark.sql.window import Window

from lodestack.functions.text import join_parts, path_extension, tag

TAG = StructType([StructField("type", StringType()), StructField("name", StringType())])
CORPUS = StructType(
    [
        StructField("source_id", LongType()),
        StructField("source_type", StringType()),
        StructField("project_id", LongType()),
        StructField("container_id", LongType()),
        StructField("container_type", StringType()),
        StructField("custom_field_id", LongType()),
        StructField("is_private", BooleanType()),
        StructField("last_modified_at", TimestampType()),
        StructField("registered_at", TimestampType()),
        StructField("title", StringType()),
        StructField("content", StringType()),
        StructField("tags", ArrayType(TAG)),
    ]
)
#: Source types, in the order in which they are synchronised, and tag types.
SOURCE_TYPES = ("Issue", "Journal", "WikiPage", "CustomValue", "Project", "News", "Document", "Message", "Attachment", "Changeset", "Change")
TAG_TYPES = ("extension", "identifier", "issue-status", "text-extraction", "tracker", "user", "label")
KEY = ["source_type", "source_id"]
#: Deleted paths are broadcast up to so many.
BROADCAST_PATHS = 200_000


def tags(*found: Column) -> Column:
    """An array of the tags that aren't null."""
    return F.array_compact(F.array(*found))


def row(df: DataFrame, source_type: str, **columns: Column | str) -> DataFrame:
    """A projection to the corpus' columns; those that aren't given are null."""
    given = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()} | {"source_type": F.lit(source_type)}
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CORPUS.fields])


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def issue_tags(p: str = "") -> list[Column]:
    return [tag("tracker", f"{p}tracker_id"), tag("user", f"{p}author_id"), tag("issue-status", f"{p}status_id")]


def map_issues(issues: DataFrame) -> DataFrame:
    return row(issues, "Issue", source_id="id", project_id="project_id", is_private="is_private", title="subject", content="description", tags=tags(*issue_tags()), last_modified_at="updated_on", registered_at="created_on")


def map_journals(journals: DataFrame, issues: DataFrame) -> DataFrame:
    """Notes of issues, with the tracker and status that their issue has now."""
    i = issues.select(F.col("id").alias("issue_id"), "project_id", "tracker_id", "status_id", F.col("is_private").alias("issue_private"))
    j = journals.where("journalized_type = 'Issue'").join(i, F.col("journalized_id") == F.col("issue_id"))
    private = F.coalesce("issue_private", F.lit(False)) | F.coalesce("private_notes", F.lit(False))
    found = tags(tag("user", "user_id"), tag("tracker", "tracker_id"), tag("issue-status", "status_id"))
    return row(j, "Journal", source_id="id", project_id="project_id", container_id="issue_id", container_type=F.lit("Issue"), is_private=private, content="notes", tags=found, last_modified_at="updated_on", registered_at="created_on")


def map_wiki_pages(pages: DataFrame, wikis: DataFrame, contents: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Wiki pages; labels (page_id, label) become a set of label tags."""
    w = wikis.select(F.col("id").alias("wiki_id"), "project_id")
    c = contents.select(F.col("page_id"), F.col("text"))
    df = pages.join(w, "wiki_id").join(c, F.col("id") == F.col("page_id"), "left").drop("page_id")
    found = F.array().cast(ArrayType(TAG))
    if labels is not None:
        sets = labels.groupBy("page_id").agg(F.sort_array(F.collect_set(tag("label", "label"))).alias("label_tags"))
        df = df.join(sets, F.col("id") == F.col("page_id"), "left")
        found = F.array_union(found, F.coalesce("label_tags", found))
    return row(df, "WikiPage", source_id="id", project_id="project_id", title="title", content="text", tags=found, last_modified_at="updated_on", registered_at="created_on")


def map_custom_values(values: DataFrame, fields: DataFrame, issues: DataFrame, projects: DataFrame) -> DataFrame:
    """Values of searchable fields of issues and projects that still exist."""
    holders = issues.select(F.lit("Issue").alias("customized_type"), F.col("id").alias("customized_id"), "project_id", "is_private", "updated_on", "created_on").unionByName(
        projects.select(F.lit("Project").alias("customized_type"), F.col("id").alias("customized_id"), F.col("id").alias("project_id"), "updated_on", "created_on"), allowMissingColumns=True
    )
    searchable = fields.where("searchable").select(F.col("id").alias("custom_field_id"))
    df = values.join(searchable, "custom_field_id", "left_semi").join(holders, ["customized_type", "customized_id"])
    return row(df, "CustomValue", source_id="id", project_id="project_id", container_id="customized_id", container_type="customized_type", custom_field_id="custom_field_id", is_private="is_private", content="value", tags=F.array(), last_modified_at="updated_on", registered_at="created_on")


def map_projects(projects: DataFrame) -> DataFrame:
    found = tags(tag("identifier", F.nullif("identifier", F.lit(""))))
    return row(projects, "Project", source_id="id", project_id="id", title="name", content="description", tags=found, last_modified_at="updated_on", registered_at="created_on")


def map_news(news: DataFrame) -> DataFrame:
    filled = lambda c: F.when(F.trim(c) != "", F.col(c))
    return row(news, "News", source_id="id", project_id="project_id", title="title", content=join_parts(filled("summary"), filled("description")), tags=F.array(), last_modified_at="created_on", registered_at="created_on")


def map_documents(documents: DataFrame) -> DataFrame:
    return row(documents, "Document", source_id="id", project_id="project_id", title="title", content="description", tags=F.array(), last_modified_at="created_on", registered_at="created_on")


def map_messages(messages: DataFrame, boards: DataFrame) -> DataFrame:
    df = messages.join(boards.select(F.col("id").alias("board_id"), "project_id"), "board_id")
    return row(df, "Message", source_id="id", project_id="project_id", title="subject", content="content", tags=F.array(), last_modified_at="updated_on", registered_at="created_on")


def container_projects(issues: DataFrame, messages: DataFrame, boards: DataFrame, projects: DataFrame, pages: DataFrame, wikis: DataFrame, documents: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """One table of what an attachment can hang on: container_type, container_id, project_id, is_private, status_id."""
    def of(df: DataFrame, kind: str, project: str = "project_id", **more: str) -> DataFrame:
        return df.select(F.lit(kind).alias("container_type"), F.col("id").alias("container_id"), F.col(project).alias("project_id"), *[F.col(v).alias(k) for k, v in more.items()])

    m, p = messages.select("id", "board_id"), pages.select("id", "wiki_id")
    b = boards.select(F.col("id").alias("board_id"), "project_id")
    w = wikis.select(F.col("id").alias("wiki_id"), "project_id")
    parts = [of(issues, "Issue", is_private="is_private", status_id="status_id"), of(m.join(b, "board_id"), "Message"), of(projects, "Project", "id"), of(p.join(w, "wiki_id"), "WikiPage"), of(documents, "Document")]
    return union(*parts, *([others] if others is not None else []))


def map_attachments(attachments: DataFrame, containers: DataFrame) -> DataFrame:
    """Attachments of known containers: one equi-join on (container_type, container_id)."""
    c = containers.select("container_type", "container_id", "project_id", "is_private", "status_id")
    df = attachments.join(c, ["container_type", "container_id"])
    found = tags(tag("issue-status", "status_id"), tag("extension", path_extension("filename")), tag("text-extraction", F.lit("yet")))
    return row(df, "Attachment", source_id="id", project_id="project_id", container_id="container_id", container_type="container_type", is_private="is_private", title="filename", content="description", tags=found, last_modified_at="created_on", registered_at="created_on")


def map_changesets(changesets: DataFrame, repositories: DataFrame, limit: int | None = None) -> DataFrame:
    """Commits; limit cuts comments to so many characters."""
    df = changesets.join(repositories.select(F.col("id").alias("repository_id"), "project_id"), "repository_id")
    short, long = F.trim("short_comments"), F.trim("long_comments")
    if limit:
        short, long = F.substring(short, 1, limit), F.substring(long, 1, limit)
    return row(df, "Changeset", source_id="id", project_id="project_id", container_id="repository_id", container_type=F.lit("Repository"), title=short, content=long, tags=tags(tag("user", "user_id")), last_modified_at="committed_on", registered_at="committed_on")


def dated_changes(changes: DataFrame, changesets: DataFrame, repositories: DataFrame) -> DataFrame:
    s = changesets.select(F.col("id").alias("changeset_id"), "repository_id", "revision", "committed_on")
    r = repositories.select(F.col("id").alias("repository_id"), "project_id")
    return changes.join(s, "changeset_id").join(r, "repository_id")


def latest_changes(changes: DataFrame, changesets: DataFrame) -> DataFrame:
    """The newest change of every (repository, path), where that isn't a deletion."""
    s = changesets.select(F.col("id").alias("changeset_id"), "repository_id")
    newest = changes.join(s, "changeset_id").groupBy("repository_id", "path").agg(F.max_by(F.struct("id", "action", "changeset_id"), "id").alias("c"))
    return newest.where(F.col("c.action").isin("A", "M", "R")).select("repository_id", "path", "c.*")


def map_changes(changes: DataFrame, changesets: DataFrame, repositories: DataFrame) -> DataFrame:
    """Files in repositories: of each (repository, path) the newest of its added, modified and replaced changes."""
    df = dated_changes(changes, changesets, repositories).where(F.col("action").isin("A", "M", "R"))
    newest = Window.partitionBy("repository_id", "path").orderBy(F.desc("changeset_id"), F.desc("id"))
    df = df.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    return row(df, "Change", source_id="id", project_id="project_id", container_id="repository_id", container_type=F.lit("Repository"), title=F.concat_ws("@", "path", "revision"), tags=tags(tag("extension", path_extension("path"))), last_modified_at="committed_on", registered_at="committed_on")


def change_path(title: Column | str = "title") -> Column:
    return F.regexp_extract(title, r"^(.*)@([^@]*)$", 1)


def apply_deletions(targets: DataFrame, changes: DataFrame) -> DataFrame:
    """targets (repository_id, path, changeset_id, ...) without those that a later deletion of their path or of a folder above removed.

    A deletion counts for nothing if its changeset also adds or replaces something from that path (a move). Folders are
    found by an equi-join on the exploded ancestors of each target's path.
    """
    moved = changes.where(F.col("action").isin("A", "R") & F.col("from_path").isNotNull()).select("repository_id", "changeset_id", F.col("from_path").alias("path")).distinct()
    gone = changes.where("action = 'D'").select("repository_id", "changeset_id", "path").join(moved, ["repository_id", "changeset_id", "path"], "left_anti")
    last = gone.groupBy("repository_id", F.col("path").alias("_above")).agg(F.max("changeset_id").alias("_deleted"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    keys = targets.select("repository_id", "path", "changeset_id")
    few = last.limit(BROADCAST_PATHS + 1).count() <= BROADCAST_PATHS
    keys, last = (keys, F.broadcast(last)) if few else (keys.distinct(), last)
    hit = keys.withColumn("_above", F.explode(above)).join(last, ["repository_id", "_above"]).where("changeset_id < _deleted").select("repository_id", "path", "changeset_id").distinct()
    return targets.join(hit, ["repository_id", "path", "changeset_id"], "left_anti")


def rename_follow(targets: DataFrame, changes: DataFrame) -> DataFrame:
    """targets (repository_id, path, revision, ...) without those that a change copied from: the new path's row replaces them."""
    source = changes.where(F.col("action").isin("A", "M", "R") & F.col("from_path").isNotNull()).select("repository_id", F.col("from_path").alias("path"), F.col("from_revision").alias("revision")).distinct()
    return targets.join(source, ["repository_id", "path", "revision"], "left_anti")


def sync_repository_listing(changes: DataFrame, listing: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changes to keep or upsert, targets to delete) for repositories whose files now are listing (repository_id, path, revision)."""
    keep = changes.join(listing.select("repository_id", "path", "revision").distinct(), ["repository_id", "path", "revision"], "left_semi")
    listed = targets.where("source_type = 'Change'").join(listing.select(F.col("repository_id").alias("container_id")).distinct(), "container_id", "left_semi")
    return keep, listed.join(keep.select(F.col("id").alias("source_id")), "source_id", "left_anti")


def dasherised(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?<=[a-z])(?=[A-Z])", "-"))


def event_type(df: DataFrame) -> Column:
    """What a row is shown as, from source_type, container_type and, where they are known, is_closed, sets_status, parent_id."""
    has = lambda c: F.col(c) if c in df.columns else F.lit(None)
    closed, sets = F.coalesce(has("is_closed").cast("boolean"), F.lit(False)), F.coalesce(has("sets_status").cast("boolean"), F.lit(False))
    kind = F.col("source_type")
    return (
        F.when((kind == "Issue") & closed, "issue-closed")
        .when(kind == "Issue", "issue")
        .when((kind == "Journal") & sets, F.when(closed, "issue-closed").otherwise("issue-edit"))
        .when(kind == "Journal", "issue-note")
        .when(kind == "Message", F.when(has("parent_id").isNull(), "message").otherwise("reply"))
        .when(kind == "Change", "file")
        .when(kind == "CustomValue", dasherised(F.col("container_type")))
        .otherwise(dasherised(kind))
    )


def event_title(df: DataFrame) -> Column:
    """Prefix and title; reads tracker, status, issue_subject, board, revision, repository where df has them."""
    has = lambda c: F.coalesce(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string"), F.lit(""))
    kind, title, me = F.col("source_type"), F.coalesce("title", F.lit("")), F.col("source_id").cast("string")
    place = F.when(has("repository") != "", F.concat(F.lit(" ("), has("repository"), F.lit(")"))).otherwise("")
    return (
        F.when(kind == "Issue", F.concat(has("tracker"), F.lit(" #"), me, F.lit(" ("), has("status"), F.lit("): "), title))
        .when(kind == "Journal", F.concat(has("tracker"), F.lit(" #"), F.col("container_id").cast("string"), F.lit("#change-"), me, F.lit(" ("), has("status"), F.lit("): "), has("issue_subject")))
        .when(kind == "WikiPage", F.concat(F.lit("Wiki: "), title))
        .when(kind == "Project", F.concat(F.lit("Project: "), title))
        .when(kind == "Document", F.concat(F.lit("Document: "), title))
        .when(kind == "Message", F.concat(has("board"), F.lit(": "), title))
        .when(kind == "Changeset", F.concat(F.lit("Revision "), has("revision"), place, F.when(title != "", F.concat(F.lit(": "), title)).otherwise("")))
        .when(kind == "Change", F.concat(has("repository"), F.when(has("repository") != "", ":").otherwise(""), title))
        .otherwise(title)
    )


def event_url(df: DataFrame, search_id: str | None = None, offset: int = 0, index: Column | None = None) -> Column:
    """The address of a row; with search_id it tells which hit of which search was followed."""
    has = lambda c: F.coalesce(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string"), F.lit(""))
    kind, me, inside = F.col("source_type"), F.col("source_id").cast("string"), F.col("container_id").cast("string")
    revision = F.regexp_extract("title", r"^(.*)@([^@]*)$", 2)
    path = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    url = (
        F.when(kind == "Issue", path("/issues/", me))
        .when(kind == "Journal", path("/issues/", inside, "#change-", me))
        .when(kind == "WikiPage", path("/projects/", F.col("project_id").cast("string"), "/wiki/", F.coalesce("title", F.lit(""))))
        .when(kind == "Project", path("/projects/", me))
        .when(kind == "News", path("/news/", me))
        .when(kind == "Message", path("/boards/", has("board_id"), "/topics/", me))
        .when(kind == "Attachment", path("/attachments/", me, "/", F.coalesce("title", F.lit(""))))
        .when(kind == "Changeset", path("/projects/", F.col("project_id").cast("string"), "/repository/revisions/", has("revision")))
        .when(kind == "Change", path("/projects/", F.col("project_id").cast("string"), "/repository/revisions/", revision, "/entry", F.when(change_path().startswith("/"), "").otherwise("/"), change_path()))
        .when(kind == "CustomValue", F.when(F.col("container_type") == "Issue", path("/issues/", inside)).otherwise(path("/projects/", inside)))
        .otherwise(path("/", dasherised(kind), "s/", me))
    )
    if search_id is None or index is None:
        return url
    bare, anchor = F.regexp_extract(url, r"^([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    return F.concat(bare, F.lit(f"?search_id={search_id}&search_n="), (index + F.lit(offset)).cast("string"), anchor)
