"""Which rows of the corpus a search may show. Every negation keeps rows whose columns are null."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Search types, the source type each covers, and the permission each needs.
SEARCH_TYPES = {
    "issues": ("Issue", "Journal"),
    "news": ("News",),
    "documents": ("Document",),
    "changesets": ("Changeset",),
    "wiki_pages": ("WikiPage",),
    "messages": ("Message",),
    "projects": ("Project",),
    "changes": ("Change",),
    "files": ("File",),
}
PERMISSIONS = {"changes": "changesets", "journals": "issues", "projects": "project"}


def is_true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def without(x: Column) -> Column:
    """NOT x, where an unknown x counts as false."""
    return ~is_true(x)


@dataclass
class Request:
    """A search: what is asked, where, and how it is sorted and paged."""

    query: object | None = None
    scope: str = "all"
    project_id: int | None = None
    titles_only: bool = False
    tags: list[tuple[str, str]] = field(default_factory=list)
    open_issues: bool = False
    attachments: str = "1"
    types: list[str] = field(default_factory=list)
    order: str = "score"
    descending: bool = True
    offset: int = 0
    limit: int = 10
    nfkc: bool = False  # words meet after NFKC, in query and texts

    def has_condition(self) -> bool:
        return bool(self.query) or bool(self.tags) or self.open_issues or bool(self.types)


@dataclass
class Dims:
    """What visibility depends on. projects: id, parent_id, status (with "active"); visible and mine: project_id.

    statuses: id, is_closed; hidden_fields: custom_field_id; permissions: project_id, search_type (those a user has).
    Any may be missing, and then hides nothing.
    """

    projects: DataFrame | None = None
    visible: DataFrame | None = None
    mine: DataFrame | None = None
    statuses: DataFrame | None = None
    hidden_fields: DataFrame | None = None
    permissions: DataFrame | None = None


def descendants(projects: DataFrame, root: int, most: int = 50) -> DataFrame:
    """project_id of root and of the active projects below it, level by level."""
    tree = projects.where("status = 'active'").select("id", "parent_id")
    found = level = projects.where(F.col("id") == root).select(F.col("id").alias("project_id"))
    for _ in range(most):
        level = tree.join(level, F.col("parent_id") == F.col("project_id"), "left_semi").select(F.col("id").alias("project_id")).join(found, "project_id", "left_anti")
        if level.isEmpty():
            return found
        found = found.union(level)
    raise ValueError("projects are nested too deeply, or in a circle")


def scope(corpus: DataFrame, request: Request, dims: Dims) -> DataFrame:
    """Rows of the visible projects that the request's scope covers."""
    seen = dims.visible
    if request.scope == "my_projects":
        wanted = dims.mine
    elif request.project_id is not None and request.scope == "subprojects":
        wanted = descendants(dims.projects, request.project_id)
    elif request.project_id is not None and request.scope != "all":
        return scope_of(corpus.where(F.col("project_id") == request.project_id), seen)
    else:
        wanted = None
    return scope_of(scope_of(corpus, seen), wanted)


def scope_of(corpus: DataFrame, projects: DataFrame | None) -> DataFrame:
    return corpus if projects is None else corpus.join(projects.select("project_id").distinct(), "project_id", "left_semi").select(*corpus.columns)


def hide_project_rows(corpus: DataFrame, request: Request) -> DataFrame:
    """With exactly one project chosen, projects themselves aren't hits."""
    if request.project_id is None or request.scope in ("all", "my_projects", "subprojects"):
        return corpus
    return corpus.where(without(F.col("source_type") == "Project"))


def tag_literal(kind: str, name: str) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"))


def with_tags(corpus: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Rows that carry every one of the tags."""
    if not wanted:
        return corpus
    return corpus.where(is_true(reduce(lambda a, b: a & b, [F.array_contains("tags", tag_literal(*t)) for t in wanted])))


def open_issues(corpus: DataFrame, statuses: DataFrame) -> DataFrame:
    """Rows that carry no closed status; rows without any status stay."""
    closed = [tag_literal("issue-status", str(r["id"])) for r in statuses.where("is_closed").select("id").collect()]  # the tracker's statuses, a handful
    return corpus.where(without(F.arrays_overlap("tags", F.array(*closed)))) if closed else corpus


def hide_private(corpus: DataFrame) -> DataFrame:
    return corpus.where(without(F.col("is_private")))


def attachments(corpus: DataFrame, flag: str) -> DataFrame:
    """Flag "0" drops attachments; "1" and "only" keep everything."""
    return corpus.where(without(F.col("source_type") == "Attachment")) if flag == "0" else corpus


def visible_fields(corpus: DataFrame, hidden: DataFrame) -> DataFrame:
    return corpus.join(hidden.select("custom_field_id").distinct(), "custom_field_id", "left_anti").select(*corpus.columns)


def permitted(corpus: DataFrame, visible: DataFrame, permissions: DataFrame) -> DataFrame:
    """Without rows whose type, or whose container's type, the user may not view in the row's project."""
    pairs = [(search, kind) for search, kinds in SEARCH_TYPES.items() for kind in kinds]
    kinds = corpus.sparkSession.createDataFrame([(PERMISSIONS.get(s, s), k) for s, k in pairs], "search_type string, kind string")
    allowed = permissions.join(kinds, "search_type").select("project_id", "kind")
    every = visible.select("project_id").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for _, k in pairs])))
    denied = every.join(allowed, ["project_id", "kind"], "left_anti")
    for column in ("source_type", "container_type"):
        corpus = corpus.join(denied.withColumnRenamed("kind", column), ["project_id", column], "left_anti").select(*corpus.columns)
    return corpus


def unselected(types: list[str], one_project: bool = False) -> list[str]:
    """Source types that a choice of search types leaves out; none chosen means all."""
    if not types:
        return []
    return [k for s, kinds in SEARCH_TYPES.items() if s not in types and not (one_project and s == "projects") for k in kinds]


def select_types(corpus: DataFrame, types: list[str], one_project: bool = False) -> DataFrame:
    """Without rows whose type or container's type isn't among those chosen."""
    out = unselected(types, one_project)
    return corpus.where(without(F.col("source_type").isin(out)) & without(F.col("container_type").isin(out))) if out else corpus


def contains_any(issues: DataFrame, journals: DataFrame, keyword: str) -> DataFrame:
    """Issues with the keyword in their subject, their description or any note: one row each."""
    notes = journals.where((F.col("journalized_type") == "Issue") & F.lower("notes").contains(keyword.lower())).select(F.col("journalized_id").alias("id")).distinct()
    own = issues.where(is_true(F.lower("subject").contains(keyword.lower())) | is_true(F.lower("description").contains(keyword.lower()))).select("id")
    return issues.join(own.union(notes).distinct(), "id", "left_semi")


def visible(corpus: DataFrame, request: Request, dims: Dims) -> DataFrame:
    """All of the above but the choice of types."""
    df = hide_private(hide_project_rows(scope(corpus, request, dims), request))
    df = attachments(with_tags(df, request.tags), request.attachments)
    if request.open_issues and dims.statuses is not None:
        df = open_issues(df, dims.statuses)
    if dims.hidden_fields is not None:
        df = visible_fields(df, dims.hidden_fields)
    if dims.permissions is not None:
        df = permitted(df, corpus if dims.visible is None else dims.visible, dims.permissions)
    return df
