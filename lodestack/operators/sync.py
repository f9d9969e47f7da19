"""Keeping the corpus in step with its sources: differences, upserts, cascades, backfills."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodestack.functions.text import clean_text, extraction_state, join_parts, tag, truncate_bytes
from lodestack.operators.corpus import KEY, TAG

ARCHIVED = "archived"


def find_new(source: DataFrame, corpus: DataFrame, source_type: str, projects: DataFrame, only: list[int] | None = None) -> DataFrame:
    """Rows of source (id, project_id, ...) without a target, in projects that aren't archived."""
    live = projects.where(F.col("status") != ARCHIVED).select(F.col("id").alias("project_id"))
    known = corpus.where(F.col("source_type") == source_type).select(F.col("source_id").alias("id"))
    new = source.join(known, "id", "left_anti").join(live, "project_id", "left_semi")
    return new.where(F.col("project_id").isin(only)) if only is not None else new


def find_orphans(source: DataFrame, corpus: DataFrame, source_type: str, projects: DataFrame) -> DataFrame:
    """Keys of targets whose source is gone or whose project is archived."""
    own = corpus.where(F.col("source_type") == source_type)
    gone = own.join(source.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    shut = own.join(projects.where(F.col("status") == ARCHIVED).select(F.col("id").alias("project_id")), "project_id", "left_semi")
    return gone.select(*KEY).union(shut.select(*KEY)).distinct()


def find_outdated(source: DataFrame, corpus: DataFrame, source_type: str, updated: str = "updated_on") -> DataFrame:
    """Rows of source that changed after their target; none for sources without such a time."""
    if updated not in source.columns:
        return source.limit(0)
    own = corpus.where(F.col("source_type") == source_type).select(F.col("source_id").alias("id"), F.col("last_modified_at").alias("_seen"))
    return source.join(own, "id").where(F.col("_seen") < F.col(updated)).select(*source.columns)


def synchronize(corpus: DataFrame, sources: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]], projects: DataFrame, only: list[int] | None = None) -> DataFrame:
    """The corpus with new rows added, orphans dropped and outdated rows mapped again; doing it twice changes nothing.

    sources: for each source type its rows and the function that maps some of them to corpus rows. only narrows what is new.
    """
    archived = projects.where(F.col("status") == ARCHIVED).select(F.col("id").alias("project_id")).distinct()
    live = projects.where(F.col("status") != ARCHIVED).select(F.col("id").alias("project_id")).distinct()
    out = None
    for source_type, (source, mapper) in sources.items():  # all meet by id, so that each side is dealt once
        own = corpus.where(F.col("source_type") == source_type)
        seen = own.select(F.col("source_id").alias("id"), F.col("last_modified_at").alias("_seen"), F.lit(True).alias("_known"))
        outdated = F.coalesce(F.col("_seen") < F.col("updated_on"), F.lit(False)) if "updated_on" in source.columns else F.lit(False)
        new = F.col("_known").isNull() & (F.col("project_id").isin(only) if only is not None else F.lit(True))
        changed = source.join(seen, "id", "left").where(new | outdated).select(*source.columns)
        kept = own.join(source.select(F.col("id").alias("source_id")), "source_id", "left_semi")
        kept = kept.join(find_outdated(source, corpus, source_type).select(F.col("id").alias("source_id")), "source_id", "left_anti").join(archived, "project_id", "left_anti")
        part = kept.select(*corpus.columns).unionByName(mapper(changed.join(live, "project_id", "left_semi").select(*source.columns)))
        out = part if out is None else out.unionByName(part)
    rest = corpus.where(~F.col("source_type").isin(list(sources)))
    return rest if out is None else rest.unionByName(out)


def reload(corpus: DataFrame, sources: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]], projects: list[int] | None = None, types: list[str] | None = None) -> DataFrame:
    """The corpus with its rows mapped again from their sources, all or those of some projects and types."""
    for source_type, (source, mapper) in sources.items():
        if types is not None and source_type not in types:
            continue
        own = corpus.where(F.col("source_type") == source_type)
        own = own.where(F.col("project_id").isin(projects)) if projects is not None else own
        fresh = mapper(source.join(own.select(F.col("source_id").alias("id")), "id", "left_semi").select(*source.columns))
        corpus = corpus.join(fresh.select(*KEY), KEY, "left_anti").select(*corpus.columns).unionByName(fresh)
    return corpus


def latest_by_key(changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of each key the last in order: a maximum by key, combined before the shuffle."""
    rest = [c for c in changes.columns if c not in keys]
    best = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return best.select(*keys, "_last.*").select(*changes.columns)


def upsert(corpus: DataFrame, changes: DataFrame, order: str = "last_modified_at") -> DataFrame:
    """The corpus with each changed row in place of the one with its key; of several changes of a key the latest counts.

    Null times come before all others; of equal times the row with the largest hash counts, whatever the order of changes.
    """
    last = latest_by_key(changes.select(*dict.fromkeys([*corpus.columns, order])), KEY, [F.col(order), F.xxhash64(*corpus.columns)])
    return corpus.join(last.select(*KEY), KEY, "left_anti").select(*corpus.columns).unionByName(last.select(*corpus.columns))


def cascade_delete(corpus: DataFrame, deleted: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """The corpus without deleted entities (source_type, source_id), their custom values, and all values of deleted fields (custom_field_id)."""
    d = deleted.select(*KEY).distinct()
    df = corpus.join(d, KEY, "left_anti").select(*corpus.columns)
    inside = d.select(F.col("source_type").alias("container_type"), F.col("source_id").alias("container_id"), F.lit("CustomValue").alias("source_type"))
    df = df.join(inside, ["container_type", "container_id", "source_type"], "left_anti").select(*corpus.columns)
    return df if fields is None else df.join(fields.select("custom_field_id").distinct(), "custom_field_id", "left_anti").select(*corpus.columns)


def move_attachments(corpus: DataFrame, moved: DataFrame) -> DataFrame:
    """The corpus with attachments of moved wiki pages (page_id, project_id) in their new project."""
    m = moved.select(F.lit("Attachment").alias("source_type"), F.lit("WikiPage").alias("container_type"), F.col("page_id").alias("container_id"), F.col("project_id").alias("_new"))
    df = corpus.join(m, ["source_type", "container_type", "container_id"], "left")
    return df.withColumn("project_id", F.coalesce("_new", "project_id")).select(*corpus.columns)


def _labelled(corpus: DataFrame, labels: DataFrame, change: Callable[[Column, Column], Column]) -> DataFrame:
    sets = labels.groupBy("page_id").agg(F.sort_array(F.collect_set(tag("label", "label"))).alias("_labels"))
    sets = sets.select(F.lit("WikiPage").alias("source_type"), F.col("page_id").alias("source_id"), "_labels")
    old = F.coalesce("tags", F.array().cast(ArrayType(TAG)))
    df = corpus.join(sets, KEY, "left")
    return df.withColumn("tags", F.when(F.col("_labels").isNotNull(), change(old, F.col("_labels"))).otherwise(F.col("tags"))).select(*corpus.columns)


def add_label(corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """The corpus with labels (page_id, label) among the tags of their wiki pages."""
    return _labelled(corpus, labels, F.array_union)


def remove_label(corpus: DataFrame, labels: DataFrame) -> DataFrame:
    return _labelled(corpus, labels, F.array_except)


def build_tag_dim(corpus: DataFrame, statuses: DataFrame | None = None, trackers: DataFrame | None = None, users: DataFrame | None = None) -> DataFrame:
    """(type, name, value) of every tag in the corpus; value is the name looked up for statuses, trackers and users.

    A tag whose status, tracker or user no longer exists has no row.
    """
    found = corpus.select(F.explode("tags").alias("t")).select("t.type", "t.name").distinct()
    looked_up = ("issue-status", "tracker", "user")
    dims = [(kind, dim) for kind, dim in zip(looked_up, (statuses, trackers, users), strict=True) if dim is not None]
    if not dims:
        return found.where(~F.col("type").isin(*looked_up)).withColumn("value", F.col("name"))
    names = reduce(DataFrame.unionByName, [dim.select(F.lit(kind).alias("type"), F.col("id").cast("string").alias("name"), F.col("name").cast("string").alias("_value"), F.lit(True).alias("_there")) for kind, dim in dims])
    known = found.join(names, ["type", "name"], "left")  # one join, so that the corpus is read once
    value = F.when(F.col("type").isin(*looked_up), F.col("_value")).otherwise(F.col("name"))
    return known.where(~F.col("type").isin(*looked_up) | F.col("_there")).select("type", "name", value.alias("value"))


def backfill_registered_at(corpus: DataFrame, created: DataFrame) -> DataFrame:
    """The corpus with registered_at: the last change of types that never change, else created_on of created (source_type, source_id)."""
    fixed = ["Attachment", "Change", "Changeset", "CustomValue", "Document", "Journal", "News"]
    df = corpus.join(created.select(*KEY, F.col("created_on").alias("_created")), KEY, "left")
    at = F.when(F.col("source_type").isin(fixed), F.col("last_modified_at")).otherwise(F.coalesce("_created", "registered_at"))
    return df.withColumn("registered_at", at).select(*corpus.columns)


def backfill_change_titles(corpus: DataFrame, changes: DataFrame, changesets: DataFrame, repositories: DataFrame) -> DataFrame:
    """The corpus with "@revision" appended to titles of changes that are their bare path."""
    r = repositories.select(F.col("id").alias("repository_id"), F.col("type").alias("_kind"))
    s = changesets.select(F.col("id").alias("changeset_id"), "repository_id", "revision", "scmid").join(r, "repository_id")
    named = F.when(F.col("_kind").isin("Git", "Mercurial"), F.coalesce("scmid", "revision")).otherwise(F.col("revision"))
    c = changes.join(s, "changeset_id").select(F.lit("Change").alias("source_type"), F.col("id").alias("source_id"), F.col("path").alias("_path"), named.alias("_revision"))
    df = corpus.join(c, KEY, "left")
    title = F.when(F.col("title") == F.col("_path"), F.concat("title", F.lit("@"), "_revision")).otherwise(F.col("title"))
    return df.withColumn("title", title).select(*corpus.columns)


def bare_change_titles(corpus: DataFrame) -> DataFrame:
    """The inverse of backfill_change_titles."""
    return corpus.withColumn("title", F.when(F.col("source_type") == "Change", F.regexp_replace("title", "@[^@]*$", "")).otherwise(F.col("title")))


def attach_text(corpus: DataFrame, texts: DataFrame, max_bytes: int = 4 << 20) -> DataFrame:
    """The corpus with extracted texts (attachment_id, text, null where extraction failed) before attachments' descriptions."""
    t = texts.select(F.lit("Attachment").alias("source_type"), F.col("attachment_id").alias("source_id"), truncate_bytes(clean_text("text"), max_bytes).alias("_text"), F.lit(True).alias("_has"))
    df = corpus.join(t, KEY, "left")
    content = F.when(F.col("_has"), join_parts("content", "_text")).otherwise(F.col("content"))
    state = F.when(F.col("_has"), extraction_state("tags", "_text")).otherwise(F.col("tags"))
    return df.withColumns({"content": content, "tags": state}).select(*corpus.columns)
