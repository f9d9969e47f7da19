"""Exports and statistics: character counts, sentence corpora, issue histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.text import split_sentences

DOCUMENT_EXTENSIONS = ("doc", "docx", "pdf", "txt")


def char_counts(corpus: DataFrame) -> DataFrame:
    """(source_type, n_chars) by type, and in total where source_type is null. Rows without title or content count for nothing."""
    return corpus.rollup("source_type").agg(F.coalesce(F.sum(F.length("title") + F.length("content")), F.lit(0)).alias("n_chars"))


def sentence_corpus(corpus: DataFrame, projects: list[int] | None = None, types: list[str] | None = None, extensions: tuple[str, ...] | None = DOCUMENT_EXTENSIONS) -> DataFrame:
    """(id, source_type, sentences) of chosen rows; attachments and changes only with these extensions."""
    df = corpus.where(F.col("project_id").isin(projects)) if projects is not None else corpus
    df = df.where(F.col("source_type").isin(types)) if types is not None else df
    if extensions is not None:
        found = F.filter(F.coalesce("tags", F.array().cast("array<struct<type:string,name:string>>")), lambda t: (t["type"] == "extension") & t["name"].isin(*extensions))
        df = df.where(~F.col("source_type").isin("Attachment", "Change") | (F.size(found) > 0))
    split = split_sentences(df.select(F.col("source_id").alias("id"), "source_type", "content").where("content is not null"))
    return split.select("id", "source_type", "sentences").where("size(sentences) > 0")


#: The kind of thing that some attributes name; others name what they are called.
KINDS = {"author": "user", "assigned_to": "user", "user": "user", "fixed_version": "version"}
VALUE = "struct<type:string,id:string,name:string,is_closed:boolean,number:long,text:string>"


#: Names are broadcast up to so many rows.
BROADCAST_NAMES = 200_000


def names_of(df: DataFrame, **more: Column) -> DataFrame:
    """(id, name, is_closed, number) of a dim's rows of id, name and perhaps is_closed or number; what it lacks is null."""
    extra = [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in (("is_closed", "boolean"), ("number", "long"))]
    return df.select(*[c.alias(k) for k, c in more.items()], F.col("id").cast("string").alias("id"), F.col("name").cast("string").alias("name"), *extra)


def few(df: DataFrame) -> bool:
    return df.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if few(df) else df


def thing(kind: Column, id: Column, name: Column, closed: Column, number: Column) -> Column:
    """A struct of the thing that a column names; without a name where it is gone, null where nothing is named."""
    none = F.lit(None).cast("string")
    return F.when(id.isNotNull(), F.struct(kind.alias("type"), id.alias("id"), name.alias("name"), closed.alias("is_closed"), number.alias("number"), none.alias("text")))


def named_value(df: DataFrame, attribute: str, value: str | None, dim: DataFrame | None, out: str) -> DataFrame:
    """df with the thing that a column of ids names by one dim; nothing without a column. Rows meet by the ids' own type where both have one."""
    none = lambda t: F.lit(None).cast(t)
    kind, id = F.lit(KINDS.get(attribute, attribute)), F.col(value).cast("string") if value is not None else none("string")
    if dim is None or value is None:
        return df.withColumn(out, thing(kind, id, none("string"), none("boolean"), none("long")))
    same = df.schema[value].dataType == dim.schema["id"].dataType
    n = names_of(dim, _key=F.col("id") if same else F.col("id").cast("string")).select("_key", F.col("name").alias("_name"), F.col("is_closed").alias("_closed"), F.col("number").alias("_number"))
    found = df.join(n, (F.col(value) if same else id) == F.col("_key"), "left")
    return found.withColumn(out, thing(kind, id, F.col("_name"), F.col("_closed"), F.col("_number"))).drop("_key", "_name", "_closed", "_number")


def used_names(dims: dict[str, DataFrame], used: DataFrame) -> DataFrame | None:
    """One table (attribute, id, name, is_closed, number) of all dims; of those too large to be broadcast the rows in used (attribute, id)."""
    parts = []
    for attribute, df in dims.items():
        n = names_of(df, attribute=F.lit(attribute))
        parts.append(n if few(df) else n.join(used.where(F.col("attribute") == attribute).select("id"), "id", "left_semi").select(n.columns))
    return reduce(DataFrame.unionByName, parts) if parts else None


def changed_values(d: DataFrame, attribute: Column, names: DataFrame | None) -> DataFrame:
    """Details with the things that they change, old and new, by names (attribute, id, name, is_closed, number)."""
    for c, out in (("old_value", "old"), ("value", "new")):
        d = d.withColumn("_attribute", attribute)
        kind = F.coalesce(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("_attribute")], F.col("_attribute"))
        text = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("type", "string"), ("id", "string"), ("name", "string"), ("is_closed", "boolean"), ("number", "long"))], F.col(c).alias("text"))
        if names is None:
            d = d.withColumns({"_name": F.lit(None).cast("string"), "_closed": F.lit(None).cast("boolean"), "_number": F.lit(None).cast("long")})
        else:
            n = names.select(F.col("attribute").alias("_attribute"), F.col("id").alias(c), F.col("name").alias("_name"), F.col("is_closed").alias("_closed"), F.col("number").alias("_number"))
            d = d.join(n, ["_attribute", c], "left")
        found = thing(kind, F.col(c), F.col("_name"), F.col("_closed"), F.col("_number"))
        d = d.withColumn(out, F.when(F.col("_attribute").isNotNull(), found).when(F.col(c).isNotNull(), text)).drop("_attribute", "_name", "_closed", "_number")
    return d


def changed_fields(d: DataFrame, fields: DataFrame | None) -> DataFrame:
    """Details with the custom field that they change, by fields (property, prop_key, _field)."""
    if fields is None:
        return d.withColumn("custom_field", F.lit(None).cast("struct<id:string,name:string>"))
    field = F.when(F.col("property") == "cf", F.struct(F.col("prop_key").alias("id"), F.col("_field").alias("name")))
    return d.join(fields, ["property", "prop_key"], "left").withColumn("custom_field", field).drop("_field")


def issue_histories(
    issues: DataFrame, journals: DataFrame, details: DataFrame, dims: dict[str, DataFrame], time_entries: DataFrame, custom_fields: DataFrame | None = None
) -> DataFrame:
    """(project, issue): every issue as a nested record with its history, in the order of journals' and details' ids.

    details: id, journal_id, property, prop_key, old_value, value. dims: by attribute (status, assigned_to, category, fixed_version and
    any other), rows of id, name and perhaps is_closed or number. A change of an attribute x_id names what dims have of x, or the bare id
    where they lack it; one of a custom field carries the field; other changes keep their text. details that have issue_id, the issue of
    their journal, needn't be joined to it.
    """
    attribute = F.when((F.col("property") == "attr") & F.col("prop_key").rlike("._id$"), F.regexp_extract("prop_key", "^(.+)_id$", 1))
    j = journals.where("journalized_type = 'Issue'")
    d = details.select("id", "journal_id", "property", F.col("prop_key").cast("string").alias("prop_key"), *[F.col(c).cast("string").alias(c) for c in ("old_value", "value")], *[F.col("issue_id").alias("_issue") for c in details.columns if c == "issue_id"])
    used = d.select(attribute.alias("attribute"), F.explode(F.array("old_value", "value")).alias("id")).where("attribute is not null and id is not null").distinct()
    names = used_names(dims, used)
    if "issue_id" not in details.columns:
        d = d.join(j.select(F.col("id").alias("journal_id"), F.col("journalized_id").alias("_issue")).repartition("journal_id").distinct(), "journal_id")
    notes = j.select(F.col("id").alias("journal_id"), F.col("journalized_id").alias("_issue"), "user_id", "notes", "created_on", F.lit(True).alias("_note"))
    people = dims["user"] if "user" in dims else dims.get("author")
    if people is not None and not few(people):  # those who wrote notes may be few
        people = people.join(j.select(F.col("user_id").cast("string").alias("_user")).distinct(), F.col("id").cast("string") == F.col("_user"), "left_semi")
    fields = None if custom_fields is None else custom_fields.select(F.lit("cf").alias("property"), F.col("id").cast("string").alias("prop_key"), F.col("name").cast("string").alias("_field"))
    few_names, few_people, few_fields = (x is None or few(x) for x in (names, people, fields))
    if not few_names:  # what is too large to be broadcast shuffles details or notes alone, while they are narrow
        d = changed_values(d, attribute, names)
    if not few_fields:
        d = changed_fields(d, fields)
    if not few_people:
        notes = named_value(notes, "user", "user_id", people, "user").drop("user_id")
    d = notes.unionByName(d, allowMissingColumns=True).repartition("_issue")  # narrow rows meet by issue, once; names that are broadcast come afterwards
    if few_names:
        d = changed_values(d, attribute, None if names is None else F.broadcast(names))
    if few_people:
        d = named_value(d, "user", "user_id", None if people is None else F.broadcast(people), "user")
    if few_fields:
        d = changed_fields(d, None if fields is None else F.broadcast(fields))
    kind = F.when(F.col("property") == "attr", F.coalesce(attribute, "prop_key")).when(F.col("property") == "cf", "custom_field").otherwise(F.col("property"))
    change = F.struct(F.col("id").alias("id"), kind.alias("type"), "custom_field", "old", "new")
    without_id = lambda c: F.struct(*[c[n].alias(n) for n in ("type", "custom_field", "old", "new")])
    note = F.struct(F.col("created_on").alias("created_at"), "user", F.col("notes").alias("comment"))
    each = d.groupBy("_issue", "journal_id").agg(F.collect_list(F.when(F.col("_note"), note)).alias("notes"), F.transform(F.sort_array(F.collect_list(F.when(F.col("_note").isNull(), change))), without_id).alias("changes"))
    each = each.select("_issue", F.col("journal_id").alias("id"), F.explode("notes").alias("note"), "changes")
    entry = F.struct("id", "note.created_at", "note.user", "note.comment", "changes")
    history = each.groupBy("_issue").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: F.struct(*[e[n].alias(n) for n in ("created_at", "user", "comment", "changes")])).alias("history"))
    hours = time_entries.groupBy(F.col("issue_id").alias("_issue")).agg(F.sum("hours").alias("elapsed_hours"))
    out = issues.withColumnRenamed("id", "_issue")
    named = {"author": ("author", "author_id"), "assignee": ("assigned_to", "assigned_to_id"), "status": ("status", "status_id"), "tracker": ("tracker", "tracker_id"), "priority": ("priority", "priority_id")}
    for name, (attribute, key) in named.items():  # while issues are narrow
        out = named_value(out, attribute, key if key in issues.columns else None, broadcast_if_small(dims[attribute]) if attribute in dims and key in issues.columns else None, name)
    out = out.join(history, "_issue", "left").join(hours, "_issue", "left")
    scalar = lambda c, t: (F.col(c) if c in issues.columns else F.lit(None)).cast(t)
    record = F.struct(
        F.col("_issue").alias("id"), "subject", "description", *named, scalar("created_on", "timestamp").alias("created_at"), scalar("updated_on", "timestamp").alias("updated_at"),
        scalar("estimated_hours", "double").alias("estimated_hours"), F.coalesce(F.col("elapsed_hours").cast("double"), F.lit(0.0)).alias("elapsed_hours"), F.coalesce("history", F.array()).alias("history"),
    )
    return out.select(F.col("project_id").alias("project"), record.alias("issue"))
