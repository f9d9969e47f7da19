"""The registered queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as x
from lodestack.operators import corpus as c
from lodestack.operators import exports, index, logs, search, similar, sync, synonyms, vectors, visibility
from lodestack.operators.search import All, Not, Some, word
from lodestack.operators.visibility import Dims, Request
from lodestack.sources import sinks
from lodestack.sources.folders import shared_dir
from lodestack.plans.sources import DETAILS, DOCUMENTS, ISSUES, JOURNALS, LOG, PROJECTS, TRACKER, action_log, details, documents, issues, journals, projects, statuses, t, tracker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def tag_strings(tags: str = "tags") -> Column:
    return F.transform(tags, lambda s: F.concat_ws(":", s["type"], s["name"]))


def count(tokens: str, w: str) -> str:
    return f"len(list_filter({tokens}, lambda x: x = '{w}'))"


def scored(*words: str) -> str:
    return " + ".join(f"{count('tt', w)} * 100 + least({count('ct', w)}, 5)" for w in words)


def has(w: str) -> str:
    return f"({count('tt', w)} + {count('ct', w)} > 0)"


def found(where: str, score: str, more: str = "") -> str:
    return f"WITH {DOCUMENTS} SELECT source_id, CAST({score} + 1 AS BIGINT) AS score FROM tok WHERE {where} {more}"


def hits(spark: SparkSession, sf: str, request: Request, expansions: DataFrame | None = None) -> DataFrame:
    return search.find(documents(spark, sf), request, Dims(), expansions).select("source_id", "score")


# Full-text search.


@query(found(f"{has('the')} AND {has('with')}", scored("the", "with")))
def fts_and(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf, Request(All((word("the"), word("with")))))


@query(found(f"{has('from')} OR ({has('that')} AND ({has('this')} OR {has('with')}))", scored("from", "that", "this", "with")))
def fts_or_nested(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf, Request(Some((word("from"), All((word("that"), Some((word("this"), word("with")))))))))


@query(found(f"{has('the')} AND NOT {has('from')}", scored("the")))
def fts_not(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf, Request(All((word("the"), Not(word("from"))))))


PHRASE = "len(list_filter(range(1, len({0})), lambda i: {0}[i] = 'of' AND {0}[i + 1] = 'the'))"


@query(found(f"{PHRASE.format('tt')} + {PHRASE.format('ct')} > 0", f"{PHRASE.format('tt')} * 100 + least({PHRASE.format('ct')}, 5)"))
def fts_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf, Request(search.parse("of-the")))


@query(found("len(list_filter(tt || ct, lambda x: starts_with(x, 'erth'))) > 0", "len(list_filter(tt, lambda x: starts_with(x, 'erth'))) * 100 + least(len(list_filter(ct, lambda x: starts_with(x, 'erth'))), 5)"))
def fts_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf, Request(word("erth", prefix=True)))


@query(found(f"{count('tt', 'the')} > 0 AND {count('tt', 'of')} > 0", f"{count('tt', 'the')} + {count('tt', 'of')}"))
def fts_titles_only(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf, Request("the of", titles_only=True))


EITHER = "len(list_filter({}, lambda x: x IN ('from', 'para')))"


@query(found(f"{EITHER.format('tt')} + {EITHER.format('ct')} > 0", f"{EITHER.format('tt')} * 100 + least({EITHER.format('ct')}, 5)"))
def fts_synonym(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.createDataFrame([("This", "from"), ("this", "para"), ("other", "word")], "source string, destination string")
    return hits(spark, sf, Request("this"), pairs)


@query(found(f"{has('the')}", scored("the"), "ORDER BY score DESC, source_id DESC LIMIT 10"))
def fts_score_topk(spark: SparkSession, sf: str) -> DataFrame:
    request = Request("the")
    return search.page(search.find(documents(spark, sf), request, Dims()), request).select("source_id", "score")


@query(found(f"{has('and')} AND {has('was')}", scored("and", "was") + " - 1"))
def fts_postings(spark: SparkSession, sf: str) -> DataFrame:
    shown = visibility.hide_private(documents(spark, sf))
    return search.match_postings(search.build_postings(shown), All((word("and"), word("was")))).select("source_id", "score")


@query(found(f"{PHRASE.format('tt')} + {PHRASE.format('ct')} > 0", f"{PHRASE.format('tt')} * 100 + least({PHRASE.format('ct')}, 5) - 1"))
def fts_postings_phrase(spark: SparkSession, sf: str) -> DataFrame:
    shown = visibility.hide_private(documents(spark, sf))
    return search.match_postings(search.build_postings(shown, terms=["of", "the"]), search.parse("of-the")).select("source_id", "score")


@query(found(f"NOT {has('and')} OR ({PHRASE.format('tt')} + {PHRASE.format('ct')} > 0)", f"{PHRASE.format('tt')} * 100 + least({PHRASE.format('ct')}, 5)"))
def fts_index(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase or the lack of a word, from an index that was written sorted by term."""
    shown, path = visibility.hide_private(documents(spark, sf)), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    search.write_postings(shown, path)
    tree = Some((Not(word("and")), word("of-the")))
    return search.find(shown, Request(tree), Dims(), postings=search.read_postings(spark, path)).select("source_id", "score")


@query(
    f"""WITH {DOCUMENTS}, now AS (SELECT source_id, tt, CASE WHEN source_id % 10 = 1 THEN ['zzz', 'the', 'with'] || ct ELSE ct END AS ct FROM tok WHERE source_id % 7 > 0)
SELECT source_id, CAST({scored("the", "with")} + 1 AS BIGINT) AS score FROM now WHERE {has("the")} AND {has("with")}"""
)
def fts_index_changes(spark: SparkSession, sf: str) -> DataFrame:
    """From an index of two thirds of the rows that took in the other rows, changed and removed ones afterwards."""
    shown, path = documents(spark, sf), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    index.write_index(shown.where("source_id % 3 > 0"), path)
    content = F.when(F.col("source_id") % 10 == 1, F.concat(F.lit("zzz the with "), "content")).otherwise(F.col("content"))
    index.change_index(path, shown.where("(source_id % 3 = 0 or source_id % 10 = 1) and source_id % 7 > 0").withColumn("content", content), shown.where("source_id % 7 = 0"))
    now = index.read_index(spark, path)
    return search.find(now.keys, Request("the with"), Dims(), postings=now.postings).select("source_id", "score")


@query(f"WITH {TRACKER} SELECT source_type, source_id, CAST(CASE WHEN source_type = 'Project' THEN 2 WHEN content LIKE 'P 3-%' THEN 102 ELSE 101 END AS BIGINT) AS score FROM corpus WHERE NOT coalesce(is_private, false) AND (source_type = 'Issue' OR list_contains(tags, 'identifier:p3'))")
def fts_identifier(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by a word (some hold the phrase p 3 besides), and one by its identifier alone."""
    return search.find(tracker(spark, sf), Request(Some((word("order"), word("p3")))), Dims()).select("source_type", "source_id", "score")


@query(
    f"""WITH {DOCUMENTS}, p AS (SELECT source_id, unnest(tt) AS term, 'title' AS field FROM tok UNION ALL SELECT source_id, unnest(ct), 'content' FROM tok)
SELECT term, field, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tf FROM (SELECT source_id, term, field, count(*) AS tf FROM p GROUP BY ALL) GROUP BY ALL"""
)
def postings(spark: SparkSession, sf: str) -> DataFrame:
    p = search.build_postings(visibility.hide_private(documents(spark, sf))).where("field IN ('title', 'content')")
    return p.groupBy("term", "field").agg(F.count("*").alias("postings"), F.sum("tf").alias("tf"))


@query(
    rf"""WITH {DOCUMENTS}, q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '\p{{L}}+|\p{{N}}+'))) AS term FROM benchmark),
n AS (SELECT query_id, count(*) AS words FROM q GROUP BY 1), p AS (SELECT source_id, unnest(tt) AS term, 1 AS title FROM tok UNION ALL SELECT source_id, unnest(ct), 0 FROM tok),
tf AS (SELECT source_id, term, sum(title) * 100 + least(sum(1 - title), 5) AS s FROM p WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
h AS (SELECT query_id, source_id, CAST(sum(s) AS BIGINT) AS score, count(*) AS found FROM tf JOIN q USING (term) GROUP BY 1, 2)
SELECT query_id, source_id, score, rank FROM (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank FROM h JOIN n USING (query_id) WHERE found = words) WHERE rank <= 10"""
)
def fts_many(spark: SparkSession, sf: str) -> DataFrame:
    queries = t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.search_many(visibility.hide_private(documents(spark, sf)), queries).select("query_id", "source_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {DOCUMENTS} SELECT source_id, CAST(2 AS BIGINT) AS score FROM tok WHERE lang = 'de'")
def browse(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf, Request(tags=[("label", "de")], types=["documents"]))


ESCAPED = """replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""
THE = r"(^|[^\p{L}\p{N}\x01\x02])([tT][hH][eE])($|[^\p{L}\p{N}\x01\x02])"  # twice, as neighbours share a separator


@query(
    f"""WITH {DOCUMENTS} SELECT source_id, replace(replace({ESCAPED.format(f"regexp_replace(regexp_replace(title, '{THE}', chr(92) || '1' || chr(1) || chr(92) || '2' || chr(2) || chr(92) || '3', 'g'), '{THE}', chr(92) || '1' || chr(1) || chr(92) || '2' || chr(2) || chr(92) || '3', 'g')")},
  chr(1), '<span class="keyword">'), chr(2), '</span>') AS title FROM tok"""
)
def highlight(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.hide_private(documents(spark, sf)).select("source_id", search.highlight("title", ["the"]).alias("title"))


@query()
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    request = Request("the of")
    found = search.search(documents(spark, sf), request, Dims(), keep=False).page
    return found.select("source_id", "score", "snippets", "highlighted")


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN '(from OR para) the' ELSE 'the (from OR para)' END AS expanded FROM benchmark")
def expand_preview(spark: SparkSession, sf: str) -> DataFrame:
    pairs = spark.createDataFrame([("this", "from"), ("this", "para")], "source string, destination string")
    asked = t(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "This the").otherwise("the This").alias("query"))
    shown = search.expand_preview(asked.select("query").distinct(), pairs)
    return asked.join(F.broadcast(shown), "query").select("item_id", "expanded")


@query(f"WITH {TRACKER} SELECT type, count(*) AS n FROM (SELECT source_type AS type FROM corpus WHERE NOT coalesce(is_private, false) UNION ALL SELECT container_type FROM corpus WHERE NOT coalesce(is_private, false)) WHERE type IS NOT NULL GROUP BY 1")
def type_drilldown(spark: SparkSession, sf: str) -> DataFrame:
    return search.type_drilldown(search.find(tracker(spark, sf), Request(open_issues=False, types=["issues"]), Dims()))


@query(
    f"""WITH {TRACKER}, n AS (SELECT split_part(tag, ':', 1) AS type, split_part(tag, ':', 2) AS name, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM corpus WHERE NOT coalesce(is_private, false)) GROUP BY 1, 2)
SELECT type, name, n FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, name) AS r FROM n) WHERE r <= 10"""
)
def tag_drilldown_top10(spark: SparkSession, sf: str) -> DataFrame:
    df = visibility.hide_private(tracker(spark, sf))
    dim = df.select(F.explode("tags").alias("t")).select("t.*").distinct().withColumn("value", F.col("name"))
    return search.tag_drilldown(df, dim).select("type", "name", "n")


@query(f"WITH {TRACKER} SELECT source_type, count(*) AS n FROM corpus WHERE NOT coalesce(is_private, false) AND project_id = 3 AND source_type <> 'Project' GROUP BY 1")
def hidden_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One project's rows without the project itself and without attachments (the documents play them)."""
    files = documents(spark, sf).withColumns({"source_type": F.lit("Attachment"), "project_id": F.lit(3).cast("long")})
    request = Request(scope="project", project_id=3, attachments="0")
    return visibility.visible(c.union(tracker(spark, sf), files), request, Dims()).groupBy("source_type").agg(F.count("*").alias("n"))


@query(f"WITH {TRACKER} SELECT type, count(*) AS n, CAST(0 AS BIGINT) AS shown FROM (SELECT source_type AS type FROM corpus WHERE NOT coalesce(is_private, false) UNION ALL SELECT container_type FROM corpus WHERE NOT coalesce(is_private, false)) WHERE type IS NOT NULL GROUP BY 1")
def no_condition(spark: SparkSession, sf: str) -> DataFrame:
    """A search without any condition shows nothing but counts its types."""
    found = search.search(tracker(spark, sf), Request(""), Dims(), keep=False)
    return found.types.crossJoin(F.broadcast(found.page.agg(F.count("*").alias("shown"))))


@query(f"WITH {TRACKER} SELECT count(*) FILTER (source_type IN ('Issue', 'Journal') AND coalesce(container_type, 'Issue') IN ('Issue', 'Journal')) AS n_hits, count(*) AS total_n_hits FROM corpus WHERE NOT coalesce(is_private, false)")
def hit_counts(spark: SparkSession, sf: str) -> DataFrame:
    return search.hit_counts(visibility.hide_private(tracker(spark, sf)), ["issues"])


# Visibility.


@query(f"WITH {TRACKER} SELECT source_type, source_id FROM corpus WHERE project_id IN (SELECT id FROM projects WHERE status = 'active') AND project_id IN (1, 2, 3, 7)")
def visibility_project(spark: SparkSession, sf: str) -> DataFrame:
    p = projects(spark, sf)
    dims = Dims(visible=p.where("status = 'active'").select(F.col("id").alias("project_id")), mine=p.where("id in (1, 2, 3, 7)").select(F.col("id").alias("project_id")))
    return visibility.scope(tracker(spark, sf), Request(scope="my_projects"), dims).select("source_type", "source_id")


@query(f"WITH {TRACKER}, tree AS (SELECT id FROM projects WHERE status = 'active' AND id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)) SELECT source_type, count(*) AS n FROM corpus WHERE project_id IN (SELECT id FROM tree) GROUP BY 1")
def visibility_subprojects(spark: SparkSession, sf: str) -> DataFrame:
    p = projects(spark, sf)
    regions = t(spark, sf, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("active").alias("status"))
    dims = Dims(projects=p.select("id", "parent_id", "status").union(regions), visible=p.where("status = 'active'").select(F.col("id").alias("project_id")))
    return visibility.scope(tracker(spark, sf), Request(scope="subprojects", project_id=1002), dims).groupBy("source_type").agg(F.count("*").alias("n"))


@query(f"WITH {TRACKER} SELECT source_type, source_id FROM corpus WHERE NOT coalesce(is_private, false)")
def visibility_private(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.hide_private(tracker(spark, sf)).select("source_type", "source_id")


@query(f"WITH {TRACKER} SELECT source_type, source_id FROM corpus WHERE NOT (project_id % 2 = 1 AND (source_type IN ('Issue', 'Journal') OR coalesce(container_type, '') IN ('Issue', 'Journal')))")
def visibility_permission(spark: SparkSession, sf: str) -> DataFrame:
    p = projects(spark, sf).select(F.col("id").alias("project_id"))
    every = p.withColumn("search_type", F.explode(F.array(*[F.lit(visibility.PERMISSIONS.get(s, s)) for s in visibility.SEARCH_TYPES])))
    permissions = every.where("not (project_id % 2 = 1 and search_type = 'issues')")
    return visibility.permitted(tracker(spark, sf), p, permissions).select("source_type", "source_id")


@query(f"WITH {TRACKER} SELECT source_type, source_id FROM corpus WHERE source_type NOT IN ('Issue', 'Journal', 'Project') AND coalesce(container_type, '') NOT IN ('Issue', 'Journal', 'Project')")
def type_selection(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.select_types(tracker(spark, sf), ["news"]).select("source_type", "source_id")


@query(f"WITH {TRACKER} SELECT source_type, source_id FROM corpus WHERE NOT list_contains(tags, 'issue-status:F')")
def open_issues(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.open_issues(tracker(spark, sf), statuses(spark, sf)).select("source_type", "source_id")


@query(f"WITH {TRACKER} SELECT source_type, source_id FROM corpus WHERE list_contains(tags, 'issue-status:O') AND list_contains(tags, 'tracker:1-URGENT')")
def tag_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    return visibility.with_tags(tracker(spark, sf), [("issue-status", "O"), ("tracker", "1-URGENT")]).select("source_type", "source_id")


@query(f"WITH {ISSUES}, {JOURNALS} SELECT id FROM issues WHERE description LIKE '%URGENT%' OR id IN (SELECT journalized_id FROM journals WHERE lower(notes) LIKE '%part 77 %')")
def any_field_contains(spark: SparkSession, sf: str) -> DataFrame:
    i, j = issues(spark, sf), journals(spark, sf)
    return visibility.contains_any(i, j, "urgent").select("id").union(visibility.contains_any(i, j, "PART 77 ").select("id")).distinct()


@query("SELECT p_partkey AS source_id FROM part WHERE p_size % 4 <> 2")
def hidden_fields(spark: SparkSession, sf: str) -> DataFrame:
    values = t(spark, sf, "part").select(F.col("p_partkey").alias("source_id"), F.when(F.col("p_size") % 4 != 0, (F.col("p_size") % 4).cast("long")).alias("custom_field_id"))
    return visibility.visible_fields(values, spark.createDataFrame([(2,)], "custom_field_id long")).select("source_id")


# Corpus.


@query(f"WITH {TRACKER} SELECT source_type, source_id, project_id, container_type, container_id, is_private, title, content, tags FROM corpus")
def corpus_union(spark: SparkSession, sf: str) -> DataFrame:
    df = tracker(spark, sf)
    return df.select("source_type", "source_id", "project_id", "container_type", "container_id", "is_private", "title", "content", tag_strings().alias("tags"))


@query(f"WITH {ISSUES} SELECT id AS source_id, project_id, is_private, subject AS title, description AS content, ['tracker:' || tracker_id, 'user:' || author_id, 'issue-status:' || status_id] AS tags, CAST(epoch(updated_on) AS BIGINT) AS modified FROM issues")
def map_issues(spark: SparkSession, sf: str) -> DataFrame:
    return c.map_issues(issues(spark, sf)).select("source_id", "project_id", "is_private", "title", "content", tag_strings().alias("tags"), F.unix_timestamp("last_modified_at").alias("modified"))


@query(f"WITH {ISSUES}, {JOURNALS} SELECT j.id AS source_id, i.project_id, i.id AS container_id, i.is_private OR private_notes AS is_private, notes AS content, ['user:' || user_id, 'tracker:' || tracker_id, 'issue-status:' || status_id] AS tags FROM journals j JOIN issues i ON i.id = journalized_id")
def map_journals(spark: SparkSession, sf: str) -> DataFrame:
    return c.map_journals(journals(spark, sf), issues(spark, sf)).select("source_id", "project_id", "container_id", "is_private", "content", tag_strings().alias("tags"))


@query("SELECT c_custkey AS source_id, CAST(n_regionkey AS BIGINT) AS project_id, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS content, CASE WHEN c_custkey % 2 = 0 THEN ['label:' || c_mktsegment] ELSE [] END AS tags FROM customer JOIN nation ON n_nationkey = c_nationkey")
def map_wiki_pages(spark: SparkSession, sf: str) -> DataFrame:
    k = t(spark, sf, "customer")
    pages = k.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("wiki_id"), F.col("c_name").alias("title"), F.lit("2024-01-01").cast("timestamp").alias("created_on"), F.lit("2024-01-01").cast("timestamp").alias("updated_on"))
    wikis = t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("project_id"))
    contents = k.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("page_id"), F.col("c_mktsegment").alias("text"))
    labels = k.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("page_id"), F.col("c_mktsegment").alias("label"))
    return c.map_wiki_pages(pages, wikis, contents, labels.union(labels)).select("source_id", "project_id", "title", "content", tag_strings().alias("tags"))


@query(
    f"""WITH {ISSUES}, {PROJECTS}, v AS (SELECT p_partkey AS id, p_size % 4 AS custom_field_id, ['Issue', 'Project', 'User'][CAST(p_partkey % 3 AS BIGINT) + 1] AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE p_size END AS on_id, p_name AS value FROM part)
SELECT v.id AS source_id, coalesce(i.project_id, p.id) AS project_id, kind AS container_type, on_id AS container_id, CAST(custom_field_id AS BIGINT) AS custom_field_id, i.is_private, value AS content
FROM v LEFT JOIN issues i ON kind = 'Issue' AND i.id = on_id LEFT JOIN projects p ON kind = 'Project' AND p.id = on_id WHERE custom_field_id > 0 AND (i.id IS NOT NULL OR p.id IS NOT NULL)"""
)
def map_custom_values(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "Issue").when(F.col("p_partkey") % 3 == 1, "Project").otherwise("User")
    values = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 4).cast("long").alias("custom_field_id"), kind.alias("customized_type"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")).otherwise(F.col("p_size")).alias("customized_id"), F.col("p_name").alias("value"))
    fields = spark.range(4).select("id", (F.col("id") > 0).alias("searchable"))
    return c.map_custom_values(values, fields, issues(spark, sf), projects(spark, sf)).select("source_id", "project_id", "container_type", "container_id", "custom_field_id", "is_private", "content")


@query("SELECT CAST(n_nationkey AS BIGINT) AS source_id, CAST(n_nationkey AS BIGINT) AS project_id, n_name AS title, ['identifier:p' || n_nationkey] AS tags FROM nation")
def map_projects(spark: SparkSession, sf: str) -> DataFrame:
    return c.map_projects(projects(spark, sf)).select("source_id", "project_id", "title", tag_strings().alias("tags"))


@query("SELECT s_suppkey AS source_id, s_name AS title, CASE s_suppkey % 4 WHEN 0 THEN s_name || chr(10) || 'about' WHEN 1 THEN 'about' WHEN 2 THEN s_name ELSE '' END AS content FROM supplier")
def map_news(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    news = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("project_id"), F.col("s_name").alias("title"), F.when(k.isin(0, 2), F.col("s_name")).when(k == 3, " ").alias("summary"), F.when(k < 2, "about").alias("description"), F.lit("2024-01-01").cast("timestamp").alias("created_on"))
    return c.map_news(news).select("source_id", "title", "content")


@query(f"WITH {DOCUMENTS} SELECT source_id, project_id, title, length(content) AS n FROM corpus")
def map_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.substring("source", 4, 10).alias("project_id"), F.regexp_extract("text", r"^[^\n]*", 0).alias("title"), F.col("text").alias("description"), F.lit("2024-01-01").cast("timestamp").alias("created_on"))
    return c.map_documents(rows).select("source_id", "project_id", "title", F.length("content").cast("long").alias("n"))


@query("SELECT conv_id * 1000 + turn AS source_id, conv_id % 40 + 100 AS project_id, role AS title, text AS content, CASE WHEN turn = 0 THEN 'message' ELSE 'reply' END AS type FROM conversations WHERE conv_id % 40 < 30")
def map_messages(spark: SparkSession, sf: str) -> DataFrame:
    m = t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") % 40).alias("board_id"), F.col("role").alias("subject"), F.col("text").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("created_on"), F.lit("2024-01-01").cast("timestamp").alias("updated_on"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("parent_id"))
    boards = spark.range(30).select("id", (F.col("id") + 100).alias("project_id"))
    rows = c.map_messages(m, boards).join(m.select(F.col("id").alias("source_id"), "parent_id"), "source_id")
    return rows.select("source_id", "project_id", "title", "content", c.event_type(rows).alias("type"))


@query(
    f"""WITH {ISSUES}, {PROJECTS}, a AS (SELECT doc_id AS id, ['Issue', 'Project', 'Nothing'][doc_id % 3 + 1] AS kind, CASE WHEN doc_id % 3 = 1 THEN doc_id % 40 ELSE doc_id END AS on_id, source || '.' || upper(lang) AS filename, doc_id FROM documents)
SELECT a.id AS source_id, coalesce(i.project_id, p.id) AS project_id, kind AS container_type, on_id AS container_id, i.is_private, filename AS title,
list_filter([CASE WHEN status_id IS NOT NULL THEN 'issue-status:' || status_id END, 'extension:' || lower(split_part(filename, '.', 2)), 'text-extraction:yet'], lambda x: x IS NOT NULL) AS tags
FROM a LEFT JOIN issues i ON kind = 'Issue' AND i.id = on_id LEFT JOIN projects p ON kind = 'Project' AND p.id = on_id WHERE i.id IS NOT NULL OR p.id IS NOT NULL"""
)
def map_attachments(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 3
    a = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(k == 0, "Issue").when(k == 1, "Project").otherwise("Nothing").alias("container_type"), F.when(k == 1, F.col("doc_id") % 40).otherwise(F.col("doc_id")).alias("container_id"), F.concat("source", F.lit("."), F.upper("lang")).alias("filename"), F.lit(None).cast("string").alias("description"), F.lit("2024-01-01").cast("timestamp").alias("created_on"))
    none = spark.createDataFrame([], "id long, board_id long, wiki_id long, project_id long")
    containers = c.container_projects(issues(spark, sf), none, none, projects(spark, sf), none, none, none)
    return c.map_attachments(a, containers).select("source_id", "project_id", "container_type", "container_id", "is_private", "title", tag_strings().alias("tags"))


def changesets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commits to the repository of their customer's nation."""
    i = issues(spark, sf)
    return i.select("id", F.col("project_id").alias("repository_id"), F.concat(F.lit("r"), "id").alias("revision"), F.concat(F.lit("abc"), "id").alias("scmid"), F.col("author_id").alias("user_id"), F.concat(F.lit(" "), "subject").alias("short_comments"), F.concat("description", F.lit("\n")).alias("long_comments"), F.col("created_on").alias("committed_on"))


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as changed files."""
    path = F.concat(F.lit("/d"), F.col("l_partkey") % 20, F.lit("/f"), F.col("l_partkey") % 7, F.when(F.col("l_partkey") % 5 == 0, "").otherwise(".TXT"))
    action = F.element_at(F.array(*map(F.lit, "AMRD")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    folder = F.when((action == "D") & (F.col("l_suppkey") % 3 == 0), F.concat(F.lit("/d"), F.col("l_partkey") % 20)).otherwise(path)
    moved = F.when((action == "R") & (F.col("l_suppkey") % 2 == 0), F.concat(F.lit("/d"), F.col("l_partkey") % 20))
    last = t(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    return last.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("changeset_id"), action.alias("action"), folder.alias("path"), moved.alias("from_path"), F.concat(F.lit("r"), F.col("l_orderkey") - 1).alias("from_revision"))


CHANGES = """changesets AS (SELECT o_orderkey AS id, CAST(c_nationkey AS BIGINT) AS repository_id, 'r' || o_orderkey AS revision FROM orders JOIN customer ON c_custkey = o_custkey),
lines AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
acts AS (SELECT *, ['A', 'M', 'R', 'D'][l_linenumber % 4 + 1] AS action, '/d' || p % 20 || '/f' || p % 7 || CASE WHEN p % 5 = 0 THEN '' ELSE '.TXT' END AS file FROM lines),
changes AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS changeset_id, action, CASE WHEN action = 'D' AND s % 3 = 0 THEN '/d' || p % 20 ELSE file END AS path, CASE WHEN action = 'R' AND s % 2 = 0 THEN '/d' || p % 20 END AS from_path, 'r' || (l_orderkey - 1) AS from_revision FROM acts)"""


@query("SELECT o_orderkey AS source_id, CAST(c_nationkey AS BIGINT) + 500 AS project_id, 'Order' AS title, left(o_orderstatus || ' ' || o_orderpriority, 5) AS content, ['user:' || o_custkey] AS tags FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey < 20")
def map_changesets(spark: SparkSession, sf: str) -> DataFrame:
    repositories = spark.range(20).select("id", (F.col("id") + 500).alias("project_id"))
    return c.map_changesets(changesets(spark, sf), repositories, limit=5).select("source_id", "project_id", "title", "content", tag_strings().alias("tags"))


@query(f"WITH {CHANGES} SELECT repository_id, path, id, action FROM (SELECT s.repository_id, c.path, c.id, c.action, row_number() OVER (PARTITION BY s.repository_id, c.path ORDER BY c.id DESC) AS r FROM changes c JOIN changesets s ON s.id = changeset_id) WHERE r = 1 AND action <> 'D'")
def latest_changes(spark: SparkSession, sf: str) -> DataFrame:
    return c.latest_changes(changes(spark, sf), changesets(spark, sf)).select("repository_id", "path", "id", "action")


@query(f"WITH {CHANGES} SELECT id AS source_id, repository_id AS container_id, path || '@' || revision AS title, CASE WHEN path LIKE '%.TXT' THEN ['extension:txt'] ELSE [] END AS tags FROM (SELECT c.*, s.repository_id, s.revision, row_number() OVER (PARTITION BY s.repository_id, c.path ORDER BY changeset_id DESC, c.id DESC) AS r FROM changes c JOIN changesets s ON s.id = changeset_id WHERE action <> 'D') WHERE r = 1")
def map_changes(spark: SparkSession, sf: str) -> DataFrame:
    repositories = spark.range(25).select("id", F.col("id").alias("project_id"))
    return c.map_changes(changes(spark, sf), changesets(spark, sf), repositories).select("source_id", "container_id", "title", tag_strings().alias("tags"))


@query(
    f"""WITH {CHANGES}, dated AS (SELECT c.*, s.repository_id FROM changes c JOIN changesets s ON s.id = changeset_id),
gone AS (SELECT repository_id, changeset_id, path FROM dated d WHERE action = 'D' AND NOT EXISTS (SELECT 1 FROM dated m WHERE m.action IN ('A', 'R') AND m.changeset_id = d.changeset_id AND m.from_path = d.path)),
last AS (SELECT repository_id, path, max(changeset_id) AS deleted FROM gone GROUP BY 1, 2)
SELECT id FROM dated t WHERE action <> 'D' AND NOT EXISTS (SELECT 1 FROM last l WHERE l.repository_id = t.repository_id AND t.changeset_id < deleted AND (l.path = t.path OR t.path LIKE l.path || '/%'))"""
)
def apply_deletions(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    changes(spark, sf).join(changesets(spark, sf).select(F.col("id").alias("changeset_id"), "repository_id"), "changeset_id").write.parquet(path)
    dated = spark.read.parquet(path)  # read four times
    return c.apply_deletions(dated.where("action <> 'D'"), dated).select("id")


@query(f"WITH {CHANGES}, dated AS (SELECT c.*, s.repository_id, s.revision FROM changes c JOIN changesets s ON s.id = changeset_id) SELECT id FROM dated t WHERE action <> 'D' AND NOT EXISTS (SELECT 1 FROM dated m WHERE m.action <> 'D' AND m.repository_id = t.repository_id AND m.from_path || '/f0.TXT' = t.path AND m.from_revision = t.revision)")
def rename_follow(spark: SparkSession, sf: str) -> DataFrame:
    dated = changes(spark, sf).join(changesets(spark, sf).select(F.col("id").alias("changeset_id"), "repository_id", "revision"), "changeset_id")
    return c.rename_follow(dated.where("action <> 'D'"), dated.withColumn("from_path", F.concat("from_path", F.lit("/f0.TXT")))).select("id")


@query(f"WITH {CHANGES}, dated AS (SELECT c.*, s.repository_id, s.revision FROM changes c JOIN changesets s ON s.id = changeset_id) SELECT id FROM dated WHERE changeset_id % 2 = 0 AND path LIKE '%.TXT'")
def sync_repository_listing(spark: SparkSession, sf: str) -> DataFrame:
    dated = changes(spark, sf).join(changesets(spark, sf).select(F.col("id").alias("changeset_id"), "repository_id", "revision"), "changeset_id")
    listing = dated.where("changeset_id % 2 = 0 and path like '%.TXT'")
    targets = dated.select(F.lit("Change").alias("source_type"), F.col("id").alias("source_id"), F.col("repository_id").alias("container_id"))
    keep, gone = c.sync_repository_listing(dated, listing, targets)
    return keep.select("id").join(gone.select(F.col("source_id").alias("id")), "id", "left_anti")


@query(
    f"""WITH {TRACKER}, st AS (SELECT DISTINCT o_orderstatus AS s FROM orders) SELECT c.source_type, c.source_id,
CASE c.source_type WHEN 'Issue' THEN CASE WHEN list_contains(tags, 'issue-status:F') THEN 'issue-closed' ELSE 'issue' END WHEN 'Journal' THEN CASE WHEN c.source_id % 3 = 0 THEN CASE WHEN list_contains(tags, 'issue-status:F') THEN 'issue-closed' ELSE 'issue-edit' END ELSE 'issue-note' END ELSE lower(c.source_type) END AS type,
CASE c.source_type WHEN 'Issue' THEN 'Bug #' || c.source_id || ' (New): ' || title WHEN 'Journal' THEN 'Bug #' || container_id || '#change-' || c.source_id || ' (New): Order ' || container_id WHEN 'Project' THEN 'Project: ' || title ELSE title END AS title,
CASE c.source_type WHEN 'Issue' THEN '/issues/' || c.source_id WHEN 'Journal' THEN '/issues/' || container_id || '?search_id=s1&search_n=' || (c.source_id % 7 + 10) || '#change-' || c.source_id WHEN 'Project' THEN '/projects/' || c.source_id ELSE '/news/' || c.source_id END || CASE WHEN c.source_type = 'Journal' THEN '' ELSE '?search_id=s1&search_n=' || (c.source_id % 7 + 10) END AS url FROM corpus c"""
)
def events_shown(spark: SparkSession, sf: str) -> DataFrame:
    df = tracker(spark, sf).withColumns({"is_closed": F.array_contains(tag_strings(), "issue-status:F"), "sets_status": F.col("source_id") % 3 == 0, "tracker": F.lit("Bug"), "status": F.lit("New"), "issue_subject": F.concat(F.lit("Order "), "container_id")})
    return df.select("source_type", "source_id", c.event_type(df).alias("type"), c.event_title(df).alias("title"), c.event_url(df, "s1", 10, F.col("source_id") % 7).alias("url"))


# Synchronisation.


def stale(spark: SparkSession, sf: str) -> DataFrame:
    """A corpus of issues that lags behind: every fifth is missing, every third is old, and some sources are gone."""
    rows = c.map_issues(issues(spark, sf)).where("source_id % 5 <> 0")
    old = F.when(F.col("source_id") % 3 == 0, F.col("last_modified_at") - F.expr("interval 1 day")).otherwise(F.col("last_modified_at"))
    gone = rows.where("source_id % 11 = 1").withColumn("source_id", F.col("source_id") + 10_000_000)
    return rows.withColumn("last_modified_at", old).unionByName(gone)


LIVE = "project_id IN (SELECT id FROM projects WHERE status <> 'archived')"


@query(f"WITH {ISSUES}, {PROJECTS} SELECT id FROM issues WHERE id % 5 = 0 AND {LIVE}")
def find_new(spark: SparkSession, sf: str) -> DataFrame:
    return sync.find_new(issues(spark, sf), stale(spark, sf), "Issue", projects(spark, sf)).select("id")


@query(f"WITH {ISSUES}, {PROJECTS}, k AS (SELECT id, project_id, true AS here FROM issues WHERE id % 5 <> 0 UNION ALL SELECT id + 10000000, project_id, false FROM issues WHERE id % 5 <> 0 AND id % 11 = 1) SELECT id AS source_id FROM k WHERE NOT here OR NOT {LIVE}")
def find_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return sync.find_orphans(issues(spark, sf), stale(spark, sf), "Issue", projects(spark, sf)).select("source_id")


@query(f"WITH {ISSUES} SELECT id FROM issues WHERE id % 5 <> 0 AND id % 3 = 0")
def find_outdated(spark: SparkSession, sf: str) -> DataFrame:
    return sync.find_outdated(issues(spark, sf), stale(spark, sf), "Issue").select("id")


@query(f"WITH {ISSUES}, {PROJECTS} SELECT id AS source_id, project_id, CAST(epoch(updated_on) AS BIGINT) AS modified FROM issues WHERE {LIVE}")
def synchronize(spark: SparkSession, sf: str) -> DataFrame:
    i = issues(spark, sf)
    return sync.synchronize(stale(spark, sf), {"Issue": (i, c.map_issues)}, projects(spark, sf)).select("source_id", "project_id", F.unix_timestamp("last_modified_at").alias("modified"))


@query(f"WITH {ISSUES} SELECT id AS source_id, CAST(epoch(updated_on) AS BIGINT) - CASE WHEN id % 3 = 0 AND project_id NOT IN (1, 2) THEN 86400 ELSE 0 END AS modified FROM issues WHERE id % 5 <> 0")
def reload(spark: SparkSession, sf: str) -> DataFrame:
    df = sync.reload(stale(spark, sf), {"Issue": (issues(spark, sf), c.map_issues)}, [1, 2], ["Issue"])
    return df.where("source_id < 10000000").select("source_id", F.unix_timestamp("last_modified_at").alias("modified"))


@query("SELECT l_orderkey AS source_id, max(l_shipdate)::DATE::VARCHAR AS shipped FROM lineitem GROUP BY 1")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    feed = t(spark, sf, "lineitem").select(F.lit("Issue").alias("source_type"), F.col("l_orderkey").alias("source_id"), F.col("l_shipdate").alias("last_modified_at"))
    old = feed.where("source_id % 2 = 0").groupBy("source_type", "source_id").agg(F.min("last_modified_at").alias("last_modified_at"))
    return sync.upsert(old, feed).select("source_id", F.col("last_modified_at").cast("date").cast("string").alias("shipped"))


@query("SELECT l_orderkey, l_linenumber, max(l_shipdate)::DATE::VARCHAR AS shipped FROM lineitem GROUP BY 1, 2")
def latest_by_key(spark: SparkSession, sf: str) -> DataFrame:
    feed = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    return sync.latest_by_key(feed, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate"), F.col("l_extendedprice")]).select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").cast("string").alias("shipped"))


@query("SELECT p_partkey AS source_id FROM part WHERE NOT (p_partkey % 2 = 0 AND p_size % 3 = 1) AND p_size % 4 <> 2")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    rows = c.row(p, "CustomValue", source_id="p_partkey", container_type=F.when(F.col("p_partkey") % 2 == 0, "Issue").otherwise("Project"), container_id="p_size", custom_field_id=F.col("p_size") % 4)
    gone = spark.range(60).where("id % 3 = 1").select(F.lit("Issue").alias("source_type"), F.col("id").alias("source_id"))
    return sync.cascade_delete(rows, gone, spark.createDataFrame([(2,)], "custom_field_id long")).select("source_id")


@query("SELECT p_partkey AS source_id, CAST(CASE WHEN p_size < 10 THEN 99 ELSE p_size END AS BIGINT) AS project_id FROM part")
def move_attachments(spark: SparkSession, sf: str) -> DataFrame:
    rows = c.row(t(spark, sf, "part"), "Attachment", source_id="p_partkey", container_type=F.lit("WikiPage"), container_id="p_size", project_id="p_size")
    return sync.move_attachments(rows, spark.range(10).select(F.col("id").alias("page_id"), F.lit(99).alias("project_id"))).select("source_id", "project_id")


@query("SELECT p_partkey AS source_id, CASE WHEN p_size % 3 = 0 THEN ['label:b'] WHEN p_size % 2 = 0 THEN ['label:a', 'label:b'] ELSE ['label:a'] END AS tags FROM part")
def labels_changed(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    rows = c.row(p, "WikiPage", source_id="p_partkey", tags=c.tags(c.tag("label", F.lit("a"))))
    more = p.where("p_size % 2 = 0 or p_size % 3 = 0").select(F.col("p_partkey").alias("page_id"), F.lit("b").alias("label"))
    less = p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("page_id"), F.lit("a").alias("label"))
    return sync.remove_label(sync.add_label(rows, more.union(more)), less).select("source_id", tag_strings().alias("tags"))


@query(f"WITH {TRACKER} SELECT DISTINCT split_part(tag, ':', 1) AS type, split_part(tag, ':', 2) AS name, CASE WHEN tag LIKE 'user:%' THEN c_name ELSE split_part(tag, ':', 2) END AS value FROM (SELECT unnest(tags) AS tag FROM corpus) LEFT JOIN customer ON tag = 'user:' || c_custkey WHERE tag NOT LIKE 'user:%' OR c_name IS NOT NULL")
def tag_dim(spark: SparkSession, sf: str) -> DataFrame:
    trackers = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("id"), F.col("o_orderpriority").alias("name")).distinct()
    users = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return sync.build_tag_dim(tracker(spark, sf), statuses(spark, sf), trackers, users)


@query("SELECT source_type, source_id, CASE WHEN source_type = 'Issue' THEN CAST(epoch(o_orderdate) AS BIGINT) ELSE 1704067200 END AS registered FROM (SELECT 'Issue' AS source_type, o_orderkey AS source_id, o_orderdate FROM orders UNION ALL SELECT 'News', s_suppkey, NULL FROM supplier)")
def backfill_registered_at(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracker(spark, sf).where("source_type in ('Issue', 'News')").withColumn("registered_at", F.lit(None).cast("timestamp"))
    created = issues(spark, sf).select(F.lit("Issue").alias("source_type"), F.col("id").alias("source_id"), "created_on")
    return sync.backfill_registered_at(rows, created).select("source_type", "source_id", F.unix_timestamp("registered_at").alias("registered"))


@query(f"WITH {CHANGES} SELECT c.id AS source_id, path || '@' || CASE WHEN repository_id % 2 = 0 THEN 'abc' || changeset_id ELSE 'r' || changeset_id END AS title, path AS bare FROM changes c JOIN changesets s ON s.id = changeset_id")
def backfill_change_titles(spark: SparkSession, sf: str) -> DataFrame:
    ch = changes(spark, sf)
    rows = c.row(ch, "Change", source_id="id", title="path")
    repositories = spark.range(25).select("id", F.when(F.col("id") % 2 == 0, "Git").otherwise("Subversion").alias("type"))
    full = sync.backfill_change_titles(rows, ch, changesets(spark, sf), repositories)
    bare = sync.bare_change_titles(full).select("source_id", F.col("title").alias("bare"))
    return full.select("source_id", "title").join(bare, "source_id")


@query("SELECT doc_id AS source_id, CASE WHEN doc_id % 3 = 0 THEN 'about' WHEN doc_id % 3 = 1 THEN 'about' || chr(10) || text ELSE 'about' END AS content, CASE WHEN doc_id % 3 = 0 THEN ['text-extraction:yet'] WHEN doc_id % 3 = 1 THEN [] ELSE ['text-extraction:error'] END AS tags FROM documents")
def attach_text(spark: SparkSession, sf: str) -> DataFrame:
    d = t(spark, sf, "documents")
    rows = c.row(d, "Attachment", source_id="doc_id", content=F.lit("about"), tags=c.tags(c.tag("text-extraction", F.lit("yet"))))
    texts = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("attachment_id"), F.when(F.col("doc_id") % 3 == 1, F.col("text")).alias("text"))
    return sync.attach_text(rows, texts).select("source_id", "content", tag_strings().alias("tags"))


# Synonyms.


def word_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = t(spark, sf, "part")
    words = F.split("p_name", " ")
    return p.select(F.upper(F.element_at(words, 1)).alias("source"), F.element_at(words, -1).alias("destination"), (F.col("p_size") / 50.0).alias("cosine"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("b").alias("engine"))


PAIRS = """pairs AS (SELECT lower(split_part(p_name, ' ', 1)) AS source, split_part(p_name, ' ', -1) AS destination, p_size / 50.0 AS cosine, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END AS engine FROM part),
kept AS (SELECT source, destination FROM pairs WHERE cosine >= 0.5 AND engine = 'a' AND length(source) > 1 AND length(destination) > 1)"""


@query(f"WITH {PAIRS} SELECT source, destination, count(*) AS n FROM kept GROUP BY 1, 2")
def similar_words(spark: SparkSession, sf: str) -> DataFrame:
    return synonyms.filter_similar_words(word_pairs(spark, sf), 0.5, "a").groupBy("source", "destination").agg(F.count("*").alias("n"))


@query(f"WITH {PAIRS}, b AS (SELECT source, destination FROM kept UNION SELECT destination, source FROM kept), a AS (SELECT * FROM b UNION SELECT source, source FROM b) SELECT source, destination FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM a) WHERE n > 1")
def synonym_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return synonyms.symmetric_expansions(synonyms.filter_similar_words(word_pairs(spark, sf), 0.5, "a"))


@query("SELECT DISTINCT split_part(p_name, ' ', 1) AS source, split_part(p_name, ' ', -1) AS destination, CASE WHEN split_part(p_name, ' ', 1) < 'm' THEN '2020-01-01' ELSE '2024-01-01' END AS created FROM part")
def sync_expansions(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    pairs = t(spark, sf, "part").select(F.element_at(words, 1).alias("source"), F.element_at(words, -1).alias("destination"))
    old = pairs.where("source < 'm'").distinct().union(spark.createDataFrame([("gone", "gone")], "source string, destination string")).withColumn("created_at", F.lit("2020-01-01").cast("timestamp")).withColumn("updated_at", F.col("created_at"))
    new, _ = synonyms.sync_expansions(old, pairs.union(spark.createDataFrame([("", "x"), ("x", None)], "source string, destination string")), F.lit("2024-01-01").cast("timestamp"))
    return new.select("source", "destination", F.col("created_at").cast("date").cast("string").alias("created"))


@query("SELECT source, destination FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS source, split_part(p_name, ' ', -1) AS destination FROM part) ORDER BY source DESC, destination LIMIT 7 OFFSET 3")
def list_expansions(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    pairs = t(spark, sf, "part").select(F.element_at(words, 1).alias("source"), F.element_at(words, -1).alias("destination")).distinct()
    return synonyms.list_expansions(pairs, descending=True, offset=3, limit=7)[0]


# Logs.


@query(f"WITH {LOG}, f AS (SELECT user_id, min(position) AS first FROM log WHERE is_search GROUP BY 1), k AS (SELECT log.* FROM log JOIN f USING (user_id) WHERE is_search OR position > first) SELECT user_id, count(*) FILTER (is_search) AS n_searches, count(*) FILTER (NOT is_search) AS n_visits, round(count(*) FILTER (NOT is_search) * 100.0 / count(*) FILTER (is_search), 6) AS visit_ratio, round(max(elapsed), 6) AS max, round(min(elapsed), 6) AS min, round(avg(elapsed), 6) AS mean FROM k GROUP BY 1")
def search_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = logs.search_stats(action_log(spark, sf))
    return s.select("user_id", "n_searches", "n_visits", *[F.round(k, 6).alias(k) for k in ("visit_ratio", "max", "min", "mean")])


@query(f"WITH {LOG} SELECT user_id, count(*) AS n_searches, count(*) FILTER (n_hits = 0) AS n_zero, round(count(*) FILTER (n_hits = 0) * 100.0 / count(*), 6) AS zero_ratio FROM log WHERE is_search GROUP BY 1")
def zero_hits(spark: SparkSession, sf: str) -> DataFrame:
    return logs.zero_hits(action_log(spark, sf)).withColumn("zero_ratio", F.round("zero_ratio", 6))


@query("SELECT CAST(event_id AS VARCHAR) AS search_id, value / 100 AS elapsed_time, CASE WHEN user_id % 3 = 0 THEN 'all' ELSE CAST(user_id AS VARCHAR) END AS project, props AS q FROM events WHERE event_type = 'view' AND value / 100 > 1")
def slow_searches(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events").where("event_type = 'view'")
    return logs.slow_searches(e.select(F.col("event_id").cast("string").alias("search_id"), (F.col("value") / 100).alias("elapsed_time"), F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("project_id"), F.col("props").alias("q")))


@query(
    f"""WITH {LOG}, b AS (SELECT *, sum(CAST(is_search AS INT)) OVER (PARTITION BY user_id ORDER BY position ROWS UNBOUNDED PRECEDING) AS block FROM log),
g AS (SELECT user_id, block, max(search_id) FILTER (is_search) AS search_id, max(timestamp) FILTER (is_search) AS searched_at, arg_max(search_n, position) FILTER (NOT is_search) AS search_n, arg_max(search_id, position) AS latest_id, arg_max(timestamp, position) AS latest_at FROM b WHERE block > 0 GROUP BY 1, 2),
l AS (SELECT *, lead(search_id) OVER w AS next_id, lead(searched_at) OVER w AS next_at, lead(block) OVER w IS NULL AS is_last FROM g WINDOW w AS (PARTITION BY user_id ORDER BY block))
SELECT user_id, CAST(block AS BIGINT) AS block, search_id, coalesce(search_n < 3 AND (is_last OR (next_id <> latest_id AND next_at + INTERVAL 30 SECOND > latest_at)), false) AS converted FROM l"""
)
def conversions(spark: SparkSession, sf: str) -> DataFrame:
    return logs.conversions(action_log(spark, sf))


def extraction_records(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "events")
    path = F.concat(F.lit("/f"), "event_id", F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("."), F.upper("event_type"))))
    return e.select(F.when(F.col("user_id") % 2 == 0, "text-extract").otherwise("repository-entry").alias("kind"), F.lit("Extracted").alias("label"), path.alias("path"), F.col("event_id").cast("string").alias("target"), (F.col("value") / 10).alias("elapsed"), (F.col("value") * 1e7).alias("memory"), (F.col("value") * 5e6).alias("memory_diff"))


@query("SELECT event_type AS extension, count(*) AS n, count(*) FILTER (value / 10 >= 5) AS n_slow, round(sum(value / 10), 4) AS total, max(value / 10) AS max, min(value / 10) AS min, round(avg(value / 10), 4) AS mean FROM events WHERE event_type <> 'error' GROUP BY 1")
def extraction_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = logs.extraction_stats(extraction_records(spark, sf))
    return s.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 4)})


@query("SELECT CAST(event_id AS VARCHAR) AS target, 'large memory diff' AS alert FROM events WHERE user_id % 2 = 0 AND value * 5e6 >= 536870912 UNION ALL SELECT CAST(event_id AS VARCHAR), 'large memory use' FROM events WHERE user_id % 2 = 0 AND value * 1e7 >= 1073741824 UNION ALL SELECT CAST(event_id AS VARCHAR), 'slow' FROM events WHERE value / 10 >= 5")
def resource_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return logs.resource_alerts(extraction_records(spark, sf)).select("target", "alert")


# Vectors and similar issues.


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 9) AS similarity FROM embeddings, q WHERE vec_id <> 7 AND label <> 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 50")
def semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = e.where("id = 7").first()["embedding"]
    return vectors.semantic_search(e.where("id <> 7"), q, 50, F.col("label") != 3).select("id", F.round("similarity", 9).alias("similarity"))


@query(
    f"""WITH {DOCUMENTS}, q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), seen AS (SELECT source_id FROM tok WHERE project_id < 15 AND lang IN ('en', 'de'))
SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 9) AS similarity FROM embeddings JOIN seen ON source_id = vec_id, q WHERE vec_id <> 7
ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 50"""
)
def semantic_visible(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest documents that a user may see, from vectors in cells: projects, private rows and a hidden field (Spanish and French texts have it) are joined."""
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    d, path = documents(spark, sf), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    corpus = d.withColumn("custom_field_id", F.when(F.element_at("tags", 1)["name"].isin("es", "fr"), 5).otherwise(F.lit(None)).cast("long"))
    dims = Dims(visible=d.select("project_id").distinct().where("project_id < 15"), hidden_fields=spark.createDataFrame([(5,)], "custom_field_id long"))
    seen = visibility.visible(corpus, Request(), dims).select(F.col("source_id").alias("id"))
    vectors.write_vectors(e.where("id <> 7"), path, 16)
    found = vectors.semantic_search(vectors.read_vectors(spark, path), e.where("id = 7").first()["embedding"], 50, seen)
    return found.select("id", F.round("similarity", 9).alias("similarity"))


@query("WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM p) WHERE r <= 10")
def semantic_many(spark: SparkSession, sf: str) -> DataFrame:
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = vectors.semantic_search_many(e, e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10)
    return found.select("query_id", "id", F.round("similarity", 9).alias("similarity"))


@query("WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id AND e.label <> 3 WHERE q.vec_id % 20 = 0) SELECT query_id, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM p) WHERE r <= 10")
def semantic_many_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest of the rows with another label than 3, from vectors in cells."""
    e, path = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label"), f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    vectors.write_vectors(e, path, 16)
    found = vectors.semantic_search_many(vectors.read_vectors(spark, path), e.where("id % 20 = 0").withColumnRenamed("id", "query_id"), 10, keep=F.col("label") != 3)
    return found.select("query_id", "id", F.round("similarity", 9).alias("similarity"))


@query("SELECT item_id, 'query: ' || text AS text FROM benchmark")
def embed_text_input(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "benchmark").select("item_id", vectors.embed_text_input("text", "query: ").alias("text"))


def conversation_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as issues: the first turn is the description, later ones are notes; each has an attachment by the name of its last role."""
    k = t(spark, sf, "conversations")
    first = k.where("turn = 0")
    i = first.select(F.col("conv_id").alias("id"), (F.col("conv_id") % 25).alias("project_id"), F.concat(F.lit("Talk "), "conv_id").alias("subject"), F.when(F.col("conv_id") % 4 > 0, F.col("text")).alias("description"), F.lit(1).alias("status_id"))
    j = k.where("turn > 0").select(F.col("turn").alias("id"), F.col("conv_id").alias("journalized_id"), F.lit("Issue").alias("journalized_type"), F.when(F.col("turn") == 2, " ").otherwise(F.col("text")).alias("notes"))
    a = first.where("conv_id % 3 = 0").select("conv_id", F.lit("Issue").alias("container_type"), F.col("conv_id").alias("id"), F.col("conv_id").alias("container_id"), F.concat("role", F.lit(".txt")).alias("filename"), F.when(F.col("conv_id") % 2 == 0, "about").alias("description")).drop("conv_id")
    return similar.build_issue_contents(i, j, a)


CONTENTS = r"""parts AS (SELECT conv_id AS id, 0 AS o, turn, 0 AS s, 'Talk ' || conv_id AS t FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, 1, 0, 0, CASE WHEN conv_id % 4 > 0 THEN text ELSE '' END FROM conversations WHERE turn = 0
UNION ALL SELECT conv_id, 2, turn, 0, text FROM conversations WHERE turn > 0 AND turn <> 2 UNION ALL SELECT conv_id, 3, 0, 0, role || '.txt' FROM conversations WHERE turn = 0 AND conv_id % 3 = 0 UNION ALL SELECT conv_id, 3, 0, 1, 'about' FROM conversations WHERE turn = 0 AND conv_id % 6 = 0),
contents AS (SELECT id, string_agg(t, chr(10) ORDER BY o, turn, s) AS content FROM parts GROUP BY 1)"""
WEIGHTS = rf"""{CONTENTS}, tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(content), '\p{{L}}+|\p{{N}}+')) AS term FROM contents) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM contents), w AS (SELECT * FROM (SELECT id, tf.term, floor(tf * ln(n / df) * 10000 + 0.5) AS w FROM tf JOIN df USING (term), n WHERE df < n) WHERE w > 0),
own AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, term) AS r FROM w)"""


@query(f"WITH {CONTENTS} SELECT id AS issue_id, content FROM contents")
def issue_contents(spark: SparkSession, sf: str) -> DataFrame:
    return conversation_contents(spark, sf).select("issue_id", "content")


@query(f"WITH {WEIGHTS} SELECT w.id AS issue_id, sum(w.w * own.w) / 1e8 AS score FROM w JOIN own ON own.term = w.term AND own.id = 3 AND own.r <= 30 WHERE w.id <> 3 GROUP BY 1 ORDER BY score DESC, issue_id LIMIT 5")
def similar_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Of one issue, from stored weights."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    similar.write_weights(conversation_contents(spark, sf), path)
    return similar.similar_issues(similar.read_weights(spark, path), 3)


@query(f"WITH {WEIGHTS}, p AS (SELECT own.id AS issue_id, w.id AS other_id, sum(w.w * own.w) / 1e8 AS score FROM w JOIN own ON own.term = w.term AND own.r <= 30 AND own.id <> w.id GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, other_id) AS rank FROM p) WHERE rank <= 5")
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return similar.similar_pairs(conversation_contents(spark, sf)).withColumn("rank", F.col("rank").cast("long"))


# Text and exports.


@query(f"WITH {TRACKER}, k AS (SELECT source_type, length(title) + length(content) AS n FROM corpus) SELECT source_type, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_chars FROM k GROUP BY ROLLUP (source_type)")
def char_counts(spark: SparkSession, sf: str) -> DataFrame:
    return exports.char_counts(tracker(spark, sf))


def histories(spark: SparkSession, sf: str) -> DataFrame:
    """Every order's history: its lines as notes, with changes of every kind."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    journals(spark, sf).write.option("compression", "zstd").parquet(path)  # read for notes, changes and hours
    j = spark.read.parquet(path)
    users = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    places = t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    versions = t(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    hours = j.where("id % 10 < 3").select(F.col("journalized_id").alias("issue_id"), F.lit(0.5).alias("hours"))
    fields = spark.createDataFrame([(1, "area")], "id long, name string")
    return exports.issue_histories(issues(spark, sf), j, details(j), {"author": users, "status": statuses(spark, sf), "category": places, "fixed_version": versions}, hours, fields)


def said(value: str) -> Column:
    """A change's value as text: id, name and whether it is closed, or its plain text."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.when(v["id"].isNotNull(), F.concat_ws("/", v["id"], F.coalesce(v["name"], F.lit("")), v["is_closed"].cast("string"))), v["text"], F.lit(""))


def told(issue: Column) -> Column:
    """A history as text: for each note its user, comment and changes."""
    field = lambda c: F.coalesce(F.concat_ws("/", c["custom_field"]["id"], c["custom_field"]["name"]), F.lit(""))
    change = lambda c: F.concat(c["type"], F.lit(":"), field(c), F.lit(":"), said(c["old"]), F.lit(">"), said(c["new"]))
    note = lambda e: F.concat_ws("|", F.concat_ws("/", e["user"]["id"], F.coalesce(e["user"]["name"], F.lit(""))), e["comment"], F.date_format(e["created_at"], "yyyy-MM-dd"), F.array_join(F.transform(e["changes"], change), ";"))
    return F.array_join(F.transform(issue["history"], note), "\n")


HISTORIES = f"""WITH {ISSUES}, {JOURNALS}, {DETAILS}, notes AS (SELECT journalized_id AS id, string_agg(user_id || '/' || coalesce(c_name, '') || '|' || notes || '|' || strftime(j.updated_on, '%Y-%m-%d') || '|' || said, chr(10) ORDER BY j.id) AS history,
sum(CASE WHEN j.id % 10 < 3 THEN 0.5 ELSE 0 END)::DOUBLE AS hours FROM journals j JOIN changes USING (id) LEFT JOIN customer ON c_custkey = user_id GROUP BY 1)
SELECT i.id, project_id, subject, description, author_id || '/' || c_name AS author, status_id || '/' || status_id || '/' || (status_id = 'F')::VARCHAR AS status, strftime(updated_on, '%Y-%m-%d') AS updated, coalesce(hours, 0) AS elapsed_hours, coalesce(history, '') AS history
FROM issues i LEFT JOIN notes USING (id) JOIN customer ON c_custkey = author_id"""


def flat_history(df: DataFrame) -> DataFrame:
    i = F.col("issue")
    author = F.concat_ws("/", i["author"]["id"], i["author"]["name"])
    return df.select(i["id"].alias("id"), F.col("project").cast("long").alias("project_id"), i["subject"].alias("subject"), i["description"].alias("description"), author.alias("author"), said(i["status"]).alias("status"), F.date_format(i["updated_at"], "yyyy-MM-dd").alias("updated"), i["elapsed_hours"].alias("elapsed_hours"), told(i).alias("history"))


@query(HISTORIES)
def issue_histories(spark: SparkSession, sf: str) -> DataFrame:
    return flat_history(histories(spark, sf))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'gz' WHEN 2 THEN lower(split_part(p_type, ' ', 1)) ELSE NULL END AS extension FROM part")
def path_extension(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, F.concat(F.lit("dir/."), "p_brand")).when(k == 1, F.concat(F.lit("a/"), "p_partkey", F.lit(".tar.gz"))).when(k == 2, F.concat(F.lit("/x.y/f."), F.split("p_type", " ")[0])).otherwise(F.concat(F.lit("a.b/"), "p_partkey"))
    return t(spark, sf, "part").select("p_partkey", x.path_extension(path).alias("extension"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 > 1 THEN p_type WHEN p_partkey % 3 = 0 THEN 'application/gzip' WHEN p_partkey % 3 = 1 THEN 'application/x-bzip2' ELSE 'application/x-tar' END AS type FROM part")
def content_type(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat("p_name", F.when(k % 3 == 0, ".tar.gz").when(k % 3 == 1, ".tar.bz2").otherwise(".tar"))
    return t(spark, sf, "part").select("p_partkey", x.resolve_content_type(F.when(k % 4 > 1, F.col("p_type")).otherwise("application/x-tar"), name).alias("type"))


@query("SELECT p_partkey, p_size * CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1e3 WHEN 2 THEN 1024.0 WHEN 3 THEN 1e6 WHEN 4 THEN 1048576.0 ELSE 1e9 END AS bytes, p_size * CASE p_partkey % 4 WHEN 0 THEN 0.001::DOUBLE WHEN 1 THEN 1 WHEN 2 THEN 60 ELSE 3600 END AS seconds FROM part")
def parse_size(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("B", "KB", "KiB", "MB", "MiB", "GB"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    time = F.element_at(F.array(*map(F.lit, ("ms", "s", "m", "h"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t(spark, sf, "part").select("p_partkey", x.parse_size(F.concat("p_size", unit)).alias("bytes"), x.parse_elapsed(F.concat("p_size", time)).alias("seconds"))


@query(r"SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+|\p{N}+') AS tokens FROM documents")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", x.tokenize("text", normalized=False).alias("tokens"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(CASE WHEN length(text) > 255 THEN left(text, 252) || '...' ELSE text END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS short FROM documents")
def truncate_words(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", x.truncate_words("text").alias("short"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text ELSE list_reduce(list_transform(range(0, 1001), lambda i: CASE WHEN strlen(left(text, i)) <= 1000 THEN left(text, i) ELSE '' END), lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) END AS cut FROM documents")
def truncate_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", x.truncate_bytes("text", 1000).alias("cut"))


UNTAGGED = r"regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?s)<[/!a-zA-Z][^>]*>', '', 'g')"


@query(rf"SELECT page_id, trim(html_unescape, chr(32) || chr(9) || chr(10) || chr(13)) AS text FROM (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace({UNTAGGED}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS html_unescape FROM pages)")
def markup_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return x.markup_to_text(t(spark, sf, "pages").select("page_id", "html")).select("page_id", "text")


@query("SELECT doc_id, lower(nfc_normalize(text)) AS text FROM documents")
def nfkc(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", x.nfkc_lower("text").alias("text"))


WHITE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"


@query(
    rf"""WITH {DOCUMENTS}, line AS (SELECT source_id, unnest(string_split(replace(content, '.', '。'), chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM corpus),
bare AS (SELECT *, trim(line, {WHITE}) AS bare, length(line) - length(ltrim(line, {WHITE})) AS indent FROM line),
cut AS (SELECT *, bare <> '' AND (coalesce(lag(bare) OVER w, '') = '' OR left(line, indent) <> coalesce(lag(left(line, indent)) OVER w, '') OR regexp_matches(bare, '^\p{{Ps}}?\p{{N}}')) AS starts FROM bare WINDOW w AS (PARTITION BY source_id ORDER BY n)),
paragraph AS (SELECT source_id, k, string_agg(bare, chr(10) ORDER BY n) AS text FROM (SELECT *, sum(starts::INT) OVER (PARTITION BY source_id ORDER BY n) AS k FROM cut) WHERE bare <> '' GROUP BY 1, 2),
sentence AS (SELECT source_id, k, list_filter(list_transform(regexp_extract_all(text, '(?s)[^。]*。'), lambda s: trim(replace(s, chr(10), ' '), {WHITE})), lambda s: strlen(s) <= 2048) AS s FROM paragraph)
SELECT source_id AS id, 'Document' AS source_type, flatten(list(s ORDER BY k)) AS sentences FROM sentence GROUP BY 1 HAVING len(flatten(list(s ORDER BY k))) > 0"""
)
def sentence_corpus(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).withColumn("content", F.replace("content", F.lit("."), F.lit("。")))
    return exports.sentence_corpus(d)


@query(
    """WITH RECURSIVE r AS MATERIALIZED (SELECT doc_id, strlen(text) + 1 AS b, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE text <> ''),
f AS (SELECT i, doc_id, b AS fill, 0 AS bucket, true AS first FROM r WHERE i = 1 UNION ALL
SELECT r.i, r.doc_id, CASE WHEN fill + b > 100000 THEN b ELSE fill + b END, CASE WHEN fill + b > 100000 THEN bucket + 1 ELSE bucket END, fill + b > 100000 FROM f JOIN r ON r.i = f.i + 1)
SELECT doc_id AS id, CAST(bucket AS BIGINT) AS bucket, first FROM f"""
)
def sentence_buckets(spark: SparkSession, sf: str) -> DataFrame:
    records = t(spark, sf, "documents").where("text <> ''").select(F.col("doc_id").alias("id"), F.array("text").alias("sentences"))
    return sinks.sentence_buckets(records, 100_000).select("id", "bucket", "first")
