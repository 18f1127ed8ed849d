"""Queries of pages with totals, composites of one entity, frequencies over several corpora, and re-indexing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import affinity, bibliography, composites, graph, helpers, relational, validate, versions
from lodestar.plans.catalogue import _edges, register
from lodestar.sources.roles import Roles


@register("projects_page_total", "projects project_groups", """, f AS (SELECT project_id, title, budget, start_date FROM projects WHERE title ILIKE '%order 1%' AND project_id IN (SELECT project_id FROM project_groups WHERE group_code = 'EUR'))
  SELECT *, (SELECT count(*) FROM f) AS total, (SELECT string_agg(DISTINCT group_code, ',' ORDER BY group_code) FROM project_groups g WHERE g.project_id = p.project_id) AS group_codes FROM (SELECT * FROM f ORDER BY title, project_id LIMIT 25 OFFSET 5) p""")
def projects_page_total(r: Roles) -> DataFrame:
    return relational.projects_page(r.projects, r.project_groups, group="EUR", term="ORDER 1", limit=25, offset=5, total=True)


@register("references_page_total", "refs", "SELECT *, (SELECT count(*) FROM refs WHERE cited_by >= 2 AND display ILIKE '%e%' AND match_tier = 'title') AS total FROM refs WHERE cited_by >= 2 AND display ILIKE '%e%' AND match_tier = 'title' ORDER BY cited_by DESC, reference_id LIMIT 30 OFFSET 3")
def references_page_total(r: Roles) -> DataFrame:
    return relational.references_page(r.references, term="E", tier="title", limit=30, offset=3, total=True)


@register("pairs_page_total", "co_project", "SELECT *, (SELECT count(*) FROM co_project WHERE weight >= 2) AS total FROM co_project WHERE weight >= 2 ORDER BY weight DESC, person_a, person_b LIMIT 40 OFFSET 10")
def pairs_page_total(r: Roles) -> DataFrame:
    return graph.ranked_pairs(_edges(r), 2, limit=40, offset=10, total=True)


DETAIL = """, d AS (SELECT min(project_id) AS id FROM (SELECT project_id FROM projects JOIN partners USING (project_id) JOIN project_people USING (project_id) WHERE detail_fetched AND role = 'coordinator'))
  SELECT project_id, title, (SELECT string_agg(code || ':' || name, ',' ORDER BY code) FROM grps JOIN project_groups g ON group_code = code WHERE g.project_id = p.project_id) AS groups,
  (SELECT string_agg(role || ':' || slug, ',' ORDER BY CASE role WHEN 'coordinator' THEN 0 ELSE 1 END, name, slug) FROM project_people m JOIN people ON slug = person_slug WHERE m.project_id = p.project_id) AS people,
  (SELECT string_agg(partner_name || ':' || partner_type, ',' ORDER BY ordinal, partner_name, partner_type) FROM partners q WHERE q.project_id = p.project_id) AS partners, (SELECT count(*) FROM fields f WHERE f.project_id = p.project_id) AS n_fields FROM projects p JOIN d ON id = project_id"""


@register("project_detail", "projects project_groups grps project_people people partners fields", DETAIL)
def project_detail(r: Roles) -> DataFrame:
    led = r.project_people.where("role = 'coordinator'")
    first = r.projects.where("detail_fetched").join(r.partners, "project_id", "left_semi").join(led, "project_id", "left_semi").agg(F.min("project_id")).first()[0]
    p = composites.project_detail(first, r.projects, r.project_groups, r.groups, r.project_people, r.people, r.partners, r.fields)

    def told(array: str, *fields: str):
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", *[s[f].cast("string") for f in fields])), ",").alias(array)

    return p.select("project_id", "title", told("groups", "group_code", "name"), told("people", "role", "person_slug"), told("partners", "partner_name", "partner_type"), F.size("fields_raw").cast("long").alias("n_fields"))


@register("author_options", "thesis_people people", "SELECT coalesce(name, name_raw) AS display, count(DISTINCT handle) AS theses FROM thesis_people LEFT JOIN people ON slug = person_slug WHERE role = 'author' GROUP BY 1")
def author_options(r: Roles) -> DataFrame:
    return composites.author_options(composites.list_theses(r.theses, r.thesis_people, r.people))


BAGS = """WITH t AS (SELECT 'd' || doc_id AS bag, unnest(regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')) AS term FROM documents UNION ALL SELECT 'p' || p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) FROM part UNION ALL SELECT 'p' || p_partkey, unnest(regexp_extract_all(lower(p_brand), '[a-z0-9]+')) FROM part),
  f AS (SELECT DISTINCT bag, term FROM t WHERE length(term) >= 3 AND term NOT IN (""" + ", ".join(f"'{w}'" for w in affinity.STOP_WORDS) + """)), n AS (SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM part) AS n)
  SELECT term, count(*) AS df, round(ln((1.0 + max(n)) / (1 + count(*))) + 1, 9) AS idf FROM f, n GROUP BY 1"""


def _bags(r: Roles) -> tuple[DataFrame, DataFrame]:
    docs = affinity.bag_terms(r.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("bag"), "text"), "bag", F.col("text"))
    parts = affinity.bag_terms(r.table("part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("bag"), "p_name", "p_brand"), "bag", F.col("p_name"), F.col("p_brand"))
    return docs, parts


def _idf(r: Roles, frequencies: DataFrame) -> DataFrame:
    n = r.table("documents").count() + r.table("part").count()
    return frequencies.join(affinity.idf_of(frequencies, n), "term").select("term", "df", F.round("idf", 9).alias("idf"))


@register("idf_two_corpora", "", BAGS)
def idf_two_corpora(r: Roles) -> DataFrame:
    return _idf(r, helpers.written(affinity.document_frequencies(*_bags(r))))


@register("idf_incremental", "", BAGS)
def idf_incremental(r: Roles) -> DataFrame:
    """The documents first; then the parts are added, and no document is read again."""
    docs, parts = _bags(r)
    return _idf(r, helpers.written(affinity.added_frequencies(helpers.written(affinity.document_frequencies(docs)), parts)))


@register("reindexed_documents", "", """SELECT doc_id AS handle, sha256(t) AS sha, CAST(len(string_split(t, chr(10))) AS INTEGER) AS chunks, CAST(len(string_split(t, chr(10))) AS BIGINT) AS stored FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' || chr(10) || text ELSE text END AS t FROM documents)""")
def reindexed_documents(r: Roles) -> DataFrame:
    """Two thirds of the documents are indexed, then all, of which a fifth have changed meanwhile; what the store holds then."""
    docs = r.table("documents").select(F.col("doc_id").alias("handle"), "text")
    late = docs.withColumn("text", F.when(F.col("handle") % 5 == 0, F.concat(F.lit("new\n"), F.col("text"))).otherwise(F.col("text")))
    store = versions.Store(r.spark, helpers.shared_folder(r.spark))
    for rows in (docs.where("handle % 3 > 0"), late):
        versions.reindex(store, rows.withColumn("sha", F.sha2("text", 256)), lambda t: F.split(t, "\n"))
    chunks = store.read("chunks").groupBy("handle").agg(F.count("*").alias("stored"))
    return store.read("documents").join(chunks, "handle").select("handle", "sha", "chunks", "stored")


@register("entry_validation", "", """SELECT 'not-an-object' AS rule, CAST(doc_id AS VARCHAR) AS subject FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT 'unknown-key', doc_id || '~note' FROM documents WHERE doc_id % 11 > 0 AND doc_id % 7 = 0
  UNION ALL SELECT 'missing-key', doc_id || '~lang' FROM documents WHERE doc_id % 11 > 0 AND doc_id % 5 = 0 UNION ALL SELECT 'missing-key', doc_id || '~source' FROM documents WHERE doc_id % 11 > 0 AND doc_id % 3 = 0""")
def entry_validation(r: Roles) -> DataFrame:
    """Entries with a key too many, a null in place of a value, a key too few, or that are no objects."""
    k = F.col("doc_id")
    parts = [F.concat(F.lit('"handle": '), k.cast("string")), F.when(k % 5 > 0, F.concat(F.lit('"lang": "'), "lang", F.lit('"'))).otherwise('"lang": null'), F.when(k % 3 > 0, F.concat(F.lit('"source": "'), "source", F.lit('"'))), F.when(k % 7 == 0, '"note": {"a": [1, 2]}')]
    entry = F.when(k % 11 == 0, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")))
    return validate.entry_problems(r.table("documents").select(k.alias("name"), entry.alias("entry")), ["handle", "lang", "source"], ["handle", "lang", "source", "title"])


#: Every seventh document has another kind of list: five styles, paragraphs, and numbered entries without a heading at the end
#: of the text; the second kind has two lists, far apart. {d}: document, {i}: entry, {y}: year, {doi}: a DOI for even entries.
LISTS = (
    '{i}. Author, A. and Other, B., "Findings of document {d} number {i}", Journal of results, {y}. {doi}',
    '[{i}] Author, A. and Other, B., "Findings of document {d} number {i}", Journal of results, {y}. {doi}',
    '[Aut {d} et al.] Author, A. and Other, B., "Findings of document {d} number {i}", Journal of results, {y}. {doi}',
    "Author, A. and Other, B. ({y}). Findings of document {d} number {i}. Press of science, Town. {doi}",
    "Maria Author, Ana Other, and many friends of results. Findings of document {d} number {i}. Journal of results, {y}. {doi}",
    "the group of the town, with many friends of results. Findings of document {d} number {i}. Journal of results, {y}. {doi}",
)
_SQL_ENTRY = "CASE s " + " ".join(
    f"WHEN {k} THEN '" + x.replace("{d}", "' || doc_id || '").replace("{i}", "' || i || '").replace("{y}", "' || y || '").replace("{doi}", "' || doi || '") + "'" for k, x in enumerate(LISTS)
) + " END"
REFERENCE_STYLES = f"""WITH k AS (SELECT doc_id, doc_id % 7 AS k, CAST(2000 + doc_id % 20 AS VARCHAR) AS y FROM documents),
  l AS (SELECT *, CASE WHEN k = 6 THEN 0 ELSE k END AS s, 0 AS part FROM k UNION ALL SELECT *, 3, 1 FROM k WHERE k = 1),
  e AS (SELECT *, CASE WHEN i % 2 = 0 THEN 'doi:10.1234/D' || doc_id || '.' || i ELSE '' END AS doi FROM l, range(1, 25) AS t(i) WHERE i <= CASE WHEN k = 6 THEN 24 ELSE 16 END),
  x AS (SELECT *, rtrim({_SQL_ENTRY}) AS entry FROM e)
  SELECT CAST(doc_id AS VARCHAR) AS slug, CAST(i - 1 + 16 * part AS INT) AS ordinal, ['numbered', 'bracketed', 'labelled', 'authoryear', 'authorfull', 'blankline'][s + 1] AS style, entry, regexp_replace(entry, '^(\\[[^\\]]*\\]|[0-9]+\\.) ', '') AS display, 'Findings of document ' || doc_id || ' number ' || i AS title, y AS year,
  CASE WHEN s < 5 THEN 'Author' END AS first_author, CASE WHEN i % 2 = 0 THEN '10.1234/d' || doc_id || '.' || i END AS doi, CASE WHEN s < 5 THEN 'author' ELSE '' END || '|findingsofdocument' || doc_id || 'number' || i AS title_key FROM x"""


@register("reference_styles", "", REFERENCE_STYLES)
def reference_styles(r: Roles) -> DataFrame:
    """Lists of every style behind each document's text, with DOIs, two lists in one text, and lists without a heading."""
    d = F.col("doc_id")
    year = (2000 + d % 20).cast("string")

    def told(style: int, n: int, sep: str = "\n") -> Column:
        def entry(i: Column) -> Column:
            doi = F.when(i % 2 == 0, F.concat(F.lit("doi:10.1234/D"), d.cast("string"), F.lit("."), i.cast("string"))).otherwise("")
            values = {"d": d.cast("string"), "i": i.cast("string"), "y": year, "doi": doi}
            pieces = re.split(r"\{(\w+)\}", LISTS[style])
            return F.rtrim(F.concat(*[values[x] if at % 2 else F.lit(x) for at, x in enumerate(pieces) if x]))

        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), entry), sep)

    prose = F.lit("\n" + "Prose of a chapter\n" * 100)
    lists = F.concat(F.lit("\nReferences\n"), told(0, 16))
    for k in (2, 3, 4):
        lists = F.when(d % 7 == k, F.concat(F.lit("\n# Bibliografia\n"), told(k, 16))).otherwise(lists)
    lists = F.when(d % 7 == 5, F.concat(F.lit("\n12 Works cited:\n\n"), told(5, 16, "\n\n"))).otherwise(lists)
    lists = F.when(d % 7 == 1, F.concat(F.lit("\nREFERENCES\n"), told(1, 16), prose, F.lit("References\n"), told(3, 16))).otherwise(lists)
    lists = F.when(d % 7 == 6, F.concat(F.lit("\n" * 40), told(0, 24))).otherwise(lists)
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), lists)
    return bibliography.parse_references(r.table("documents").select(d.cast("string").alias("slug"), body.alias("text")))
