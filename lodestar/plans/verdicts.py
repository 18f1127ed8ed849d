"""Queries of the maps that curated verdicts give, of how far names reach, and of single people and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import affinity, composites, relational, validate
from lodestar.plans.catalogue import CODES, ORACLE_SQL, person_group_shares, register
from lodestar.sources.roles import Roles


@register("verdict_rows", "", """, p AS (SELECT s_suppkey AS k, s_suppkey % 3 AS m FROM supplier)
  SELECT 'alias' AS map, CAST(k + 1 AS VARCHAR) AS key, CAST(k AS VARCHAR) AS value FROM p WHERE m = 0 UNION ALL SELECT 'alias', CAST(k AS VARCHAR), CAST(k + 1 AS VARCHAR) FROM p WHERE m = 1
  UNION ALL SELECT 'evidence', CAST(CASE m WHEN 0 THEN k + 1 ELSE k END AS VARCHAR), 'seen ' || k FROM p WHERE m < 2 UNION ALL SELECT 'reviewed', CAST(k AS VARCHAR), CAST(k + 1 AS VARCHAR) FROM p
  UNION ALL SELECT 'distinct', CAST(k AS VARCHAR), CAST(k + 1 AS VARCHAR) FROM p WHERE m = 2 UNION ALL SELECT 'full_name', CAST(s_suppkey AS VARCHAR), s_name || ' of Rio' FROM supplier
  UNION ALL SELECT DISTINCT 'exempt', CAST(o_custkey AS VARCHAR), CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'excluded', CAST(doc_id AS VARCHAR), NULL FROM documents WHERE doc_id % 50 = 0""")
def verdict_rows(r: Roles) -> DataFrame:
    k = F.col("slug")
    # every second pair is stored the other way round
    a, b = F.when(k % 2 == 0, k).otherwise(k + 1), F.when(k % 2 == 0, k + 1).otherwise(k)
    verdict = F.when(k % 3 == 2, "distinct").otherwise("same")
    pairs = r.people.select(a.alias("a"), b.alias("b"), verdict.alias("verdict"), F.when(k % 3 == 0, k).when(k % 3 == 1, k + 1).alias("canonical"), F.concat(F.lit("seen "), k.cast("string")).alias("evidence"))
    authors = r.table("orders").groupBy(F.col("o_custkey").alias("slug")).agg(F.collect_list("o_orderkey").alias("handles"))
    duplicates = r.theses.where("handle % 50 = 0").select(F.col("handle").alias("duplicate_handle"))
    return composites.verdict_rows(pairs, r.people.select("slug", F.concat("name", F.lit(" of Rio")).alias("full_name")), authors, duplicates)


@register("excluded_validation", "", "SELECT 'excluded-thesis' AS rule, CAST(doc_id AS VARCHAR) AS subject FROM documents WHERE doc_id % 40 = 0 AND doc_id % 3 != 0")
def excluded_validation(r: Roles) -> DataFrame:
    duplicates = r.theses.where("handle % 40 = 0").select(F.col("handle").alias("duplicate_handle"))
    return validate.excluded_problems(r.theses.where("handle % 3 != 0"), duplicates)


_CELLS = """names author total author_names, names author resolved author_names_resolved, names supervisor total supervisor_names, names supervisor resolved supervisor_names_resolved, edges all total edges, edges all resolved edges_resolved, edges all resolved_own edges_own,
edges all resolved_listed edges_uc, edges touching theses touching_theses, edges touching total touching_edges, edges touching resolved touching_resolved, theses all total theses_total, theses all with_supervisor theses_with_supervisor, theses all with_resolved theses_with_resolved,
theses all fully_resolved theses_fully_resolved, pairs supervisors total pairs, pairs supervisors resolved pairs_resolved, people supervisors total supervisor_people"""


@register("identity_coverage", "", f", c AS ({ORACLE_SQL['attribution_coverage']}), m AS ({ORACLE_SQL['match_tiers']}) SELECT 'tiers' AS section, role AS name, match_status AS measure, names AS value FROM m "
          + " ".join("UNION ALL SELECT '{}', '{}', '{}', {} FROM c".format(*x.split()) for x in _CELLS.split(",")))
def identity_coverage(r: Roles) -> DataFrame:
    return composites.identity_coverage(relational.match_tiers(r.thesis_people), relational.attribution_coverage(r.thesis_people, r.listings, r.theses))


@register("theses_of_group", "theses", f""", a AS ({ORACLE_SQL['attribution_tiers']})
  SELECT handle, title, year, full_text, tier, CASE WHEN people_code = content_code OR content_code IS NULL THEN people_code WHEN people_code IS NULL THEN content_code ELSE least(people_code, content_code) || ',' || greatest(people_code, content_code) END AS codes
  FROM theses JOIN a USING (handle) WHERE people_code = 'EUR' OR content_code = 'EUR'""")
def theses_of_group(r: Roles) -> DataFrame:
    people = affinity.people_signal(r.thesis_people, person_group_shares(r))
    code = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("handle") % 5 + 1).cast("int"))
    content = r.theses.where("handle % 3 != 0").select("handle", code.alias("group_code"), F.lit(1.0).alias("content_share"))
    found = composites.theses_of_group(r.theses, affinity.agreement(r.theses, people, content), group="EUR")
    return found.select("handle", "title", "year", "full_text", "tier", F.array_join("groups", ",").alias("codes"))


@register("person_project_keywords", "member aliases partners", "SELECT coalesce(to_slug, person_slug) AS person_slug, partner_name AS keyword, count(DISTINCT project_id) AS n FROM member JOIN partners USING (project_id) LEFT JOIN aliases ON from_slug = person_slug GROUP BY 1, 2")
def person_project_keywords(r: Roles) -> DataFrame:
    words = r.partners.select("project_id", F.col("partner_name").alias("keyword"))
    return relational.person_keywords(words, r.project_people, r.aliases)


@register("person_thesis_keywords", "thesis_people aliases", "SELECT coalesce(to_slug, person_slug) AS person_slug, lang AS keyword, count(DISTINCT handle) AS n FROM thesis_people JOIN documents ON doc_id = handle LEFT JOIN aliases ON from_slug = person_slug WHERE person_slug IS NOT NULL AND match_status IN ('exact', 'confident') GROUP BY 1, 2")
def person_thesis_keywords(r: Roles) -> DataFrame:
    words = r.table("documents").select(F.col("doc_id").alias("handle"), F.col("lang").alias("keyword"))
    return relational.person_keywords(words, r.thesis_people.where("match_status in ('exact', 'confident')"), r.aliases, key="handle")


@register("person_pages", "", """, f AS (SELECT CASE l_linenumber WHEN 1 THEN CAST(l_suppkey AS VARCHAR) WHEN 2 THEN 'https://site.example/p/' || l_suppkey || '/' ELSE 'https://site' || l_linenumber || '.example/p/' || l_suppkey END AS href FROM lineitem WHERE l_suppkey % 4 != 0)
  SELECT s_suppkey AS slug, (SELECT min(href) FROM f WHERE ends_with(href, '/' || s_suppkey)) AS page FROM supplier""")
def person_pages(r: Roles) -> DataFrame:
    n, k = F.col("l_linenumber"), F.col("l_suppkey").cast("string")
    href = F.when(n == 1, k).when(n == 2, F.concat(F.lit("https://site.example/p/"), k, F.lit("/"))).otherwise(F.concat(F.lit("https://site"), n.cast("string"), F.lit(".example/p/"), k))
    return relational.person_pages(r.people, r.table("lineitem").where("l_suppkey % 4 != 0").select(href.alias("href")))
