"""Queries of a harvest run. Orders are the listing and their customers the projects, so most titles are met several times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import harvest
from lodestar.plans.catalogue import register
from lodestar.sources.roles import Roles

LISTING_URL = "https://site.example/projects"
_NOW = "2026-01-02T00:00:00"
#: The run once more as SQL: its rows, the last one of a title, the last one read.
_RUN = f""", run AS (SELECT o_orderkey AS seq, 'Project  ' || o_custkey AS title, 'project ' || o_custkey AS title_norm, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '{LISTING_URL}/' ELSE 'https://site.example/p/o-' || o_orderkey || '/' END AS url,
    CASE WHEN o_orderkey % 7 <= 1 THEN 'no_detail_url' WHEN o_orderkey % 7 = 2 THEN 'pending' WHEN o_orderstatus = 'P' THEN 'http_error' ELSE 'ok' END AS status, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders),
  h AS (SELECT * FROM run WHERE status != 'pending'), last AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY title_norm ORDER BY seq DESC) = 1), read AS (SELECT * FROM h WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY title_norm ORDER BY seq DESC) = 1)"""


def _page() -> Column:
    nothing = F.lit(None).cast("string")
    person = lambda x: F.struct(x.cast("string").alias("slug"), F.concat(F.lit("Person "), x.cast("string")).alias("name"))
    lead = F.when(F.col("lead").isNotNull(), person(F.col("lead")))
    words = F.array(F.col("o_orderpriority"), F.col("o_orderstatus"))
    return F.struct(
        F.lit("National").alias("scope"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("About "), "o_orderpriority")).alias("synopsis"), nothing.alias("funding_raw"), nothing.alias("partners_raw"),
        F.array_join(words, ", ").alias("keywords_raw"), F.concat(F.floor("o_totalprice").cast("string"), F.lit(" EUR")).alias("total_budget_raw"), F.lit("n/a").alias("own_budget_raw"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date_raw"), nothing.alias("end_date_raw"), lead.alias("coordinator"), F.transform("others", person).alias("researchers"), words.alias("keywords"),
    )


def _run(r: Roles) -> DataFrame:
    o = r.table("orders")
    k = F.col("o_orderkey") % 7
    url = F.when(k == 1, f"{LISTING_URL}/").when(k > 1, F.concat(F.lit("https://site.example/p/o-"), F.col("o_orderkey").cast("string"), F.lit("/")))
    listing = o.select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("Project  "), F.col("o_custkey").cast("string")).alias("title"), url.alias("url"), F.lit("listed").alias("details"), F.lit(None).cast("string").alias("scope"))
    first = F.col("l_linenumber") == 1
    team = r.table("lineitem").groupBy("l_orderkey").agg(F.min(F.when(first, F.col("l_suppkey"))).alias("lead"), F.array_sort(F.collect_set(F.when(~first, F.col("l_suppkey")))).alias("others"))
    asked = o.where("o_orderkey % 7 > 2").join(team, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    failed = F.col("o_orderstatus") == "P"
    fetched = asked.select(F.col("o_orderkey").alias("seq"), F.when(failed, 503).otherwise(200).alias("http_status"), F.when(failed, "status 503").alias("error"), F.when(~failed, _page()).alias("page"))
    return harvest.outcomes(listing, fetched, LISTING_URL)


def _stored(r: Roles) -> DataFrame:
    """Every second customer is a project already, and one of its columns is no harvest's."""
    c = r.table("customer").where("c_custkey % 2 = 0")
    text = ["title", "detail_url", "slug", "scope", "total_budget_raw", "total_budget_currency", "start_date", "detail_unavailable_reason", "last_scraped_at"]
    return c.select(
        F.concat(F.lit("project "), F.col("c_custkey").cast("string")).alias("title_norm"), *[F.lit(f"old {x}").alias(x) for x in text], F.lit("old synopsis").alias("synopsis"), F.lit(1.5).alias("total_budget_amount"),
        F.lit(True).alias("detail_fetched"), F.lit(200).alias("detail_http_status"), F.lit("2020-01-01T00:00:00").alias("first_seen_at"), F.col("c_name").alias("note"),
    )


@register("harvest_projects", "", _RUN + """, s AS (SELECT 'project ' || c_custkey AS title_norm, c_name AS note FROM customer WHERE c_custkey % 2 = 0)
  SELECT coalesce(s.title_norm, l.title_norm) AS title_norm, CASE WHEN l.seq IS NULL THEN 'old title' ELSE l.title END AS title, CASE WHEN l.seq IS NULL THEN 'old detail_url' WHEN l.status != 'no_detail_url' THEN l.url END AS detail_url, CASE WHEN l.seq IS NULL THEN 'old slug' WHEN l.status != 'no_detail_url' THEN 'o-' || l.seq END AS slug,
    CASE WHEN p.seq IS NOT NULL THEN 'National' WHEN s.title_norm IS NOT NULL THEN 'old scope' END AS scope, CASE WHEN p.seq IS NOT NULL THEN CAST(CAST(floor(p.o_totalprice) AS BIGINT) AS VARCHAR) || ' EUR' WHEN s.title_norm IS NOT NULL THEN 'old total_budget_raw' END AS total_budget_raw,
    CASE WHEN p.seq IS NOT NULL THEN 'EUR' WHEN s.title_norm IS NOT NULL THEN 'old total_budget_currency' END AS total_budget_currency, CASE WHEN p.seq IS NOT NULL THEN strftime(p.o_orderdate, '%Y-%m-%d') WHEN s.title_norm IS NOT NULL THEN 'old start_date' END AS start_date,
    CASE WHEN l.seq IS NULL THEN 'old detail_unavailable_reason' WHEN l.status = 'no_detail_url' THEN 'no detail url published by site' WHEN l.status = 'http_error' THEN 'fetch failed: status 503' END AS detail_unavailable_reason, CASE WHEN l.seq IS NULL THEN 'old last_scraped_at' ELSE '2026-01-02T00:00:00' END AS last_scraped_at,
    CASE WHEN p.seq IS NULL THEN CASE WHEN s.title_norm IS NOT NULL THEN 'old synopsis' END WHEN p.seq % 3 != 0 THEN 'About ' || p.o_orderpriority END AS synopsis, CASE WHEN p.seq IS NOT NULL THEN floor(p.o_totalprice) WHEN s.title_norm IS NOT NULL THEN CAST(1.5 AS DOUBLE) END AS total_budget_amount,
    CASE WHEN l.seq IS NULL THEN true ELSE l.status = 'ok' END AS detail_fetched, CASE WHEN l.seq IS NULL OR l.status = 'ok' THEN 200 WHEN l.status = 'http_error' THEN 503 END AS detail_http_status, CASE WHEN s.title_norm IS NULL THEN '2026-01-02T00:00:00' ELSE '2020-01-01T00:00:00' END AS first_seen_at, s.note
  FROM s FULL JOIN last l ON s.title_norm = l.title_norm LEFT JOIN read p ON p.title_norm = l.title_norm""")
def harvest_projects(r: Roles) -> DataFrame:
    return harvest.projects(_run(r), _stored(r), F.lit(_NOW))


@register("harvest_people", "", _RUN + """, t AS (SELECT title_norm, seq FROM read), lead AS (SELECT l_orderkey, min(l_suppkey) AS k FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), rest AS (SELECT DISTINCT l_orderkey, l_suppkey AS k FROM lineitem WHERE l_linenumber != 1)
  SELECT title_norm, CAST(k AS VARCHAR) AS slug, 'coordinator' AS role, 0 AS ordinal FROM t JOIN lead ON seq = l_orderkey
  UNION ALL SELECT title_norm, CAST(k AS VARCHAR), 'researcher', CAST(row_number() OVER (PARTITION BY seq ORDER BY k) - 1 AS INTEGER) FROM t JOIN rest ON seq = l_orderkey
  UNION ALL SELECT 'project ' || c_custkey, 'old', 'coordinator', 0 FROM customer WHERE 'project ' || c_custkey NOT IN (SELECT title_norm FROM t)""")
def harvest_people(r: Roles) -> DataFrame:
    c = r.table("customer").select(F.concat(F.lit("project "), F.col("c_custkey").cast("string")).alias("title_norm"), F.lit("old").alias("slug"), F.lit("coordinator").alias("role"), F.lit(0).alias("ordinal"))
    return harvest.children(_run(r), c, harvest.team(F.col("page")))


@register("harvest_keywords", "", _RUN + """ SELECT title_norm, unnest([o_orderpriority, o_orderstatus]) AS keyword, unnest([0, 1]) AS ordinal FROM read""")
def harvest_keywords(r: Roles) -> DataFrame:
    none = r.spark.createDataFrame([], "title_norm string, keyword string, ordinal int")
    return harvest.children(_run(r), none, harvest.numbered(F.col("page.keywords"), "keyword"))


@register("harvest_figures", "", _RUN + " SELECT count(*) AS listing_rows, count(*) FILTER (status = 'ok') AS detail_ok, count(*) FILTER (status = 'http_error') AS detail_failed, count(*) FILTER (status = 'no_detail_url') AS stubs, count(*) FILTER (status = 'pending') AS pending FROM run")
def harvest_figures(r: Roles) -> DataFrame:
    return harvest.run_figures(_run(r))


@register("harvest_targets", "", _RUN + " SELECT seq, title, url, status, CASE status WHEN 'ok' THEN 200 WHEN 'http_error' THEN 503 END AS http_status, CASE status WHEN 'http_error' THEN 'status 503' END AS error FROM run")
def harvest_targets(r: Roles) -> DataFrame:
    return harvest.targets(_run(r))
