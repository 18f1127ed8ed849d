"""Queries of crawled directories. Customers are dealt to units of twenty, each a site of one of four shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.plans.catalogue import register
from lodestar.sources import directories
from lodestar.sources.roles import Roles

SITE = (r"^https?://[a-z0-9]+\.example/x/pessoas/[^/]+/?$",)

#: What a unit of each shape publishes. Tables of names need three rows; a row without a mail link is nobody.
PEOPLE = """WITH c AS (SELECT c_custkey AS k, c_custkey // 20 AS u, c_custkey // 20 % 4 AS s, c_custkey % 20 // 5 AS g, 'K' || translate(lpad(CAST(c_custkey AS VARCHAR), 9, '0'), '0123456789', 'abcdefghij') AS w, 'https://u' || (c_custkey // 20) || '.example/' AS h FROM customer),
  r AS (SELECT *, count(*) FILTER (k % 5 = 4) OVER (PARTITION BY u) AS retired FROM c),
  p AS (SELECT * FROM r WHERE u % 11 <> 6 AND NOT (s = 0 AND k % 5 = 4 AND retired < 3) AND NOT (s = 3 AND k % 10 = 8))"""


def _concat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _sites(r: Roles) -> tuple[DataFrame, DataFrame]:
    """units and pages."""
    k = F.col("c_custkey")
    u = F.expr("c_custkey div 20")
    c = r.table("customer").select(k.alias("k"), u.alias("u"), (u % 4).alias("s"), F.expr("c_custkey % 20 div 5").alias("g"), _concat("K", F.translate(F.lpad(k.cast("string"), 9, "0"), "0123456789", "abcdefghij")).alias("w"), _concat("https://u", u, ".example/").alias("h"))
    k, g, s, w, h = (F.col(x) for x in "kgswh")
    listed = _concat(h, "list")
    later = F.when(s == 1, _concat(listed, "?page=", g + 1)).otherwise(_concat(h, "q?offset=", 5 * g))
    own = F.when((g == 0) | s.isin(0, 3), listed).otherwise(later)
    # a second section that repeats some, a page past the end that repeats the last one
    again = F.when(s == 0, _concat(h, "more")).when((s == 1) & (g == 3), _concat(listed, "?page=5"))
    card = _concat('<div><a href="/x/pessoas/p', k, '"><img src=p></a><p><span class="text-lg font-bold">Doutora Ana ', w, "</span></p><p>", F.when(k % 3 == 0, "Professora Auxiliar").otherwise("sala"), '</p><a href="mailto:p', k, '@u.example">mail</a></div>')
    shown = F.when((s == 0) & (k % 5 < 4) & ((F.col("url") == listed) | (k % 10 < 2)), card)
    shown = shown.when(s == 1, _concat('<a href="/x/pessoas/p', k, '">AK</a><a href="/x/pessoas/p', k, '">Ana ', w, "</a>")).when(s == 2, _concat('<a class="person-name" href="/p/', k, '">', w, ", Ana</a>"))
    mail = F.when(k % 10 != 8, _concat('<a href="mailto:p', k, '@u.example">mail</a>')).otherwise("-")
    row = F.when((s == 0) & (k % 5 == 4) & (F.col("url") == listed), _concat("<tr><td>Ana ", w, "</td></tr>"))
    row = row.when(s == 3, _concat("<tr><td>Ana ", w, "</td><td>", F.when(k % 2 == 0, "Leitora").otherwise(_concat("p", k, "@u.example")), "</td><td>", mail, "</td></tr>"))

    def joined(x: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", x.alias("x")))), lambda y: y["x"]), "")

    more = F.when(F.min("s") == 2, _concat('<a class="jscroll-next" href="/q?offset=', 5 * (F.min("g") + 1), '">more</a>')).otherwise("")
    pages = c.withColumn("url", F.explode(F.array_compact(F.array(own, again)))).groupBy("url").agg(F.concat(F.lit("<html><body>"), joined(shown), F.lit("<table>"), joined(row), F.lit("</table>"), more).alias("html"))
    sections = F.when(F.col("u") % 11 == 6, F.array(_concat(h, "gone"))).when(s == 0, F.array(listed, _concat(h, "more"))).otherwise(F.array(listed))
    shape, paging = (F.get(F.array(*[F.lit(x) for x in names]), s.cast("int")) for names in (directories.SHAPES, ("none", "page", "follow_next", "none")))
    units = c.select("u", "s", "h").distinct().select(_concat("u", F.col("u")).alias("unit"), shape.alias("shape"), paging.alias("paging"), sections.alias("sections"), F.lit(40).alias("max_pages"), F.when(F.col("u") % 7 == 5, 1000).otherwise(0).alias("least"))
    return units, pages


@register("directory_crawl", "", PEOPLE + """ SELECT 'u' || u AS unit, h || 'list' AS section, CAST(CASE WHEN s IN (1, 2) THEN g ELSE 0 END AS INT) AS page, CASE WHEN s = 2 THEN w || ', Ana' WHEN s = 0 AND k % 5 < 4 THEN 'Doutora Ana ' || w ELSE 'Ana ' || w END AS name, 'Ana ' || w AS display,
  CASE WHEN s = 1 OR (s = 0 AND k % 5 < 4) THEN h || 'x/pessoas/p' || k WHEN s = 2 THEN h || 'p/' || k END AS person_url, CASE WHEN s = 0 AND k % 5 < 4 AND k % 3 = 0 THEN 'Professora Auxiliar' WHEN s = 3 AND k % 2 = 0 THEN 'Leitora' END AS role,
  CASE WHEN s = 3 OR (s = 0 AND k % 5 < 4) THEN 'p' || k || '@u.example' END AS email FROM p WHERE u % 7 <> 5""")
def directory_crawl(r: Roles) -> DataFrame:
    return directories.crawl(*_sites(r), SITE)[0].drop("ordinal", "key")


@register("directory_report", "", PEOPLE + """ , n AS (SELECT u, count(*) AS people FROM p GROUP BY 1), v AS (SELECT u, min(s) AS s, max(g) AS g FROM c GROUP BY 1)
  SELECT 'u' || v.u AS unit, CASE WHEN v.u % 11 = 6 THEN 0 WHEN s = 0 THEN 2 WHEN s = 1 AND g = 3 THEN 5 WHEN s < 3 THEN g + 1 ELSE 1 END AS pages, coalesce(people, 0) AS people, CASE WHEN v.u % 11 = 6 THEN 'missing' WHEN v.u % 7 = 5 THEN 'short' ELSE 'ok' END AS status FROM v LEFT JOIN n ON n.u = v.u""")
def directory_report(r: Roles) -> DataFrame:
    return directories.crawl(*_sites(r), SITE)[1]
