"""Relational reports over the role views. Each function takes role DataFrames and returns one DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.helpers import canonical_people, canonicalize, contains_term, page, paged, top_n_with_other

UNGROUPED, NO_FUNDING = "UNGROUPED", "(no funding listed)"
#: Spellings that all name the funder FCT.
FCT_SPELLINGS = [
    "FCT - Fundação para a Ciência e Tecnologia", "Fundação para a Ciência e Tecnologia", "Fundação para a Ciência e a Tecnologia", "Portuguese Science Foundation", "Fundação para Ciência e Tecnologia",
    "Fundação da Ciência e Tecnologia", "Fundação para a Ciência e a Tecnologia (FCT)", "FCT- Fundação para a Ciência e a Tecnologia", "FCT - Fundação para a Ciência e a Tecnologia",
    "FCT - Portuguese Science Foundation", "FCT (POCI-01-0145-FEDER-029297)", "FCT-Fundação para a Ciência e a Tecnologia (POC-Conhecimento)", "FCT: PTDC/EIA-EIA/102185/2008", "FCT: PTDC/CCI-COM/3171/2021",
    "FCT- Grid Initiative", "FCT Sapiens 33572/99", "FCT PTDC/EIA-EIA/100752/2008", "FCT PRAXIS", "FCT POCI-01-0145-FEDER-032504", "FCT /POSI/SRI/41234/2001, 2002-2005.", "FCT - project PTDC/EEI-SCR/2072/2014",
    "FCT - PTDC/GES/70168/2006", "FCT - PTDC/EEI-TEL/3684/2014", "FCT - PTDC/ECM-TRA/1898/2012", "FCT - PRAXIS/C/EEI/11223/1998", "FCT - PRAXIS/C/EEI/10168/1998",
]


def scalars(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.crossJoin(b), frames)


def coverage(projects: DataFrame, runs: DataFrame, targets: DataFrame) -> DataFrame:
    """One pass a table; the latest run is the one with the highest id."""
    p = projects.agg(
        F.count("*").alias("total_projects"),
        F.count_if("detail_fetched").alias("detail_fetched_ok"),
        F.count("unavailable_reason").alias("detail_unavailable"),
        F.count_if(F.col("title").isNull()).alias("null_titles"),
    )
    latest = runs.agg(F.max("run_id").alias("_run"), F.max_by("site_total", "run_id").alias("site_total"))
    done = targets.join(F.broadcast(latest.select("_run")), F.col("run_id") == F.col("_run")).agg(F.count("*").alias("targets"), F.count_if(F.col("status") != "pending").alias("targets_terminal"))
    return scalars(p, latest.select("site_total"), done)


def projects_per_group(groups: DataFrame, project_groups: DataFrame) -> DataFrame:
    counted = project_groups.groupBy(F.col("group_code").alias("code")).agg(F.count("*").alias("project_count"))
    return groups.join(counted, "code").select("code", "name", "project_count")


def budget_by_group(projects: DataFrame, groups: DataFrame, project_groups: DataFrame) -> DataFrame:
    paid = projects.where("budget is not null").select("project_id", "budget")
    summed = paid.join(project_groups, "project_id").groupBy(F.col("group_code").alias("code")).agg(F.countDistinct("project_id").alias("project_count"), F.round(F.sum("budget"), 2).alias("total_budget"))
    return summed.join(groups, "code").select("code", "name", "project_count", "total_budget")


def budget_by_year(projects: DataFrame) -> DataFrame:
    dated = projects.where("start_date is not null").withColumn("year", F.substring("start_date", 1, 4))
    return dated.groupBy("year").agg(F.count("*").alias("project_count"), F.round(F.sum("budget"), 2).alias("total_budget"))


def start_timeline(projects: DataFrame) -> DataFrame:
    return projects.where("start_date is not null").groupBy(F.substring("start_date", 1, 4).alias("year")).agg(F.count("*").alias("starts"))


def fill_rates(projects: DataFrame, fields: DataFrame) -> DataFrame:
    total = projects.agg(F.count_if("detail_fetched").alias("total_fetched"))
    filled = fields.where("value_text is not null and value_text != ''").groupBy("label").agg(F.countDistinct("project_id").alias("projects_with_field"))
    return filled.crossJoin(F.broadcast(total)).withColumn("fill_rate_pct", F.round(F.lit(100.0) * F.col("projects_with_field") / F.col("total_fetched"), 1))


def funding_breakdown(projects: DataFrame, spellings: dict[str, str] | None = None, n: int = 15) -> DataFrame:
    """Spellings of one funder are counted under its canonical name."""
    funder = F.col("funding_raw")
    if spellings:
        funder = F.coalesce(F.create_map(*[F.lit(x) for pair in spellings.items() for x in pair])[funder], funder)
    named = projects.where("detail_fetched").select(F.coalesce(funder, F.lit(NO_FUNDING)).alias("funder"))
    return top_n_with_other(named.groupBy("funder").agg(F.count("*").alias("project_count")), "funder", "project_count", n)


def partners_breakdown(partners: DataFrame, n: int = 20) -> DataFrame:
    """Remainders are kept by type; a project that two of its partners share counts twice in them."""
    counted = partners.groupBy("partner_name").agg(F.min("partner_type").alias("partner_type"), F.countDistinct("project_id").alias("project_count"))
    return top_n_with_other(counted, "partner_name", "project_count", n, F.concat(F.lit("Other "), F.col("partner_type")))


def partners_by_type(partners: DataFrame) -> DataFrame:
    return partners.groupBy("partner_type").agg(F.countDistinct("partner_name").alias("partner_count"), F.countDistinct("project_id").alias("project_count"))


def partners_coverage(projects: DataFrame, partners: DataFrame, raw: str = "synopsis") -> DataFrame:
    p = projects.agg(F.count_if("detail_fetched").alias("detail_fetched_ok"), F.count_if(F.col("detail_fetched") & (F.coalesce(F.col(raw), F.lit("")) != "")).alias("projects_with_raw"))
    q = partners.agg(F.countDistinct("project_id").alias("projects_with_partners"), F.count("*").alias("partner_entries"), F.countDistinct("partner_name").alias("distinct_partners"))
    return scalars(p, q)


def partner_thesis_links(partners: DataFrame, projects: DataFrame, project_people: DataFrame, people: DataFrame, thesis_people: DataFrame, theses: DataFrame) -> DataFrame:
    """Partner, project, person, thesis: every hop stays visible."""
    led = partners.select("partner_name", "partner_type", "project_id").join(projects.select("project_id", F.col("title").alias("project_title")), "project_id")
    via = led.join(project_people.select("project_id", "person_slug", F.col("role").alias("project_role")), "project_id").join(people.select(F.col("slug").alias("person_slug"), F.col("name").alias("person_name")), "person_slug")
    written = thesis_people.where("person_slug is not null").select("handle", "person_slug", F.col("role").alias("thesis_role"), "match_status")
    return via.join(written, "person_slug").join(theses.select("handle", F.col("title").alias("thesis_title")), "handle")


def partner_thesis_totals(partners: DataFrame, projects: DataFrame, project_people: DataFrame, people: DataFrame, thesis_people: DataFrame, theses: DataFrame) -> DataFrame:
    """What the chains of a partner, person, thesis and role add up to: paths, projects, first project.

    Projects are the same for each of a person's theses, so both sides are added up by person before they meet; a chain is never a row."""
    written = thesis_people.where("person_slug is not null").join(theses.select("handle"), "handle").groupBy("person_slug", "handle", F.col("role").alias("thesis_role")).agg(F.count("*").alias("_mentions"))
    authors = written.select("person_slug").distinct()
    # a project may be published twice
    titled = projects.groupBy("project_id").agg(F.count("*").alias("_rows"), F.min("title").alias("title"))
    entries = partners.groupBy("project_id", "partner_name", "partner_type").agg(F.count("*").alias("_entries"))
    roles = project_people.join(authors, "person_slug", "left_semi").groupBy("project_id", "person_slug").agg(F.count("*").alias("_roles"))
    named = people.select(F.col("slug").alias("person_slug"), F.col("name").alias("person_name"))
    via = roles.join(titled, "project_id").join(entries, "project_id").join(named, "person_slug")
    paths = F.col("_entries") * F.col("_roles") * F.col("_rows")
    led = via.groupBy("partner_name", "partner_type", "person_slug", "person_name").agg(F.sum(paths).alias("_paths"), F.countDistinct("project_id").alias("projects"), F.min("title").alias("first_project"))
    return led.join(written, "person_slug").select("partner_name", "partner_type", "person_slug", "person_name", "handle", "thesis_role", (F.col("_paths") * F.col("_mentions")).alias("paths"), "projects", "first_project")


def partner_thesis_coverage(partners: DataFrame, project_people: DataFrame, thesis_people: DataFrame, theses: DataFrame) -> DataFrame:
    """Existence only: the chain is walked in semi-joins, never fanned out."""
    linked_people = thesis_people.where("person_slug is not null").select("person_slug").distinct()
    linked_projects = project_people.join(linked_people, "person_slug", "left_semi").select("project_id").distinct()
    p = partners.agg(F.countDistinct("partner_name").alias("distinct_partners"))
    q = partners.join(linked_projects, "project_id", "left_semi").agg(F.countDistinct("partner_name").alias("partners_linked"))
    partnered = project_people.join(partners.select("project_id"), "project_id", "left_semi").select("person_slug").distinct()
    r = theses.agg(F.count("*").alias("total_theses"))
    s = theses.join(thesis_people.join(partnered, "person_slug", "left_semi").select("handle"), "handle", "left_semi").agg(F.countDistinct("handle").alias("theses_linked"))
    return scalars(p, q, r, s)


def top_projects_per_group(projects: DataFrame, groups: DataFrame, project_groups: DataFrame, k: int = 10, code: str | None = None) -> DataFrame:
    good = projects.where("budget is not null and synopsis is not null and trim(synopsis) != ''").select("project_id", "title", "budget")
    placed = project_groups if code is None else project_groups.where(F.col("group_code") == code)
    joined = good.join(placed, "project_id").join(groups.select(F.col("code").alias("group_code"), F.col("name").alias("group_name")), "group_code")
    ranked = joined.withColumn("rank_in_group", F.row_number().over(Window.partitionBy("group_code").orderBy(F.desc("budget"), F.asc("title"), F.asc("project_id"))))
    return ranked.where(F.col("rank_in_group") <= k)


def _coordinated(project_people: DataFrame, aliases: DataFrame) -> DataFrame:
    return canonicalize(project_people.where("role = 'coordinator'").select("project_id", "person_slug"), aliases, "person_slug").distinct()


def top_coordinators(project_people: DataFrame, people: DataFrame, aliases: DataFrame, project_groups: DataFrame) -> DataFrame:
    """Totals are taken before projects fan out to their groups."""
    led = _coordinated(project_people, aliases)
    totals = led.groupBy("person_slug").agg(F.count("*").alias("project_count"))
    spread = led.join(project_groups, "project_id", "left").groupBy("person_slug", F.coalesce("group_code", F.lit(UNGROUPED)).alias("group_code")).agg(F.countDistinct("project_id").alias("group_project_count"))
    named = canonical_people(people, aliases).select(F.col("slug").alias("person_slug"), F.col("name").alias("coordinator"))
    return totals.join(named, "person_slug").join(spread, "person_slug").select("person_slug", "coordinator", "project_count", "group_code", "group_project_count")


def coordinators_wide(long: DataFrame, codes: list[str]) -> DataFrame:
    """A row for each coordinator, a column for each group, zeros filled."""
    wide = long.groupBy("person_slug", "coordinator", "project_count").pivot("group_code", codes).agg(F.first("group_project_count"))
    return wide.na.fill(0, subset=codes)


def person_group_shares(project_people: DataFrame, project_groups: DataFrame, lead: float = 1.0, other: float = 0.4) -> DataFrame:
    """For all people at once: a membership counts by its strongest role, once for each of its project's groups."""
    weight = F.max(F.when(F.col("role") == "coordinator", lead).otherwise(other)).alias("w")
    return project_people.groupBy("person_slug", "project_id").agg(weight).join(project_groups, "project_id").groupBy("person_slug", "group_code").agg(F.round(F.sum("w"), 3).alias("weight"))


def match_tiers(thesis_people: DataFrame) -> DataFrame:
    """Decisions, not rows: distinct names."""
    return thesis_people.groupBy("role", "match_status").agg(F.countDistinct("name_raw").alias("names"))


def _edges(thesis_people: DataFrame, listings: DataFrame) -> DataFrame:
    """One row for each (handle, name, role) with whether, and in which pool, it is resolved."""
    pool = listings.select("person_slug").distinct().withColumn("_uc", F.lit(True))
    r = thesis_people.join(pool, "person_slug", "left").withColumn("_uc", F.coalesce("_uc", F.lit(False)))
    known = F.col("person_slug").isNotNull()
    return r.groupBy("handle", "name_raw", "role").agg(F.max(known).alias("resolved"), F.max(known & ~F.col("_uc")).alias("own"), F.max(known & F.col("_uc")).alias("uc"))


def attribution_coverage(thesis_people: DataFrame, listings: DataFrame, theses: DataFrame) -> DataFrame:
    edges = _edges(thesis_people, listings)
    is_author, is_sup = F.col("role") == "author", F.col("role") == "supervisor"
    a = edges.agg(
        F.countDistinct(F.when(is_author, F.col("name_raw"))).alias("author_names"),
        F.countDistinct(F.when(is_author & F.col("resolved"), F.col("name_raw"))).alias("author_names_resolved"),
        F.countDistinct(F.when(is_sup, F.col("name_raw"))).alias("supervisor_names"),
        F.countDistinct(F.when(is_sup & F.col("resolved"), F.col("name_raw"))).alias("supervisor_names_resolved"),
        F.count_if(is_sup).alias("edges"),
        F.count_if(is_sup & F.col("resolved")).alias("edges_resolved"),
        F.count_if(is_sup & F.col("own")).alias("edges_own"),
        F.count_if(is_sup & F.col("uc") & ~F.col("own")).alias("edges_uc"),
    )
    pool = listings.select("person_slug").distinct()
    touching = thesis_people.where("person_slug is not null and match_status in ('exact', 'confident')").join(pool, "person_slug", "left_anti").select("handle").distinct()
    sup = edges.where(is_sup)
    inside = sup.join(touching, "handle", "left_semi")
    b = scalars(touching.agg(F.count("*").alias("touching_theses")), inside.agg(F.count("*").alias("touching_edges"), F.count_if("resolved").alias("touching_resolved")))
    # pairs of names of one thesis, counted from how many there are: names are distinct within a thesis
    per = sup.groupBy("handle").agg(F.count("*").alias("n"), F.count_if("resolved").alias("r"))
    c = per.agg(
        F.count("*").alias("theses_with_supervisor"),
        F.count_if(F.col("r") > 0).alias("theses_with_resolved"),
        F.count_if(F.col("r") == F.col("n")).alias("theses_fully_resolved"),
        F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.expr("r * (r - 1) div 2")), F.lit(0)).alias("pairs_resolved"),
    )
    d = scalars(theses.agg(F.count("*").alias("theses_total")), thesis_people.where("role = 'supervisor'").agg(F.countDistinct("person_slug").alias("supervisor_people")))
    return scalars(a, b, c, d)


def bibliography_summary(references: DataFrame, citations: DataFrame, theses: DataFrame) -> DataFrame:
    r = references.agg(F.count("*").alias("references_total"), F.count_if(F.col("cited_by") >= 2).alias("shared_references"), F.max("cited_by").alias("max_cited_by"))
    c = citations.agg(F.count("*").alias("citations_total"), F.countDistinct("handle").alias("theses_with_references"))
    t = theses.agg(F.count("*").alias("theses_total"), F.count_if("full_text").alias("theses_with_body"))
    return scalars(r, c, t)


def cited_by_histogram(references: DataFrame) -> DataFrame:
    return references.groupBy("cited_by").agg(F.count("*").alias("works"))


def reference_tiers(references: DataFrame) -> DataFrame:
    return references.groupBy("match_tier").agg(F.count("*").alias("works"), F.sum("cited_by").alias("citations"))


def references_per_thesis(theses: DataFrame, citations: DataFrame) -> DataFrame:
    counted = citations.groupBy("handle").agg(F.count("*").alias("n"))
    return theses.join(counted, "handle", "left").select("handle", "title", "year", "full_text", F.coalesce("n", F.lit(0)).alias("reference_count"))


def references_page(references: DataFrame, min_cited_by: int = 2, term: str | None = None, tier: str | None = None, limit: int = 50, offset: int = 0, total: bool = False) -> DataFrame:
    """total: with the number of all rows found, counted in the job that finds the page."""
    found = references.where(F.col("cited_by") >= min_cited_by)
    if term:
        found = found.where(contains_term("display", term))
    if tier:
        found = found.where(F.col("match_tier") == tier)
    return (paged if total else page)(found, [F.desc("cited_by"), F.asc("reference_id")], limit, offset)


def projects_page(projects: DataFrame, project_groups: DataFrame, group: str | None = None, term: str | None = None, unavailable: bool | None = None, limit: int = 50, offset: int = 0, total: bool = False) -> DataFrame:
    """Filters are only in the plan if asked for; group membership is a semi-join; codes are gathered for the page alone. total: with the
    number of all rows found, counted in the job that finds the page."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1 to 500")
    found = projects
    if group is not None:
        found = found.join(project_groups.where(F.col("group_code") == group).select("project_id"), "project_id", "left_semi")
    if term:
        found = found.where(contains_term("title", term))
    if unavailable is not None:
        found = found.where(F.col("unavailable_reason").isNotNull() == F.lit(unavailable))
    rows = (paged if total else page)(found.select("project_id", "title", "budget", "start_date"), [F.asc("title"), F.asc("project_id")], limit, offset)
    codes = project_groups.join(F.broadcast(rows.select("project_id")), "project_id", "left_semi").groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set("group_code")), ",").alias("group_codes"))
    return rows.join(codes, "project_id", "left")


def fold_roles(project_people: DataFrame, project_groups: DataFrame, slugs: list) -> DataFrame:
    """A person's (or alias group's) projects, one row each, with their roles and groups in order."""
    mine = project_people.where(F.col("person_slug").isin(slugs)).groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))
    codes = project_groups.join(mine.select("project_id"), "project_id", "left_semi").groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_set("group_code")), ",").alias("group_codes"))
    return mine.join(codes, "project_id", "left")


def project_counts(people: DataFrame, project_people: DataFrame, aliases: DataFrame) -> DataFrame:
    """Projects of each canonical person, zero included; alias memberships count with their target."""
    mapped = canonicalize(project_people.select("project_id", "person_slug"), aliases, "person_slug").groupBy("person_slug").agg(F.countDistinct("project_id").alias("n"))
    return canonical_people(people, aliases).join(mapped, F.col("slug") == F.col("person_slug"), "left").select("slug", "name", F.coalesce("n", F.lit(0)).alias("project_count"))


def people_search(people: DataFrame, project_people: DataFrame, aliases: DataFrame, term: str | None = None, limit: int = 20) -> DataFrame:
    counted = project_counts(people, project_people, aliases)
    counted = counted.where(contains_term("name", term)) if term else counted.where("project_count > 0")
    return page(counted, [F.desc("project_count"), F.asc("name"), F.asc("slug")], limit)


def busy_people(project_people: DataFrame, at_least: int = 2) -> DataFrame:
    per = project_people.groupBy("person_slug").agg(F.countDistinct("project_id").alias("n"))
    return per.agg(F.count_if(F.col("n") >= at_least).alias("people"))


def people_by_listing(people: DataFrame, aliases: DataFrame, listings: DataFrame) -> DataFrame:
    known = listings.select(F.col("person_slug").alias("slug")).distinct().withColumn("listed", F.lit(True))
    return canonical_people(people, aliases).join(known, "slug", "left").groupBy(F.coalesce("listed", F.lit(False)).alias("listed")).agg(F.count("*").alias("people"))


def primary_listing(listings: DataFrame) -> DataFrame:
    return listings.groupBy("person_slug").agg(F.min("source").alias("source"))


def thesis_counts_by_group(attributed: DataFrame, groups: DataFrame) -> DataFrame:
    """handle, code (null: unattributed) to counts; groups without a thesis are listed with zero."""
    counted = attributed.groupBy("code").agg(F.countDistinct("handle").alias("n"))
    every = groups.select("code").unionByName(groups.sparkSession.createDataFrame([("UNATTRIBUTED",)], "code string"))
    return every.join(counted.withColumn("code", F.coalesce("code", F.lit("UNATTRIBUTED"))), "code", "left").select("code", F.coalesce("n", F.lit(0)).alias("thesis_count"))


def repeat_students(thesis_people: DataFrame) -> DataFrame:
    """Authors, by slug or else name, of more than one thesis."""
    key = F.coalesce(F.col("person_slug").cast("string"), F.col("name_raw"))
    return thesis_people.where("role = 'author'").groupBy(key.alias("author_key")).agg(F.countDistinct("handle").alias("theses")).where("theses > 1")


def edges_per_name(thesis_people: DataFrame) -> DataFrame:
    """How many names have how many edges."""
    return thesis_people.groupBy("name_raw").agg(F.count("*").alias("edges")).groupBy("edges").agg(F.count("*").alias("names"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()])


def keyword_counts(words: DataFrame, n: int = 50, once: bool = False) -> DataFrame:
    """word, doc_id to the n words found in the most documents. once: no such pair comes twice, so they are counted where they lie."""
    count = F.count if once else F.countDistinct
    return page(words.groupBy("word").agg(count("doc_id").alias("documents")), [F.desc("documents"), F.asc("word")], n)


def person_keywords(keywords: DataFrame, members: DataFrame, aliases: DataFrame, slugs: list | None = None, key: str = "project_id", keyword: str = "keyword", person: str = "person_slug") -> DataFrame:
    """person, keyword, count of key: the keywords of what a person, under any of their names, took part in; for all people at
    once, or for the canonical slugs given."""
    who = canonicalize(members.where(F.col(person).isNotNull()).select(key, person), aliases, person)
    if slugs is not None:
        who = who.where(F.col(person).isin(slugs))
    return who.distinct().join(keywords.select(key, keyword).distinct(), key).groupBy(person, keyword).agg(F.count("*").alias("n"))


def person_pages(people: DataFrame, fields: DataFrame) -> DataFrame:
    """slug, page: the address whose last segment is the slug, the least of several, null where none was published."""
    last = F.element_at(F.split("href", "/"), -1)
    found = fields.where(F.col("href").contains("/")).groupBy(last.alias("_last")).agg(F.min("href").alias("page"))
    slug = people.select("slug", F.col("slug").cast("string").alias("_last"))
    return slug.join(found, "_last", "left").select("slug", "page")
