"""Nested results of one entity or page: joins that end in arrays of structs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.helpers import canonicalize


def list_theses(theses: DataFrame, thesis_people: DataFrame, people: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """handle, title, year with authors and supervisors as arrays of (name, slug, display), in order of name."""
    named = thesis_people.join(people.select(F.col("slug").alias("person_slug"), F.col("name").alias("display")), "person_slug", "left")
    if external is not None:
        named = named.join(external.select("handle", "name_raw", "role", F.col("display_name").alias("_e")), ["handle", "name_raw", "role"], "left").withColumn("display", F.coalesce("display", "_e")).drop("_e")
    each = F.struct("name_raw", "person_slug", F.coalesce("display", "name_raw").alias("display"))

    def of(role: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("role") == role, each))).alias(f"{role}s")

    nested = named.groupBy("handle").agg(of("author"), of("supervisor"))
    empty = F.array().cast("array<struct<name_raw:string,person_slug:bigint,display:string>>")
    out = theses.select("handle", "title", "year").join(nested, "handle", "left")
    same = dict(nested.dtypes)["authors"]
    return out.withColumns({c: F.coalesce(c, empty.cast(same)) for c in ("authors", "supervisors")})


def thesis_table(listed: DataFrame, groups: DataFrame, codes: list[str] | None = None, authors: list[str] | None = None, sort: str = "year", descending: bool = False) -> DataFrame:
    """The filterable table: any of the codes and any of the authors; nulls last either way; theses without a group count as UNATTRIBUTED."""
    g = groups.groupBy("handle").agg(F.array_sort(F.collect_set("group_code")).alias("codes"))
    t = listed.join(g, "handle", "left").withColumn("codes", F.coalesce("codes", F.array(F.lit("UNATTRIBUTED"))))
    if codes:
        t = t.where(F.arrays_overlap("codes", F.array(*[F.lit(c) for c in codes])))
    if authors:
        t = t.where(F.exists("authors", lambda a: a["display"].isin(authors)))
    c = F.col(sort)
    return t.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("handle"))


def person_detail(slug, people: DataFrame, aliases: DataFrame, project_people: DataFrame, projects: DataFrame, project_groups: DataFrame, thesis_people: DataFrame) -> DataFrame:
    """One row: the canonical person with projects (roles folded over the alias group), theses and groups."""
    group = aliases.where((F.col("to_slug") == slug) | (F.col("from_slug") == slug)).select(F.explode(F.array("from_slug", "to_slug")).alias("slug")).union(people.where(F.col("slug") == slug).select("slug")).distinct()
    canon = canonicalize(people.where(F.col("slug") == slug).select(F.col("slug").alias("s")), aliases, "s").select(F.col("s").alias("slug"))
    mine = project_people.join(F.broadcast(group.withColumnRenamed("slug", "person_slug")), "person_slug", "left_semi").groupBy("project_id").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    rows = mine.join(projects.select("project_id", "title"), "project_id").agg(F.array_sort(F.collect_list(F.struct("title", "project_id", "roles"))).alias("projects"))
    codes = project_groups.join(mine.select("project_id"), "project_id", "left_semi").agg(F.array_sort(F.collect_set("group_code")).alias("codes"))
    done = thesis_people.join(F.broadcast(group.withColumnRenamed("slug", "person_slug")), "person_slug", "left_semi").agg(F.array_sort(F.collect_set(F.struct("handle", "role"))).alias("theses"))
    return canon.join(people, "slug").crossJoin(rows).crossJoin(codes).crossJoin(done)


def author_options(listed: DataFrame) -> DataFrame:
    """display and theses: what the author filter offers, in order of name; listed from list_theses."""
    each = listed.select("handle", F.explode("authors").alias("a")).select("handle", F.col("a.display").alias("display")).distinct()
    return each.groupBy("display").agg(F.count("*").alias("theses")).orderBy("display")


def first_role(role: str = "role", first: str = "coordinator") -> Column:
    """Ordering key: 0 for the role that leads, 1 for the others."""
    return F.when(F.col(role) == first, 0).otherwise(1)


def project_detail(project_id, projects: DataFrame, project_groups: DataFrame, groups: DataFrame, project_people: DataFrame, people: DataFrame, partners: DataFrame, fields: DataFrame) -> DataFrame:
    """One row: the project with groups (by code), people (coordinators first, then by name), partners and raw fields as arrays;
    no row where there is no such project. Each table is filtered to the project before anything is joined."""
    mine = F.col("project_id") == project_id

    def nested(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    team = project_people.where(mine).join(people.select(F.col("slug").alias("person_slug"), "name"), "person_slug").withColumn("place", first_role())
    parts = [
        nested(project_groups.where(mine).join(groups.withColumnRenamed("code", "group_code"), "group_code"), "groups", "group_code", "name"),
        nested(team, "people", "place", "name", "person_slug", "role"),
        nested(partners.where(mine), "partners", "ordinal", "partner_name", "partner_type"),
        nested(fields.where(mine), "fields_raw", "label", "value_text"),
    ]
    out = projects.where(mine)
    for part in parts:
        out = out.join(part, "project_id", "left")
    return out


def thesis_detail(handle, theses: DataFrame, thesis_people: DataFrame, people: DataFrame, abstracts: DataFrame | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """One row: the listed thesis with its abstracts (handle, abstract_pt, abstract_en) and body (handle, body), each null where
    it isn't given or known."""
    pick = F.col("handle") == handle
    out = list_theses(theses.where(pick), thesis_people.where(pick), people)
    for frame, names in ((abstracts, ("abstract_pt", "abstract_en")), (bodies, ("body",))):
        if frame is None:
            out = out.withColumns({n: F.lit(None).cast("string") for n in names})
        else:
            out = out.join(frame.where(pick).select("handle", *names), "handle", "left")
    return out


def passages_by_thesis(found: DataFrame, handle: str = "handle") -> DataFrame:
    """Hits grouped by thesis, in order of the best, each with its passages in order."""
    g = found.groupBy(handle).agg(F.min("rank").alias("best"), F.array_sort(F.collect_list(F.struct("rank", "ordinal"))).alias("passages"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("best", handle)))


def resolve_directory(listed: DataFrame, people: DataFrame) -> DataFrame:
    """A harvested listing (url, name, base slug, source, seq) to a person: only an equal canonical url and compatible names
    merge; else a slug is minted. people: slug, url, tokens. Conflicts (one url, other names) are told."""
    known = people.select(F.col("slug").alias("known"), F.col("url"), F.col("tokens").alias("kt"))
    j = listed.join(known, "url", "left")
    fit = F.col("known").isNotNull() & ((F.size(F.array_except("tokens", "kt")) == 0) | (F.size(F.array_except("kt", "tokens")) == 0))
    # of one source's rows with one url, the first claims it
    first = F.row_number().over(Window.partitionBy("source", "url").orderBy("seq"))
    j = j.withColumn("merged", F.coalesce(fit & (first == 1), F.lit(False))).withColumn("conflict", F.coalesce(F.col("known").isNotNull() & ~fit, F.lit(False)))
    minted = F.row_number().over(Window.partitionBy("source", "base", "merged").orderBy("seq"))
    slug = F.when(F.col("merged"), F.col("known")).when(minted == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), minted.cast("string")))
    return j.select("source", "seq", slug.alias("slug"), "merged", "conflict")


def verdict_maps(pairs: DataFrame) -> dict[str, DataFrame]:
    """The maps that reviewed pairs (a, b, verdict, canonical) give: aliases, reviewed pairs, distinct pairs."""
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    same = pairs.where("verdict = 'same'")
    return {
        "aliases": same.select(F.when(F.col("canonical") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("from_slug"), F.col("canonical").alias("to_slug")),
        "reviewed": pairs.select(*ends).distinct(),
        "distinct": pairs.where("verdict = 'distinct'").select(*ends).distinct(),
    }


def verdict_rows(pairs: DataFrame, full_names: DataFrame, authors: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Every map that curated verdicts give, as rows map, key, value: alias and evidence (of pairs ruled the same), reviewed and
    distinct (pairs in order), full_name, exempt (a row for each handle of a reviewed author) and excluded (no value).

    pairs: a, b, verdict, canonical, evidence; full_names: slug, full_name; authors: slug, handles; duplicates:
    duplicate_handle. The inputs are taken as validated."""
    maps, same = verdict_maps(pairs), pairs.where("verdict = 'same'")
    other = F.when(F.col("canonical") == F.col("a"), F.col("b")).otherwise(F.col("a"))

    def rows(df: DataFrame, name: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("map"), key.cast("string").alias("key"), value.cast("string").alias("value"))

    a, b = F.col("a"), F.col("b")
    found = [
        rows(maps["aliases"], "alias", F.col("from_slug"), F.col("to_slug")),
        rows(same, "evidence", other, F.col("evidence")),
        rows(maps["reviewed"], "reviewed", a, b),
        rows(maps["distinct"], "distinct", a, b),
        rows(full_names, "full_name", F.col("slug"), F.col("full_name")),
        rows(authors.select("slug", F.explode("handles").alias("handle")).distinct(), "exempt", F.col("slug"), F.col("handle")),
        rows(duplicates.select("duplicate_handle").distinct(), "excluded", F.col("duplicate_handle"), F.lit(None)),
    ]
    return reduce(DataFrame.unionByName, found)


def identity_coverage(tiers: DataFrame, coverage: DataFrame) -> DataFrame:
    """How far names reach people, as rows section, name, measure, value: decisions by role and tier, distinct names, edges of
    supervision (all, and those of theses that the own directory touches, each with what either directory resolved), theses
    and pairs of supervisors. tiers: ``match_tiers``; coverage: the one row of ``attribution_coverage``."""
    places = [
        ("names", "author", "total", "author_names"), ("names", "author", "resolved", "author_names_resolved"), ("names", "supervisor", "total", "supervisor_names"), ("names", "supervisor", "resolved", "supervisor_names_resolved"),
        ("edges", "all", "total", "edges"), ("edges", "all", "resolved", "edges_resolved"), ("edges", "all", "resolved_own", "edges_own"), ("edges", "all", "resolved_listed", "edges_uc"),
        ("edges", "touching", "theses", "touching_theses"), ("edges", "touching", "total", "touching_edges"), ("edges", "touching", "resolved", "touching_resolved"),
        ("theses", "all", "total", "theses_total"), ("theses", "all", "with_supervisor", "theses_with_supervisor"), ("theses", "all", "with_resolved", "theses_with_resolved"), ("theses", "all", "fully_resolved", "theses_fully_resolved"),
        ("pairs", "supervisors", "total", "pairs"), ("pairs", "supervisors", "resolved", "pairs_resolved"), ("people", "supervisors", "total", "supervisor_people"),
    ]
    cells = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.lit(m).alias("measure"), F.col(c).cast("long").alias("value")) for s, n, m, c in places])
    flat = coverage.select(F.inline(cells))
    return flat.unionByName(tiers.select(F.lit("tiers").alias("section"), F.col("role").alias("name"), F.col("match_status").alias("measure"), F.col("names").cast("long").alias("value")))


def theses_of_group(theses: DataFrame, agreed: DataFrame, year: str | None = None, group: str | None = None) -> DataFrame:
    """theses with their groups (one where people and content agree or only one of them speaks, two where they differ) and the
    tier that says how far to trust them; of one year and one group where given. agreed: ``affinity.agreement``."""
    codes = F.array_sort(F.array_distinct(F.array_compact(F.array("people_code", "content_code"))))
    kept = theses if year is None else theses.where(F.col("year") == year)
    if group is not None:
        agreed = agreed.where((F.col("people_code") == group) | (F.col("content_code") == group))
    placed = agreed.select("handle", codes.alias("groups"), "tier")
    return kept.join(placed, "handle", "left" if group is None else "inner")


def fit_response(matches: DataFrame, theses: DataFrame, thesis_people: DataFrame, interests: list[str]) -> DataFrame:
    """Matched theses with the interest that won, supervisors and title. matches: handle, distance, facet, rank."""
    names = F.array(*[F.lit(i) for i in interests])
    sup = thesis_people.where("role = 'supervisor'").join(F.broadcast(matches.select("handle")), "handle", "left_semi").groupBy("handle").agg(F.array_sort(F.collect_set("name_raw")).alias("supervisors"))
    return matches.join(theses.select("handle", "title", "year"), "handle").join(sup, "handle", "left").withColumn("interest", F.get(names, F.col("facet"))).withColumn("supervisors", F.coalesce("supervisors", F.array().cast("array<string>")))
