"""What a reviewer reads about names: near misses, an audit of the unresolved, triage, cross-checks and the build report.

Names meet a pool on the rarest token they could share (tokens are counted first), so a common surname is a key only for
names that consist of common ones. Every report is a frame; the sample of the audit is drawn by hash, so it is the same
wherever it runs. ``edges`` below are distinct (handle, name_raw) pairs; pools are slug, name, source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import name_parts, name_token_list
from lodestar.operators.helpers import written
from lodestar.operators.identity import _initial_of, fits, fits_full, match_names

SEED, SAMPLE, REVIEW_CUT, FORMER_YEAR, TOP = 20261018, 30, 2, 2015, 100
#: Rows of a pool from which on a token is common.
COMMON = 10_000
NEVER, FORMER, MISSED = "never-uc", "former-uc", "resolvable-missed"

#: Parts of set labels and the unit each names, in order of precedence; None is a unit without a directory.
UNITS: list[tuple[str, str | None]] = [
    ("FEUC", "feuc"),
    ("Faculdade de Economia", "feuc"),
    ("FDUC", "fduc"),
    ("Faculdade de Direito", "fduc"),
    ("FLUC", "fluc"),
    ("Faculdade de Letras", "fluc"),
    ("FFUC", "ffuc"),
    ("Faculdade de Farmácia", "ffuc"),
    ("FPCEUC", "fpce"),
    ("Faculdade de Psicologia", "fpce"),
    ("FCTUC Ciências da Vida", "fctuc-dcv"),
    ("Departamento de Ciências da Vida", "fctuc-dcv"),
    ("FCTUC Eng.Electrotécnica", "fctuc-deec"),
    ("Departamento de Engenharia Electrotécnica", "fctuc-deec"),
    ("CES ", "ces"),
    ("I&D CES", "ces"),
    ("FMUC", None),
    ("Faculdade de Medicina", None),
    ("FCDEF", None),
    ("Faculdade de Ciências do Desporto", None),
    ("FCTUC", None),
    ("Faculdade de Ciências e Tecnologia", None),
    ("Departamento de", None),
    ("Colégio das Artes", None),
    ("IIIUC", None),
    ("Instituto de Investigação Interdisciplinar", None),
    ("I&D", None),
    ("CNC", None),
    ("CEIS20", None),
    ("CELGA", None),
    ("CEMMPRE", None),
    ("CFE", None),
    ("CINEICC", None),
    ("ADAI", None),
    ("Unidades de Investigação", None),
]


def parted(names: DataFrame) -> DataFrame:
    """name_raw, surname, given of the distinct names."""
    return names.select("name_raw").distinct().withColumn("p", name_parts("name_raw")).select("name_raw", "p.surname", "p.given")


def _every() -> Column:
    return F.concat("surname", "given")


def _accounted(t: Column) -> Column:
    return F.array_contains(_every(), t) | _initial_of(t, F.col("given"))


def bearers(names: DataFrame, pool: DataFrame) -> DataFrame:
    """names (parted) with each row of pool (slug, name, source, tokens) that has all of their surname tokens.

    A name meets the pool on the surname token that the fewest rows have; one that no row has leaves it out. Common tokens on
    which no name meets it are known before the rows are dealt out by token."""
    keyed = pool.withColumn("block", F.explode(F.array_distinct("tokens")))
    held = keyed.groupBy("block").agg(F.count("*").alias("n"))
    asked = names.select("name_raw", F.explode(F.array_distinct("surname")).alias("block")).join(held, "block", "left")
    rare = asked.groupBy("name_raw").agg(F.min_by("block", F.struct(F.coalesce("n", F.lit(0)), F.col("block"))).alias("block"))
    idle = held.where(F.col("n") > COMMON).select("block").join(rare.select("block").distinct(), "block", "left_anti")
    keyed = keyed.join(F.broadcast(idle), "block", "left_anti")  # at most a token for each COMMON of the pool's
    return names.join(rare, "name_raw").join(keyed, "block").drop("block").where(F.forall("surname", lambda t: F.array_contains("tokens", t)))


def sharers(names: DataFrame, pool: DataFrame) -> DataFrame:
    """names (parted, of two given names at least) with each row of pool that carries the first given name or its initial and a
    further one, but not all surname tokens. They meet on a further given name together with the first one's initial."""
    first = F.get("given", 0)
    further = F.array_distinct(F.slice("given", 2, F.greatest(F.size("given") - 1, F.lit(0))))
    asked = names.where((F.size("surname") > 0) & (F.size("given") > 1)).select("*", F.explode(F.transform(further, lambda t: F.concat(F.substring(first, 1, 1), F.lit(" "), t))).alias("block"))
    initials = F.array_distinct(F.transform("tokens", lambda t: F.substring(t, 1, 1)))
    blocks = F.array_distinct(F.flatten(F.transform("tokens", lambda t: F.transform(initials, lambda i: F.concat(i, F.lit(" "), t)))))
    met = asked.join(pool.withColumn("block", F.explode(blocks)), "block").drop("block").dropDuplicates(["name_raw", "slug", "name", "source"])
    carries = F.array_contains("tokens", first) | F.exists("tokens", lambda t: (F.length(t) == 1) & first.startswith(t))
    return met.where(carries & ~F.forall("surname", lambda t: F.array_contains("tokens", t)))


def misses(names: DataFrame, pool: DataFrame) -> DataFrame:
    """name_raw, slug, name, source and how the row stands to the name: fits, superset (all of the name and more), bearing (all
    surname tokens), loose (wrong-ended: the given names under another surname), tight (such a row with nothing else in it);
    unaccounted: its tokens that the name doesn't explain. Rows of a pool that could never fit are left out."""
    # several branches read both
    asked, rows = written(parted(names)), written(pool.select("slug", "name", "source", name_token_list("name").alias("tokens")))
    fit = fits(F.col("surname"), F.col("given"), F.col("tokens"))
    unaccounted = F.filter("tokens", lambda t: ~_accounted(t))
    no = F.lit(False)
    near = bearers(asked, rows).select("name_raw", "slug", "name", "source", fit.alias("fits"), (F.forall(_every(), lambda t: F.array_contains("tokens", t)) & ~fit).alias("superset"), F.lit(True).alias("bearing"), no.alias("loose"), no.alias("tight"), unaccounted.alias("unaccounted"))
    ended = sharers(asked, rows).select("name_raw", "slug", "name", "source", no.alias("fits"), no.alias("superset"), no.alias("bearing"), F.lit(True).alias("loose"), F.forall("tokens", _accounted).alias("tight"), unaccounted.alias("unaccounted"))
    return near.unionByName(ended)


SHAPES = ("superset", "tight", "loose", "bearing")


def shaped(names: DataFrame, pool: DataFrame) -> DataFrame:
    """name_raw and, for each shape, the rows (name, source, unaccounted) of the pool that have it; any_fit. Names without a row
    near them are left out."""
    row = F.struct("name", "source", "unaccounted")
    lists = [F.array_sort(F.collect_set(F.when(F.col(s), row))).alias(s) for s in SHAPES]
    return misses(names, pool).groupBy("name_raw").agg(*lists, F.bool_or("fits").alias("any_fit"))


def audit(edges: DataFrame, pool: DataFrame, cut: int = REVIEW_CUT, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """A row for each unresolved name: edges, the rows of each shape, flagged (superset or tight), and review: ``cut`` for names
    of that many edges, ``sample`` for so many of the others, drawn by hash; null for the rest."""
    per = edges.select("handle", "name_raw").distinct().groupBy("name_raw").agg(F.count("*").alias("edges"))
    drawn = per.where(F.col("edges") < cut).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), "name_raw"), 256), "name_raw").limit(sample).select("name_raw", F.lit("sample").alias("drawn"))
    out = per.join(shaped(per, pool), "name_raw", "left").join(drawn, "name_raw", "left")
    none = F.array().cast("array<struct<name:string,source:string,unaccounted:array<string>>>")
    out = out.select("name_raw", "edges", *[F.coalesce(s, none).alias(s) for s in SHAPES], F.when(F.col("edges") >= cut, "cut").otherwise(F.col("drawn")).alias("review"))
    return out.withColumn("flagged", (F.size("superset") > 0) | (F.size("tight") > 0))


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row: names, edges, flagged names (all, reviewed, in the sample), names that only the loose shape flags, names that no
    row's surname bears, and the singles that the sample left."""
    c = F.col
    return audited.agg(
        F.count("*").alias("names"),
        F.sum("edges").alias("edges"),
        F.count_if("flagged").alias("flagged"),
        F.count_if(c("flagged") & (c("review") == "cut")).alias("flagged_above_cut"),
        F.count_if(c("flagged") & (c("review") == "sample")).alias("flagged_in_sample"),
        F.count_if(F.size("loose") > 0).alias("loose"),
        F.count_if(F.size("bearing") == 0).alias("without_bearing"),
        F.count_if(c("review").isNull()).alias("not_sampled"),
    )


def unit_of(label: Column, units: list[tuple[str, str | None]] = UNITS) -> Column:
    """The unit that a set's label names: of the needles in it the first in order; ``unharvested:<needle>`` for a unit without a
    directory, null where there is none. The needles go with the plan as one literal."""
    table = F.array(*[F.struct(F.lit(n).alias("needle"), F.lit(u if u else f"unharvested:{n}").alias("unit")) for n, u in units])
    return F.get(F.filter(table, lambda x: label.contains(x["needle"])), 0)["unit"]


def triage(edges: DataFrame, own: DataFrame, wider: DataFrame, theses: DataFrame, sets: DataFrame, units: list[tuple[str, str | None]] = UNITS, year: int = FORMER_YEAR) -> DataFrame:
    """The dossier of each unresolved name and the class its evidence suggests: edges, max_year, sets and units of its theses,
    harvested units, rows of each shape in both pools, class and reason.

    theses: handle, year (text); sets: handle, label. Rules in order: a known shape or a row that bears the surname is a miss to
    mend; so are theses whose units have no directory, or that name none; as long as any unit of the corpus has none, nobody is
    written off; only then is a name of old theses former, of newer ones never."""
    each = edges.select("handle", "name_raw").distinct()
    harvested = wider.select(F.col("source").alias("unit")).distinct().withColumn("harvested", F.lit(True))
    named = sets.select("label").distinct().withColumn("unit", unit_of(F.col("label"), units)).join(harvested, "unit", "left")
    gaps = named.where("unit is not null and harvested is null").agg((F.count("*") == 0).alias("covered")).scalar()
    years = each.join(theses.select("handle", F.col("year").try_cast("int").alias("year")), "handle", "left").groupBy("name_raw").agg(F.count("*").alias("edges"), F.max("year").alias("max_year"))
    seen = each.join(sets, "handle").select("name_raw", "label").distinct().join(named, "label").groupBy("name_raw").agg(
        F.array_sort(F.collect_set("label")).alias("sets"), F.array_sort(F.collect_set("unit")).alias("units"), F.array_sort(F.collect_set(F.when(F.col("harvested"), F.col("unit")))).alias("units_harvested")
    )
    out = years.join(seen, "name_raw", "left")
    for side, pool in (("own", own), ("wider", wider)):
        near = shaped(years, pool)
        out = out.join(near.select("name_raw", *[F.col(s).alias(f"{side}_{s}") for s in (*SHAPES, "any_fit")]), "name_raw", "left")
    some = {c: F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("units", "units_harvested", *[f"{side}_{s}" for side in ("own", "wider") for s in SHAPES])}
    apart = some["units"] & ~some["units_harvested"]
    shape = {side: some[f"{side}_superset"] | some[f"{side}_tight"] for side in ("own", "wider")}
    missed = shape["own"] | shape["wider"] | some["wider_bearing"] | apart | ~some["units"] | ~gaps
    verdict = F.when(missed, MISSED).when(F.coalesce("max_year", F.lit(9999)) <= year, FORMER).otherwise(NEVER)
    why = F.when(shape["wider"], "shape-flag-wider-pool").when(shape["own"], "shape-flag-own-pool").when(some["wider_bearing"], "surname-bearing-candidate-to-review").when(apart, "faculty-not-in-the-registry").otherwise("thesis-names-no-uc-faculty")
    return out.withColumn("class", verdict).withColumn("reason", F.when(missed, why).otherwise(F.col("class")))


def triage_report(triaged: DataFrame, top: int = TOP) -> DataFrame:
    """part (top: the names of most edges; tail), class, reason, names and edges: by part and class, and by reason over both."""
    first = triaged.orderBy(F.desc("edges"), "name_raw").limit(top).select("name_raw", F.lit("top").alias("part"))
    rows = triaged.select("name_raw", "edges", "class", "reason").join(first, "name_raw", "left").na.fill("tail", ["part"])
    p, c, r = F.col("part"), F.col("class"), F.col("reason")
    return rows.groupingSets([[p, c], [r]], p, c, r).agg(F.count("*").alias("names"), F.sum("edges").alias("edges"))


def cross_fits(matched: DataFrame, wider: DataFrame, distinct_pairs: DataFrame | None = None) -> DataFrame:
    """Resolved names that rows of the wider pool fit, too: name_raw, slugs, wider_slugs, wider_status. Reported, never acted on.

    matched: name_raw, status, slugs (from match_names); wider with canonical; distinct_pairs: a, b, reviewed as two people."""
    # matching reads its names several times, so each step is worked out once
    done = written(matched.where("status in ('exact', 'confident')").select("name_raw", "slugs"))
    also = written(misses(done, wider).where("fits").groupBy("name_raw").agg(F.array_sort(F.collect_set("slug")).alias("wider_slugs")))
    status = match_names(also, wider, distinct_pairs).select("name_raw", F.col("status").alias("wider_status"))
    return done.join(also, "name_raw").join(status, "name_raw")


def _at_floor(rows: DataFrame) -> DataFrame:
    """rows (name_raw, name) whose person's name has nothing beyond the surname and the first given name."""
    p = rows.withColumn("p", name_parts("name_raw")).select("*", "p.surname", "p.given").drop("p")
    return p.where(F.size(F.array_except(name_token_list(F.coalesce("name", F.lit(""))), F.array_union("surname", F.slice("given", 1, 1)))) == 0)


def minimal_evidence(rows: DataFrame, people: DataFrame) -> DataFrame:
    """Resolved authors that rest on two tokens: name_raw, person_slug, person_name and the least handle."""
    claims = rows.where("role = 'author' and person_slug is not null").groupBy("name_raw", "person_slug").agg(F.min("handle").alias("handle"))
    named = claims.join(people.select(F.col("slug").alias("person_slug"), "name"), "person_slug", "left")
    return _at_floor(named).select("name_raw", "person_slug", F.col("name").alias("person_name"), "handle")


def wider_minimal_evidence(rows: DataFrame, wider: DataFrame, listed: DataFrame) -> DataFrame:
    """Supervisors that the second pass resolved on two tokens, with match_status and the listed form that accounts for the whole
    name (corroborated_by: label and form, the least of them), if there is one.

    rows: handle, name_raw, role, person_slug, match_status, second_pass; listed: slug, label, form."""
    claims = rows.where("role = 'supervisor' and person_slug is not null and second_pass").groupBy("name_raw", "person_slug").agg(F.min(F.struct("handle", "match_status")).alias("h"))
    ids = wider.select("slug", "name").unionByName(wider.select(F.col("canonical").alias("slug"), "name")).groupBy("slug").agg(F.min("name").alias("name"))
    named = _at_floor(claims.join(ids.withColumnRenamed("slug", "person_slug"), "person_slug"))
    forms = named.join(listed.select(F.col("slug").alias("person_slug"), "label", "form", name_token_list("form").alias("full")), "person_slug")
    known = forms.where(fits_full(F.col("surname"), F.col("given"), F.col("full"))).groupBy("name_raw", "person_slug").agg(F.min(F.struct("label", "form")).alias("corroborated_by"))
    out = named.join(known, ["name_raw", "person_slug"], "left")
    return out.select("name_raw", "person_slug", F.col("name").alias("person_name"), "h.handle", "h.match_status", "corroborated_by")


def build_report(people_rows: DataFrame, sets: DataFrame) -> DataFrame:
    """section, value, n (rows) and names (distinct ones) of a build, from one pass over each table: by tier, role, and both, in
    all, and theses by set. people_rows: handle, name_raw, role, match_status; sets: handle, label."""
    t, r = F.col("match_status"), F.col("role")
    told = people_rows.groupingSets([[t], [r], [r, t], []], r, t).agg(F.count("*").alias("n"), F.countDistinct("name_raw").alias("names"), F.grouping_id().alias("g"))
    section = F.when(F.col("g") == 0, "role and tier").when(F.col("g") == 1, "role").when(F.col("g") == 2, "tier").otherwise("all")
    by_set = sets.groupBy("label").agg(F.countDistinct("handle").alias("n"))
    return told.select(section.alias("section"), F.concat_ws(" ", "role", "match_status").alias("value"), "n", "names").unionByName(by_set.select(F.lit("set").alias("section"), F.col("label").alias("value"), "n", F.lit(None).cast("long").alias("names")))
