"""Queries of the reports on unresolved names: audit, triage with and without gaps, cross fits, minimal evidence, build report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import identity, review
from lodestar.plans.catalogue import register
from lodestar.sources.roles import Roles


def _k() -> Column:
    return F.col("c_custkey")


def _number() -> Column:
    return F.regexp_replace("c_name", "[^0-9]", "")


#: Every eighth name has another shape; every fifth a second edge.
M = """WITH c AS (SELECT c_custkey AS k, c_custkey % 8 AS s, regexp_replace(c_name, '[^0-9]', '', 'g') AS num, c_mktsegment AS seg FROM customer),
  m AS (SELECT k, s, seg, num || CASE WHEN s IN (2, 3) THEN ', Ana Maria C' || num ELSE ', Ana' END AS name_raw, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS edges, 1990 + k % 40 AS year FROM c)"""


def _named(r: Roles) -> DataFrame:
    name = F.concat(_number(), F.when((_k() % 8).isin(2, 3), F.concat(F.lit(", Ana Maria C"), _number())).otherwise(", Ana"))
    return r.table("customer").select(_k().alias("k"), (_k() % 8).alias("s"), _number().alias("num"), F.col("c_mktsegment").alias("segment"), name.alias("name_raw"))


def _edges(r: Roles) -> DataFrame:
    m = _named(r)
    return m.select(F.col("k").alias("handle"), "name_raw").unionByName(m.where("k % 5 = 0").select((-1 - F.col("k")).alias("handle"), "name_raw"))


def _near(r: Roles, side: str) -> DataFrame:
    m, num = _named(r), F.col("num")
    name = F.when(F.col("s") < 2, F.concat(F.lit("Ana Rita "), num)).when(F.col("s") == 2, F.concat(F.lit("Ana C"), num)).when(F.col("s") == 3, F.concat(F.lit("Ana Lopes C"), num)).otherwise(F.concat(F.lit("Rui "), num))
    return m.where("s = 1" if side == "own" else "s in (0, 2, 3, 4)").select(F.concat(F.lit(side[0]), F.col("k").cast("string")).alias("slug"), name.alias("name"), F.concat(F.lit("u"), (F.col("k") % 3).cast("string")).alias("source"))


AUDITED = M + """, a AS (SELECT name_raw, edges, CASE WHEN s < 2 THEN 1 ELSE 0 END AS superset, CASE WHEN s = 2 THEN 1 ELSE 0 END AS tight, CASE WHEN s IN (2, 3) THEN 1 ELSE 0 END AS loose, CASE WHEN s IN (0, 1, 4) THEN 1 ELSE 0 END AS bearing,
  CASE WHEN s IN (0, 1) THEN 'rita' WHEN s = 4 THEN 'rui' ELSE '' END AS unaccounted FROM m),
  d AS (SELECT name_raw FROM a WHERE edges < 2 ORDER BY sha256('20261018:' || name_raw), name_raw LIMIT 30),
  r AS (SELECT *, superset + tight > 0 AS flagged, CASE WHEN edges >= 2 THEN 'cut' WHEN name_raw IN (SELECT name_raw FROM d) THEN 'sample' END AS review FROM a) """


def _audited(r: Roles) -> DataFrame:
    return review.audit(_edges(r), _near(r, "own").unionByName(_near(r, "wider")))


@register("audit_misses", "", AUDITED + "SELECT name_raw, edges, superset, tight, loose, bearing, unaccounted, flagged, review FROM r")
def audit_misses(r: Roles) -> DataFrame:
    a = _audited(r)
    unaccounted = F.array_join(F.flatten(F.transform("bearing", lambda x: x["unaccounted"])), ",")
    return a.select("name_raw", F.col("edges").cast("int").alias("edges"), *[F.size(s).alias(s) for s in review.SHAPES], unaccounted.alias("unaccounted"), "flagged", "review")


@register("audit_summary", "", AUDITED + """SELECT count(*) AS names, CAST(sum(edges) AS BIGINT) AS edges, count(*) FILTER (flagged) AS flagged, count(*) FILTER (flagged AND review = 'cut') AS flagged_above_cut, count(*) FILTER (flagged AND review = 'sample') AS flagged_in_sample,
  count(*) FILTER (loose > 0) AS loose, count(*) FILTER (bearing = 0) AS without_bearing, count(*) FILTER (review IS NULL) AS not_sampled FROM r""")
def audit_summary(r: Roles) -> DataFrame:
    return review.audit_summary(_audited(r))


def _triaged(r: Roles, house: str | None) -> DataFrame:
    units = [("AUTO", "u0"), ("A", "u1"), ("BUILD", "u1"), ("HOUSE", house), ("MACHINES", None), ("MACH", "u2")]
    m = _named(r)
    theses = m.select(F.col("k").alias("handle"), (F.lit(1990) + F.col("k") % 40).cast("string").alias("year")).unionByName(m.select((-1 - F.col("k")).alias("handle"), F.lit("s/d").alias("year")))
    sets = m.select(F.col("k").alias("handle"), F.col("segment").alias("label")).unionByName(m.select((-1 - F.col("k")).alias("handle"), F.lit("other").alias("label")))
    return review.triage(_edges(r), _near(r, "own"), _near(r, "wider"), theses, sets, units)


def _triage_sql(covered: bool) -> str:
    """Segments by needles in order: AUTOMOBILE has AUTO, MACHINERY and the rest that have an A have u1 (an earlier needle)."""
    house = "'u0'" if covered else "'unharvested:HOUSE'"
    last = "CASE WHEN year <= 2015 THEN 'former-uc' ELSE 'never-uc' END" if covered else "'thesis-names-no-uc-faculty'"
    unit = f"CASE WHEN contains(seg, 'AUTO') THEN 'u0' WHEN contains(seg, 'A') OR contains(seg, 'BUILD') THEN 'u1' WHEN contains(seg, 'HOUSE') THEN {house} END"
    return (
        M
        + f""", u AS (SELECT *, {unit} AS unit FROM m),
  w AS (SELECT *, CASE WHEN s IN (0, 2) THEN 'shape-flag-wider-pool' WHEN s = 1 THEN 'shape-flag-own-pool' WHEN s = 4 THEN 'surname-bearing-candidate-to-review' WHEN unit LIKE 'unharvested%' THEN 'faculty-not-in-the-registry' WHEN unit IS NULL THEN 'thesis-names-no-uc-faculty' ELSE {last} END AS reason FROM u),
  t AS (SELECT name_raw, edges, year AS max_year, coalesce(unit, '') AS units, CASE WHEN unit LIKE 'u_' THEN unit ELSE '' END AS units_harvested, CASE WHEN reason IN ('former-uc', 'never-uc') THEN reason ELSE 'resolvable-missed' END AS class, reason FROM w) """
    )


def _dossier(t: DataFrame) -> DataFrame:
    return t.select("name_raw", F.col("edges").cast("int").alias("edges"), "max_year", F.array_join("units", ",").alias("units"), F.array_join("units_harvested", ",").alias("units_harvested"), "class", "reason")


@register("triage_names", "", _triage_sql(True) + "SELECT name_raw, edges, CAST(max_year AS INTEGER) AS max_year, units, units_harvested, class, reason FROM t")
def triage_names(r: Roles) -> DataFrame:
    """Every unit that the corpus points at has a directory, so names can be written off."""
    return _dossier(_triaged(r, "u0"))


@register("triage_with_gaps", "", _triage_sql(False) + "SELECT name_raw, edges, CAST(max_year AS INTEGER) AS max_year, units, units_harvested, class, reason FROM t")
def triage_with_gaps(r: Roles) -> DataFrame:
    """One unit has no directory: its names are gaps of the registry, and nobody is written off."""
    return _dossier(_triaged(r, None))


@register("triage_report", "", _triage_sql(True) + """, p AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY edges DESC, name_raw) <= 100 THEN 'top' ELSE 'tail' END AS part FROM t)
  SELECT part, class, reason, count(*) AS names, CAST(sum(edges) AS BIGINT) AS edges FROM p GROUP BY GROUPING SETS ((part, class), (reason))""")
def triage_report(r: Roles) -> DataFrame:
    return review.triage_report(_triaged(r, "u0"))


def _text(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


@register("cross_directory_fits", "", """WITH c AS (SELECT c_custkey AS k, regexp_replace(c_name, '[^0-9]', '', 'g') AS num FROM customer)
  SELECT num || ', Ana Maria' AS name_raw, 'o' || k AS slugs, CASE WHEN k % 3 = 0 THEN 'w' || k ELSE 'w' || k || ',x' || k END AS wider_slugs, CASE WHEN k % 3 = 0 OR k % 9 = 4 THEN 'confident' ELSE 'ambiguous' END AS wider_status FROM c WHERE k % 3 < 2 AND k % 7 > 0""")
def cross_directory_fits(r: Roles) -> DataFrame:
    """The wider pool has one row (a third), two rows (a third; of one person for some, of these some reviewed as two) or none."""
    c, k = r.table("customer"), _k().cast("string")
    own = c.where(_k() % 7 > 0).select(F.concat(F.lit("o"), k).alias("slug"), F.concat(F.lit("Ana Maria "), _number()).alias("name"), F.lit("own").alias("source")).withColumn("canonical", F.col("slug"))
    first = c.where(_k() % 3 < 2).select(F.concat(F.lit("w"), k).alias("slug"), F.concat(F.lit("Ana "), _number()).alias("name"), F.lit("a").alias("source"), F.concat(F.lit("w"), k).alias("canonical"))
    second = c.where(_k() % 3 == 1).select(F.concat(F.lit("x"), k).alias("slug"), F.concat(F.lit("Ana Maria "), _number()).alias("name"), F.lit("b").alias("source"), F.concat(F.when((_k() % 9).isin(4, 7), "w").otherwise("x"), k).alias("canonical"))
    apart = c.where(_k() % 9 == 7).select(F.concat(F.lit("x"), k).alias("a"), F.concat(F.lit("w"), k).alias("b"))
    # two rows fit and both carry the first given name: ambiguous unless they are one person
    matched = identity.match_names(c.select(F.concat(_number(), F.lit(", Ana Maria")).alias("name_raw")), own)
    return review.cross_fits(matched, first.unionByName(second), apart).select("name_raw", _text("slugs"), _text("wider_slugs"), "wider_status")


@register("minimal_evidence", "", """SELECT regexp_replace(c_name, '[^0-9]', '', 'g') || ', Ana Maria' AS name_raw, c_custkey AS person_slug, CASE WHEN c_custkey % 4 = 0 THEN 'Ana ' || regexp_replace(c_name, '[^0-9]', '', 'g') END AS person_name, c_custkey AS handle FROM customer WHERE c_custkey % 2 = 0""")
def minimal_evidence(r: Roles) -> DataFrame:
    """Half of the people have a middle name, a quarter none, a quarter isn't listed; each name has two theses."""
    c = r.table("customer")
    rows = c.select(F.explode(F.array(_k() + 1_000_000_000, _k())).alias("handle"), F.concat(_number(), F.lit(", Ana Maria")).alias("name_raw"), F.lit("author").alias("role"), _k().alias("person_slug"))
    people = c.where(_k() % 4 != 2).select(_k().alias("slug"), F.concat(F.when(_k() % 2 == 1, "Ana Maria ").otherwise("Ana "), _number()).alias("name"))
    others = rows.withColumn("role", F.lit("supervisor")).unionByName(rows.withColumn("person_slug", F.lit(None).cast("long")))
    return review.minimal_evidence(rows.unionByName(others), people)


@register("wider_minimal_evidence", "", """WITH c AS (SELECT c_custkey AS k, regexp_replace(c_name, '[^0-9]', '', 'g') AS num FROM customer)
  SELECT num || ', Ana Maria' AS name_raw, 'p' || k AS person_slug, 'Ana ' || num AS person_name, k AS handle, CASE WHEN k % 5 = 0 THEN 'exact' ELSE 'confident' END AS match_status, CASE WHEN k % 3 = 0 THEN 'unit-b: Ana Maria Costa ' || num WHEN k % 3 = 1 THEN 'unit-c: Maria Ana ' || num END AS corroborated_by FROM c WHERE k % 4 > 0""")
def wider_minimal_evidence(r: Roles) -> DataFrame:
    """Forms that account for the whole name come from one unit, another, or none; a shorter form never does."""
    c, k = r.table("customer"), _k().cast("string")
    slug = F.concat(F.lit("p"), k)
    rows = c.select(F.explode(F.array(_k() + 1_000_000_000, _k())).alias("handle"), F.concat(_number(), F.lit(", Ana Maria")).alias("name_raw"), F.lit("supervisor").alias("role"), slug.alias("person_slug"), F.when(_k() % 5 == 0, "exact").otherwise("confident").alias("match_status"), F.lit(True).alias("second_pass"))
    wider = c.select(F.concat(F.lit("q"), k).alias("slug"), F.concat(F.when(_k() % 4 == 0, "Ana Maria ").otherwise("Ana "), _number()).alias("name"), slug.alias("canonical"))
    forms = [("unit-a", F.concat(F.lit("Ana M. "), _number()), _k() % 2 == 0), ("unit-b", F.concat(F.lit("Ana Maria Costa "), _number()), _k() % 3 == 0), ("unit-c", F.concat(F.lit("Maria Ana "), _number()), _k() % 3 < 2)]
    listed = c.select(slug.alias("slug"), F.explode(F.filter(F.array(*[F.when(on, F.struct(F.lit(label).alias("label"), form.alias("form"))) for label, form, on in forms]), lambda x: x.isNotNull())).alias("f")).select("slug", "f.label", "f.form")
    got = review.wider_minimal_evidence(rows.unionByName(rows.withColumn("second_pass", F.lit(False)).withColumn("handle", F.lit(-1).cast("long"))), wider, listed)
    return got.withColumn("corroborated_by", F.concat("corroborated_by.label", F.lit(": "), "corroborated_by.form"))


@register("build_report", "thesis_people", """SELECT CASE WHEN g = 0 THEN 'role and tier' WHEN g = 1 THEN 'role' WHEN g = 2 THEN 'tier' ELSE 'all' END AS section, concat_ws(' ', role, match_status) AS value, n, names FROM (SELECT role, match_status, count(*) AS n, count(DISTINCT name_raw) AS names, grouping(role, match_status) AS g FROM thesis_people GROUP BY GROUPING SETS ((role), (match_status), (role, match_status), ()))
  UNION ALL SELECT 'set', source, count(DISTINCT doc_id), NULL FROM documents GROUP BY source""")
def build_report(r: Roles) -> DataFrame:
    return review.build_report(r.thesis_people, r.table("documents").select(F.col("doc_id").alias("handle"), F.col("source").alias("label")))
