"""The routes and tools over the smallest tables: defaults, filters, refusals."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodestar.api import Api, NotFound
from lodestar.operators import composites, relational, validate
from lodestar.sources.roles import Roles

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def api(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return Api(Roles(spark, DATA))


def test_limits_are_refused_not_clipped(api):
    for call in (lambda: api.projects(limit=0), lambda: api.projects(limit=501), lambda: api.bibliography(limit=201), lambda: api.list_theses(limit=0), lambda: api.edges("friends"), lambda: api.collab_pairs(sort="name")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(NotFound):
        api.top_projects("XXX")


def test_theses_of_a_year_and_a_group(api):
    every = api.list_theses(limit=500).collect()
    assert len(every) == min(500, api.r.theses.count()) and {r.tier for r in every} <= {"people-only", "unattributed"}
    group = next(r.groups[0] for r in every if r.groups)
    found = api.list_theses(group=group, limit=3, total=True).collect()
    assert 0 < len(found) <= 3 and all(group in r.groups for r in found) and found[0].total == sum(group in (r.groups or []) for r in api.list_theses(group=group, limit=500).collect())
    both = api.list_theses(year=found[0].year, group=group, limit=500).collect()
    assert both and all(r.year == found[0].year and group in r.groups for r in both)
    assert not api.list_theses(group="nowhere").collect()


def test_keywords_of_a_person_count_aliases(api):
    r = api.r
    words = r.partners.select("project_id", F.col("partner_name").alias("keyword"))
    got = api.person_keywords(8, words).collect()  # 9 is an alias of 8
    mine = r.project_people.where("person_slug in (8, 9)").select("project_id").distinct().join(words, "project_id").groupBy("keyword").agg(F.countDistinct("project_id").alias("n"))
    assert {x.keyword: x.n for x in got} == {x.keyword: x.n for x in mine.collect()} and got
    assert [(-x.n, x.keyword) for x in got] == sorted((-x.n, x.keyword) for x in got)
    assert not api.person_keywords(9, words).collect()


def test_coverage_of_identities(api):
    got = {(r.section, r.name, r.measure): r.value for r in api.identity_coverage().collect()}
    assert got["edges", "all", "resolved_own"] + got["edges", "all", "resolved_listed"] == got["edges", "all", "resolved"] <= got["edges", "all", "total"]
    assert got["theses", "all", "fully_resolved"] <= got["theses", "all", "with_resolved"] <= got["theses", "all", "with_supervisor"] <= got["theses", "all", "total"]


def test_funders_have_one_spelling(spark):
    rows = [(i, s, True) for i, s in enumerate(["FCT", *relational.FCT_SPELLINGS, "FCT and DAAD", None])]
    roles = SimpleNamespace(projects=spark.createDataFrame(rows, "project_id long, funding_raw string, detail_fetched boolean"))
    assert {r.funder: r.project_count for r in Api(roles).funding().collect()} == {"FCT": 1 + len(set(relational.FCT_SPELLINGS)), "FCT and DAAD": 1, relational.NO_FUNDING: 1}


def test_authors_of_two_theses(spark):
    rows = [("h1", "a"), ("h2", "a"), ("h3", "b"), ("h4", "b"), ("h5", "c"), ("h5", "c"), ("h6", "d"), ("h7", "e"), ("h8", "e"), ("h9", None), ("h10", None)]
    people = spark.createDataFrame([(h, "author", p) for h, p in rows] + [("h6", "supervisor", "a")], "handle string, role string, person_slug string")
    exempt = spark.createDataFrame([("b", "h3"), ("b", "h4"), ("b", "h4"), ("c", "h5"), ("e", "h7")], "person_slug string, handle string")
    assert sorted(r.subject for r in validate.author_problems(people, exempt).collect()) == ["a", "c", "e"]


def test_verdicts_of_empty_tables(spark):
    none = spark.createDataFrame([], "a string, b string, verdict string, canonical string, evidence string")
    names, authors, copies = (spark.createDataFrame([], s) for s in ("slug string, full_name string", "slug string, handles array<string>", "duplicate_handle string"))
    assert composites.verdict_rows(none, names, authors, copies).count() == 0
    one = spark.createDataFrame([("x", "y", "same", "x", "met them")], none.schema)
    assert {tuple(r) for r in composites.verdict_rows(one, names, authors, copies).collect()} == {("alias", "y", "x"), ("evidence", "y", "met them"), ("reviewed", "x", "y")}
