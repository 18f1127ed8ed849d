"""A harvest run against the row-by-row rule it stands for, and the cases at its edges."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import harvest

PERSON = "struct<slug:string,name:string>"
PAGE = f"struct<scope:string,synopsis:string,funding_raw:string,partners_raw:string,keywords_raw:string,total_budget_raw:string,own_budget_raw:string,start_date_raw:string,end_date_raw:string,coordinator:{PERSON},researchers:array<{PERSON}>,keywords:array<string>>"
LISTING = "seq long, title string, url string, details string, scope string"
FETCHED = f"seq long, http_status int, error string, page {PAGE}"
STORED = "title_norm string, title string, slug string, synopsis string, total_budget_amount double, detail_fetched boolean, detail_unavailable_reason string, first_seen_at string, last_scraped_at string, note string"


def page(synopsis=None, lead=None, team=(), words=(), budget=None):
    return (None, synopsis, None, None, None, budget, None, None, None, lead, None if team is None else list(team), None if words is None else list(words))


def run(spark, listing, fetched):
    return harvest.outcomes(spark.createDataFrame(listing, LISTING), spark.createDataFrame(fetched, FETCHED), "https://s/projects/").cache()


def slowly(listing, fetched, stored, people):
    """Row by row in order, as a harvester with a cursor would write."""
    got, table, kids = {f[0]: f for f in fetched}, {s["title_norm"]: dict(s) for s in stored}, dict(people)
    for seq, title, url, _, _ in sorted(listing):
        stub = not url or url.rstrip("/") == "https://s/projects"
        if title is None or (not stub and seq not in got):
            continue
        key = " ".join(title.split()).casefold()
        row = table.setdefault(key, dict.fromkeys(["synopsis", "total_budget_amount", "note"]) | {"title_norm": key, "first_seen_at": "now"})
        _, _, error, p = got.get(seq, (None,) * 4)
        p = None if stub else p
        row.update(title=title, last_scraped_at="now", detail_fetched=p is not None, slug=None if stub else url.rstrip("/").rsplit("/", 1)[-1])
        row["detail_unavailable_reason"] = harvest.NO_PAGE if stub else None if p else f"fetch failed: {error}"
        if p:
            row.update(synopsis=p[1], total_budget_amount=float(p[5].split()[0]) if p[5] else None)
            kids[key] = ([(p[9][0], "coordinator", 0)] if p[9] else []) + [(x[0], "researcher", i) for i, x in enumerate(p[10] or [])]
    return table, kids


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_run_equals_its_rows_one_by_one(spark, seed):
    rnd = random.Random(seed)
    titles = ["Alpha", " ALPHA ", "Beta  x", "beta x", "Gamma", "Delta", None]
    listing, fetched = [], []
    for seq in range(40):
        listing.append((seq, rnd.choice(titles), rnd.choice([None, "", "https://s/projects", f"https://s/p/{seq}/", f"https://s/p/{seq}"]), "d", None))
        kind = rnd.random()
        if kind < 0.4:
            who = [(f"p{rnd.randrange(5)}", "n") for _ in range(rnd.randrange(3))]
            fetched.append((seq, 200, None, page(rnd.choice([None, f"s{seq}"]), rnd.choice([None, ("lead", "L")]), rnd.choice([None, who]), budget=rnd.choice([None, f"{seq} EUR"]))))
        elif kind < 0.7:
            fetched.append((seq, 500, "status 500", None))
    old = [("alpha", "Alpha", "a", "old", 1.0, True, None, "then", "then", "kept"), ("omega", "Omega", "o", "old", 2.0, True, None, None, "then", "kept")]
    names = [c.split()[0] for c in STORED.split(", ")]
    kids = {"alpha": [("x", "coordinator", 0)], "omega": [("y", "researcher", 0)]}
    table, people = slowly(listing, fetched, [dict(zip(names, x)) for x in old], kids)
    done = run(spark, listing, fetched)
    got = {r.title_norm: r.asDict() for r in harvest.projects(done, spark.createDataFrame(old, STORED), F.lit("now")).collect()}
    assert got == table
    stored = spark.createDataFrame([(k, *x) for k, v in kids.items() for x in v], "title_norm string, slug string, role string, ordinal int")
    found = sorted(tuple(r) for r in harvest.children(done, stored, harvest.team(F.col("page"))).collect())
    assert found == sorted((k, *x) for k, v in people.items() for x in v)
    n = harvest.run_figures(done).first()
    assert n.listing_rows == 40 == n.detail_ok + n.detail_failed + n.stubs + n.pending and harvest.targets(done).count() == 40


def test_what_each_outcome_leaves_alone(spark):
    listing = [(1, "A", "https://s/p/1", None, None), (2, "B", None, None, None), (3, "C", "https://s/p/3", None, None), (4, "D", "https://s/p/4", None, None), (5, None, "https://s/p/5", None, None)]
    fetched = [(1, 500, None, None), (3, 200, None, page(words=None, team=None)), (5, 200, None, page(words=["w"])), (9, 200, None, page(words=["w"]))]
    done = run(spark, listing, fetched)
    assert {r.seq: (r.status, r.http_status) for r in done.collect()} == {1: ("http_error", 500), 2: ("no_detail_url", None), 3: ("ok", 200), 4: ("pending", None), 5: ("ok", 200)}
    stored = spark.createDataFrame([(k, "old", 0) for k in "abcd"], "title_norm string, keyword string, ordinal int")
    after = harvest.children(done, stored, harvest.numbered(F.col("page.keywords"), "keyword"))
    assert sorted(r.title_norm for r in after.collect()) == ["a", "b", "d"]  # c was read and has none now
    rows = [(k, k.upper(), k, "old", 1.0, True, None, None, "then", "kept") for k in "abcd"]
    got = {r.title_norm: r for r in harvest.projects(done, spark.createDataFrame(rows, STORED), F.lit("now")).collect()}
    assert set(got) == set("abcd") and all(r.note == "kept" and r.first_seen_at is None for r in got.values())
    assert [got[k].synopsis for k in "abcd"] == ["old", "old", None, "old"] and [got[k].last_scraped_at for k in "abcd"] == ["now", "now", "now", "then"]
    assert got["a"].detail_unavailable_reason == "fetch failed: unknown" and got["b"].slug is None and got["d"].slug == "d"


def test_last_page_names_a_person(spark):
    listing = [(i, f"T{i}", f"https://s/p/{i}", None, None) for i in range(3)]
    fetched = [(0, 200, None, page(lead=("a", "Old A"), team=[("b", "B")])), (1, 200, None, page(team=[("a", "A"), ("c", "C")])), (2, 404, "gone", None)]
    got = harvest.named_people(run(spark, listing, fetched), spark.createDataFrame([("b", "Stored B"), ("z", "Z")], "slug string, name string"))
    assert {r.slug: r.name for r in got.collect()} == {"a": "A", "b": "B", "c": "C", "z": "Z"}


def test_empty_run(spark):
    done = run(spark, [], [])
    old = spark.createDataFrame([("a", "A", "a", "s", 1.0, True, None, "t", "t", "n")], STORED)
    assert [tuple(r) for r in harvest.projects(done, old, F.lit("now")).collect()] == [tuple(r) for r in old.collect()]
    assert harvest.run_figures(done).first().listing_rows == 0
