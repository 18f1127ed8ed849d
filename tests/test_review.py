"""Reports on unresolved names against plain loops over all pairs."""

import hashlib
import random
from collections import Counter

import pytest

from lodestar.functions.text import name_tokens, split_name
from lodestar.operators import identity, review

FIRST, LAST = ["Ana", "Rui", "Maria", "João", "M.", "Zé", "Inês"], ["Silva", "Costa", "Sá", "Melo", "Águas"]


def initial_of(t, names):
    return len(t) == 1 and any(n.startswith(t) for n in names)


def slow(name, pool):
    """The shapes of each row of the pool for one name."""
    surname, given = split_name(name)
    every, out = [*surname, *given], []
    if not surname:
        return out
    for slug, cand, source in pool:
        tokens = name_tokens(cand)
        bears = all(t in tokens for t in surname)
        explained = all(t in every or initial_of(t, given) for t in tokens)
        fits = bears and explained
        superset = bears and not fits and all(t in tokens for t in every)
        carries = bool(given) and (given[0] in tokens or any(len(t) == 1 and given[0].startswith(t) for t in tokens))
        loose = len(given) > 1 and not bears and carries and any(t in tokens for t in given[1:])
        if bears or loose:
            out.append((name, slug, cand, source, fits, superset, bears, loose, loose and explained))
    return out


@pytest.fixture(scope="module")
def world(spark):
    r = random.Random(6)

    def person(n, m):
        return " ".join([*(r.choice(FIRST) for _ in range(n)), *(r.choice(LAST) for _ in range(m))])

    pool = [(f"p{i}", person(r.randrange(1, 4), r.randrange(0, 3)), r.choice("ab")) for i in range(150)] + [("p0", "Ana Silva", "b"), ("px", "", "a")]
    names = [f"{r.choice(LAST)}{r.choice(['', ' ' + r.choice(LAST)])}, {person(r.randrange(0, 4), r.randrange(0, 2))}" for _ in range(60)] + ["Nobody, Ana", ", Ana", "", "Ana Silva", "de, Ana"]
    edges = [(i % 97, n) for i, n in enumerate(names + names[:30] + names[:10])]
    return pool, names, edges, spark.createDataFrame(pool, "slug string, name string, source string"), spark.createDataFrame(edges, "handle long, name_raw string")


def test_misses_match_all_pairs(spark, world):
    pool, names, _, pdf, edf = world
    got = Counter((x.name_raw, x.slug, x.name, x.source, x.fits, x.superset, x.bearing, x.loose, x.tight) for x in review.misses(edf, pdf).collect())
    assert got == Counter(row for n in set(names) for row in slow(n, pool))
    assert all(sum(x[i] for x in got) > 3 for i in (4, 5, 6, 7, 8))


def test_audit_and_summary(spark, world):
    pool, names, edges, pdf, edf = world
    per = Counter(n for _, n in set(edges))
    singles = sorted((hashlib.sha256(f"20261018:{n}".encode()).hexdigest(), n) for n, k in per.items() if k < 2)
    drawn = {n for _, n in singles[:5]}
    a = review.audit(edf, pdf, cut=2, sample=5)
    rows = a.collect()
    assert len(rows) == len(per)
    for x in rows:
        near = slow(x.name_raw, pool)
        assert x.edges == per[x.name_raw] and x.review == ("cut" if x.edges >= 2 else "sample" if x.name_raw in drawn else None)
        for shape, i in (("superset", 5), ("bearing", 6), ("loose", 7), ("tight", 8)):
            assert {(y.name, y.source) for y in x[shape]} == {(y[2], y[3]) for y in near if y[i]}, x.name_raw
    s = review.audit_summary(a).first()
    flagged = [n for n in per if any(y[5] or y[8] for y in slow(n, pool))]
    assert (s.names, s.edges, s.flagged) == (len(per), sum(per.values()), len(flagged))
    assert s.flagged_above_cut == sum(per[n] >= 2 for n in flagged) and s.flagged_in_sample == len(drawn & set(flagged))
    assert s.without_bearing == sum(not any(y[6] for y in slow(n, pool)) for n in per) and s.not_sampled == len(singles) - 5
    again = {x.name_raw for x in review.audit(edf.repartition(7), pdf, cut=2, sample=5).where("review = 'sample'").collect()}
    assert again == drawn


def test_empty_pool_and_no_names(spark, world):
    *_, pdf, edf = world
    assert review.audit(edf, pdf.where("false")).where("flagged or size(bearing) > 0").count() == 0
    assert review.audit(edf.where("false"), pdf).count() == 0
    assert review.misses(edf.where("false"), pdf).count() == 0


def test_units_go_by_the_first_needle(spark):
    labels = ["FCTUC Ciências da Vida", "FCTUC - Física", "x CES x", "Faculdade de Economia", "none", None, "CES"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {x.label: x.unit for x in df.withColumn("unit", review.unit_of(df["label"])).collect()}
    assert got == {"FCTUC Ciências da Vida": "fctuc-dcv", "FCTUC - Física": "unharvested:FCTUC", "x CES x": "ces", "Faculdade de Economia": "feuc", "none": None, None: None, "CES": None}


@pytest.mark.parametrize("gap", [False, True])
def test_every_class_and_reason(spark, gap):
    """The ladder, rule by rule, with and without a unit that has no directory."""
    own = spark.createDataFrame([("o1", "Ana Rita Own", "own")], "slug string, name string, source string")
    wider = spark.createDataFrame([("w1", "Ana Rita Wider", "u"), ("w2", "Rui Bearer", "u"), ("w3", "Ana Pereira", "u")], "slug string, name string, source string")
    names = ["Own, Ana", "Wider, Ana", "Bearer, Ana", "Ended, Ana Pereira Z", "Old, Ana", "New, Ana", "Ended, Ana Maria Pereira", "Gap, Ana", "Lost, Ana", "Undated, Ana"]
    edges = spark.createDataFrame([(i, n) for i, n in enumerate(names)] + [(4, "Old, Ana")], "handle long, name_raw string")
    years = {4: "1999", 5: "2020", 7: "1999", 8: "2020", 9: None}
    theses = spark.createDataFrame([(i, years.get(i, "2000")) for i in range(10)], "handle long, year string")
    labels = {7: "no directory" if gap else "unit", 8: "else"}
    sets = spark.createDataFrame([(i, labels.get(i, "unit")) for i in range(10)], "handle long, label string")
    got = {x.name_raw: (x["class"], x.reason) for x in review.triage(edges, own, wider, theses, sets, [("unit", "u"), ("no dir", None)]).collect()}
    miss, rest = review.MISSED, "thesis-names-no-uc-faculty"
    assert got == {
        "Own, Ana": (miss, "shape-flag-own-pool"),
        "Wider, Ana": (miss, "shape-flag-wider-pool"),
        "Bearer, Ana": (miss, "surname-bearing-candidate-to-review"),
        "Ended, Ana Pereira Z": (miss, "shape-flag-wider-pool"),
        "Ended, Ana Maria Pereira": (miss, "shape-flag-wider-pool"),
        "Old, Ana": (miss, rest) if gap else (review.FORMER, review.FORMER),
        "New, Ana": (miss, rest) if gap else (review.NEVER, review.NEVER),
        "Undated, Ana": (miss, rest) if gap else (review.NEVER, review.NEVER),
        "Gap, Ana": (miss, "faculty-not-in-the-registry") if gap else (review.FORMER, review.FORMER),
        "Lost, Ana": (miss, rest),
    }


def test_report_counts_top_and_tail(spark):
    rows = [(f"n{i}", i % 4 + 1, review.MISSED if i % 2 else review.NEVER, "r" if i % 3 else "s") for i in range(30)]
    got = Counter(tuple(x) for x in review.triage_report(spark.createDataFrame(rows, "name_raw string, edges long, class string, reason string"), top=7).select("part", "class", "reason", "names", "edges").collect())
    top = {x[0] for x in sorted(rows, key=lambda x: (-x[1], x[0]))[:7]}
    want: dict = {}
    for n, e, c, r in rows:
        for key in (("top" if n in top else "tail", c, None), (None, None, r)):
            names, edges = want.get(key, (0, 0))
            want[key] = names + 1, edges + e
    assert got == Counter((*k, *v) for k, v in want.items())


def test_cross_fits_are_reported_with_their_status(spark):
    own = spark.createDataFrame([("o1", "Ana Maria Silva", "own", "o1"), ("o2", "Rui Melo", "own", "o2")], "slug string, name string, source string, canonical string")
    wider = spark.createDataFrame([("w1", "Ana Silva", "a", "w1"), ("w2", "Ana M. Silva", "b", "w2"), ("w3", "Rui Costa Melo", "a", "w3")], "slug string, name string, source string, canonical string")
    asked = spark.createDataFrame([("Silva, Ana Maria",), ("Melo, Rui",), ("Nobody, X",)], "name_raw string")
    got = [tuple(x) for x in review.cross_fits(identity.match_names(asked, own), wider).collect()]
    assert got == [("Silva, Ana Maria", ["o1"], ["w1", "w2"], "ambiguous")]


def test_build_report_reads_each_table_once(spark):
    people = spark.createDataFrame([(1, "a", "author", "exact"), (1, "b", "supervisor", "exact"), (2, "b", "supervisor", "unmatched"), (3, "b", "author", "exact")], "handle long, name_raw string, role string, match_status string")
    sets = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y")], "handle long, label string")
    df = review.build_report(people, sets)
    assert {tuple(x) for x in df.collect()} == {
        ("all", "", 4, 2), ("role", "author", 2, 2), ("role", "supervisor", 2, 1), ("tier", "exact", 3, 2), ("tier", "unmatched", 1, 1),
        ("role and tier", "author exact", 2, 2), ("role and tier", "supervisor exact", 1, 1), ("role and tier", "supervisor unmatched", 1, 1), ("set", "x", 2, None), ("set", "y", 1, None),
    }
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Scan") == 2


def test_cross_fits_work_out_each_step_once(spark, monkeypatch):
    """Names are parted in few places, whatever reads them; common tokens that nobody meets on are left out, others are not."""
    own = spark.createDataFrame([("o1", "Ana Maria Costa", "own", "o1"), ("o2", "Ana Maria Silva", "own", "o2")], "slug string, name string, source string, canonical string")
    wider = spark.createDataFrame([("w1", "Ana Costa", "a", "w1"), ("x1", "Ana Maria Costa", "b", "x1"), ("w2", "Ana Silva", "a", "w2")], "slug string, name string, source string, canonical string")
    names = spark.createDataFrame([("Costa, Ana Maria",), ("Silva, Ana Maria",), ("Reis, Ana",)], "name_raw string")
    apart = spark.createDataFrame([("x1", "w1")], "a string, b string")
    want = {("Costa, Ana Maria", ("o1",), ("w1", "x1"), "ambiguous"), ("Silva, Ana Maria", ("o2",), ("w2",), "confident")}
    for common in (review.COMMON, 1, 0):
        monkeypatch.setattr(review, "COMMON", common)
        got = review.cross_fits(identity.match_names(names, own), wider, apart)
        assert {(r.name_raw, tuple(r.slugs), tuple(r.wider_slugs), r.wider_status) for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 0
