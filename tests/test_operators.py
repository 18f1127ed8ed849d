"""The portfolio fixture: three projects, two groups, four people, five theses, one for each attribution tier."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import affinity, bibliography, graph, helpers, identity, relational, validate, vectors, writes


@pytest.fixture(scope="module")
def f(spark):
    d = spark.createDataFrame
    return {
        "groups": d([("NCS", "Networks"), ("AC", "Automation")], "code string, name string"),
        "projects": d([(1, "Alpha", 1000.0, "2020-01-01", "FCT", True, None, "s"), (2, "Beta", 500.0, "2021-06-01", "Fund A", True, None, "s"), (3, "Gamma", None, None, None, False, "no page", None)], "project_id long, title string, budget double, start_date string, funding_raw string, detail_fetched boolean, unavailable_reason string, synopsis string"),
        "project_groups": d([(1, "NCS"), (1, "AC"), (2, "NCS")], "project_id long, group_code string"),
        "people": d([("ada", "Ada Lovelace"), ("alan", "Alan Turing"), ("grace", "Grace Hopper"), ("grace-1", "Grace Hopper")], "slug string, name string"),
        "aliases": d([], "from_slug string, to_slug string"),
        "project_people": d([(1, "ada", "coordinator"), (1, "alan", "researcher"), (2, "ada", "coordinator"), (2, "ada", "researcher")], "project_id long, person_slug string, role string"),
        "theses": d([(f"h{i}", f"T{i}", "2020", i in (1, 3)) for i in range(1, 6)], "handle string, title string, year string, full_text boolean"),
        "thesis_people": d(
            [
                ("h1", "Author, Ada Unresolved", "author", None, "unmatched"), ("h1", "Lovelace, Ada", "supervisor", "ada", "exact"), ("h1", "Hopper, Grace", "supervisor", "grace", "exact"),
                ("h2", "Turing, Alan", "author", "alan", "exact"), ("h3", "Nobody, At All", "author", None, "unmatched"), ("h3", "Ambiguous, Two People", "supervisor", None, "ambiguous"),
                ("h4", "Lovelace, Ada", "supervisor", "ada", "exact"), ("h5", "Nobody, Here Either", "author", None, "unmatched"),
            ],
            "handle string, name_raw string, role string, person_slug string, match_status string",
        ),
        "listings": d([], "person_slug string, source string"),
        "affinity": d([("h1", "NCS", 0.3), ("h1", "AC", 0.1), ("h2", "NCS", 0.4), ("h2", "AC", 0.05), ("h3", "AC", 0.25), ("h3", "NCS", 0.05)], "handle string, group_code string, content_share double"),
    }


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_groups_and_budgets(f):
    assert rows(relational.projects_per_group(f["groups"], f["project_groups"]), "code", "project_count") == [("AC", 1), ("NCS", 2)]
    assert rows(relational.budget_by_group(f["projects"], f["groups"], f["project_groups"]), "code", "total_budget") == [("AC", 1000.0), ("NCS", 1500.0)]
    assert rows(relational.budget_by_year(f["projects"]), "year", "total_budget") == [("2020", 1000.0), ("2021", 500.0)]


def test_funding_spellings(f):
    assert rows(relational.funding_breakdown(f["projects"], {"Fund A": "FCT"}), "funder", "project_count") == [("FCT", 2)]


def test_coordinators_and_shares(f):
    got = rows(relational.top_coordinators(f["project_people"], f["people"], f["aliases"], f["project_groups"]), "person_slug", "project_count", "group_code", "group_project_count")
    assert got == [("ada", 2, "AC", 1), ("ada", 2, "NCS", 2)]
    got = rows(relational.person_group_shares(f["project_people"], f["project_groups"]), "person_slug", "group_code", "weight")
    assert got == [("ada", "AC", 1.0), ("ada", "NCS", 2.0), ("alan", "AC", 0.4), ("alan", "NCS", 0.4)]


def test_attribution_coverage(f):
    r = relational.attribution_coverage(f["thesis_people"], f["listings"], f["theses"]).first()
    assert (r.author_names, r.author_names_resolved, r.supervisor_names, r.supervisor_names_resolved) == (4, 1, 3, 2)
    assert (r.edges, r.edges_resolved, r.edges_own, r.edges_uc) == (4, 3, 3, 0)
    assert (r.touching_theses, r.touching_edges, r.touching_resolved, r.theses_total) == (3, 3, 3, 5)
    assert (r.theses_with_supervisor, r.theses_with_resolved, r.theses_fully_resolved, r.pairs, r.pairs_resolved, r.supervisor_people) == (3, 2, 2, 1, 1, 2)


def test_graph(f, spark):
    e = graph.co_project_edges(f["project_people"], f["aliases"])
    assert rows(e, "person_a", "person_b", "weight", "weight_normalized") == [("ada", "alan", 1, 1.0)]
    s = graph.co_supervision_edges(f["thesis_people"], f["aliases"])
    assert rows(s, "person_a", "person_b", "weight") == [("ada", "grace", 1)]
    g = graph.person_groups(f["project_people"], f["project_groups"], f["aliases"])
    assert rows(graph.enriched(e, f["people"], g), "cross_group") == [(False,)]
    assert rows(graph.enriched(s, f["people"], g), "cross_group") == [(None,)]
    # an alias on the same project: one edge, the team as published
    more = f["project_people"].unionByName(spark.createDataFrame([(1, "alan-1", "researcher")], f["project_people"].schema))
    alias = spark.createDataFrame([("alan-1", "alan")], "from_slug string, to_slug string")
    assert rows(graph.co_project_edges(more, alias), "person_a", "person_b", "weight", "weight_normalized") == [("ada", "alan", 1, 0.5)]


def test_tiers(f):
    shares = relational.person_group_shares(f["project_people"], f["project_groups"])
    content = affinity.normalised(f["affinity"].withColumnRenamed("content_share", "x"), "handle", "x", "content_share")
    got = affinity.agreement(f["theses"], affinity.people_signal(f["thesis_people"], shares), content)
    tiers = dict(rows(got, "handle", "tier"))
    assert tiers == {"h1": "corroborated", "h2": "contested", "h3": "content-only", "h4": "people-only", "h5": "unattributed"}
    assert all(n == 1 for _, n in rows(affinity.tier_counts(got), "tier", "theses"))


def test_tfidf(spark):
    d = affinity.term_counts(spark.createDataFrame([("d1", "net net sec"), ("d2", "net")], "handle string, t string"), "handle", [(F.col("t"), 1)])
    g = affinity.term_counts(spark.createDataFrame([("g", "net sec")], "group_code string, t string"), "group_code", [(F.col("t"), 1)])
    assert rows(affinity.affinity(d, g, 2), "handle", "score") == [("d1", 0.966501), ("d2", 0.579739)]


def test_names(spark):
    pool = spark.createDataFrame(
        [(s, n, "x", s) for s, n in [("ada", "Ada Lovelace"), ("alan", "Alan Turing"), ("g-hopper", "G. Hopper"), ("grace-h", "Grace Hopper"), ("grace-h-1", "Grace Hopper"), ("noether", "Emmy Noether"), ("noether-b", "Bernhard Noether"), ("proenca", "Ana Proença")]],
        "slug string, name string, source string, canonical string",
    )
    want = {"Lovelace, Ada": ("exact", ["ada"]), "Turing, Alan Mathison": ("confident", ["alan"]), "Proença, Ana Maria": ("confident", ["proenca"]), "Noether, Emmy": ("exact", ["noether"]), "Hopper, Grace": ("ambiguous", []), "Unknown, Nobody At All": ("unmatched", [])}
    names = spark.createDataFrame([(n,) for n in want], "name_raw string")
    assert {r.name_raw: (r.status, r.slugs) for r in identity.match_names(names, pool).collect()} == want
    two = pool.where("slug in ('grace-h', 'grace-h-1')")
    assert identity.match_names(spark.createDataFrame([("Hopper, Grace",)], "name_raw string"), two).first().slugs == ["grace-h", "grace-h-1"]
    veto = spark.createDataFrame([("grace-h", "grace-h-1")], "a string, b string")
    assert identity.match_names(spark.createDataFrame([("Hopper, Grace",)], "name_raw string"), two, distinct_pairs=veto).first().status == "ambiguous"


def test_validators(spark, f):
    pairs = spark.createDataFrame([("ada", "ada", "distinct", None), ("ada", "zoe", "same", "bob"), ("alan", "grace", "same", "alan"), ("grace", "alan", "distinct", None)], "a string, b string, verdict string, canonical string")
    rules = {r.rule for r in validate.alias_problems(pairs, f["people"]).collect()}
    assert rules == {"self", "unknown", "canonical", "repeated"}
    with pytest.raises(ValueError):
        validate.raise_if_any(validate.alias_problems(pairs, f["people"]))


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k long, v string, first_seen_at string")
    new = spark.createDataFrame([(2, None, "t1"), (3, "c", "t1")], "k long, v string, first_seen_at string")
    assert rows(writes.upsert(old, new, ["k"], ("first_seen_at",)), "k", "v", "first_seen_at") == [(1, "a", "t0"), (2, None, "t0"), (3, "c", "t1")]


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5):
        writes.replace_table(spark.range(n), path)
        assert spark.read.parquet(path).count() == n


def test_replacement_that_ended_between_its_renames(spark, tmp_path):
    path = str(tmp_path / "t")
    writes.replace_table(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert writes.recover(spark, path) and spark.read.parquet(path).count() == 3
    (tmp_path / "t").rename(tmp_path / "t.old")
    writes.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.old").exists()
    problems = spark.createDataFrame([("unknown", "x")], "rule string, subject string")
    with pytest.raises(ValueError):
        writes.replace_curated(spark.range(1), problems, path)
    assert spark.read.parquet(path).count() == 5
    writes.replace_curated(spark.range(1), problems.limit(0), path)
    assert spark.read.parquet(path).count() == 1


def test_pool_of_listed_people(spark):
    listings = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "person_slug long, source string")
    people = spark.createDataFrame([(1, "Ana"), (2, "Rui"), (3, "Eva")], "slug long, name string")
    aliases = spark.createDataFrame([(2, 1)], "from_slug long, to_slug long")
    assert rows(identity.pool_of(listings, people, aliases), "slug", "name", "source", "canonical") == [(1, "Ana", "a", 1), (2, "Rui", "c", 1)]


def test_nearest_of_many_queries(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8)).round(3)
    x[7] = x[9]  # a tie goes by key
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)] + [(999, None)], "ordinal long, embedding array<double>")
    got = {(g.query, g["rank"]): g.ordinal for g in vectors.nearest_all(df, df.where("ordinal % 10 = 0 or ordinal = 999"), 5, block=4).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 300, 10):
        d = np.round(1 - u @ u[i], 12)
        assert [got[i, k + 1] for k in range(5)] == sorted(range(300), key=lambda j: (d[j], j))[:5]
    assert len(got) == 150
    assert vectors.nearest_all(df, df.limit(0), 5).count() == 0


def test_nearest_rank(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3)], "k long, v double")
    r = helpers.nearest_rank(df, ["k"], "v", [50, 95]).first()
    assert (r.p50, r.p95) == (2.0, 3.0)


def test_escaped_search(spark):
    refs = spark.createDataFrame([(1, "plain", "doi", 2), (4, "100% sure", "unmatched", 2)], "reference_id long, display string, match_tier string, cited_by long")
    assert rows(relational.references_page(refs, term="%"), "reference_id") == [(4,)]


def test_truncated_dois(spark):
    d = ["10.1145/19657", "10.1145/1965724", "10.1145/1965724.1965742", "10.1145/1965724.99", "10.1109/32.666826"]
    got = {r[0] for r in bibliography.drop_truncated(spark.createDataFrame([(x,) for x in d], "doi string")).collect()}
    assert got == {x for x in d if not any(y != x and y.startswith(x) for y in d)}
    # many of one publisher, cut at every length: ranges end between a prefix and what it begins
    many = sorted({f"10.1016/j.x{i * 7919 % 10007}"[: 12 + i % 6] for i in range(9000)})
    got = {r[0] for r in bibliography.drop_truncated(spark.createDataFrame([(x,) for x in [*many, None]], "doi string"), range_rows=200).collect()}
    assert got == {x for x, y in zip(many, [*many[1:], ""]) if not y.startswith(x)}
    assert bibliography.drop_truncated(spark.createDataFrame([(None,)], "doi string")).count() == 0


def test_ranges_of_keys(spark):
    """A row's range is the number of bounds that it reaches, whatever the number of ranges; equal keys share one."""
    for n, size in ((3000, 100), (500, 250), (64, 1), (7, 100)):
        d = spark.createDataFrame([((i * 7919 % 30011) // 3,) for i in range(n)], "k long")
        got = sorted((r.k, r._b) for r in bibliography.ranged(d, F.col("k"), size).collect())
        assert len(got) == n and [b for _, b in got] == sorted(b for _, b in got)
        assert len({k for k, _ in got}) == len(set(got)) and max(b for _, b in got) <= -(-n // size)
        if n == 3000:
            assert len({b for _, b in got}) > 25


def test_numbered_works(spark):
    works = [(f"title:{i * 7919 % 30011:05d}", 1 + (i % 97 == 0)) for i in range(9000)]
    got = bibliography.numbered(spark.createDataFrame(works, "work_key string, cited_by long"), range_rows=100).collect()
    assert [(x.work_key, x.cited_by) for x in sorted(got, key=lambda x: x.reference_id)] == sorted(works, key=lambda x: (-x[1], x[0]))
    assert sorted(x.reference_id for x in got) == list(range(1, 9001))
    assert bibliography.numbered(spark.createDataFrame([], "work_key string, cited_by long")).count() == 0


def test_references(spark):
    body = "Intro\n\n# References\n" + "\n".join(f"[{i}] A. Turing, \"On computable things number {i}\", Journal, 19{30 + i}. doi 10.1000/abc{i}." for i in range(1, 8))
    got = bibliography.parse_references(spark.createDataFrame([("a", body), ("b", "no list here"), ("c", None)], "slug string, text string")).collect()
    assert len(got) == 7
    assert {r.style for r in got} == {"bracketed"}
    assert got[0].doi == "10.1000/abc1" and got[0].year == "1931" and got[0].first_author == "Turing"


def test_lists_of_references():
    prose = ["Words of a chapter that cites nothing at all"] * 40
    named = [f"Zhang, Y. and J. Jiang (199{i}). A study of measure number {i}. Journal of Measures." for i in range(9)]
    # a running head inside a list, a second list after other text, and a heading with page numbers
    doc = [*prose, "12 References 7", *named[:5], "References", *named[5:], *prose, *prose, "Bibliografia:", *[f"[{i}] M. Rossi, “On the shape of small things {i}”, vol. 3, 188{i}." for i in range(8)]]
    got = bibliography.references("\n".join(doc))
    assert [k for k, _ in got] == ["authoryear"] * 9 + ["bracketed"] * 8
    # the running head is a line of the entry before it
    assert got[4][1] == named[4] + " References"
    assert bibliography.references("\n".join(prose)) == []
    # a heading without a list behind it is none
    assert bibliography.references("\n".join([*prose, "References", *prose])) == []
    # no heading: twenty starts near the end are a list, nineteen are none
    late = [f"{i}. A. Author, On things that are many, Journal of Many Things, {1950 + i}." for i in range(1, 21)]
    assert len(bibliography.references("\n".join([*prose, *late]))) == 20
    assert bibliography.references("\n".join([*prose, *late[1:]])) == []
    # entries without marks are parted by blank lines
    plain = [f"the collected letters, volume {i}, edited for the society, {1900 + i}" for i in range(6)]
    assert bibliography.references("References\n\n" + "\n\n".join(plain)) == [("blankline", x) for x in plain]


def test_fields_of_references():
    cases = [
        ("[3] L. A. Meserve, \"An unquoted world of titles\", Proc. X, 1999.", ("An unquoted world of titles", "1999", "Meserve", None)),
        ("Zhang, Y. and J. Jiang (2001a). Bibliographical review of control. Annual Reviews, 32(2).", ("Bibliographical review of control", "2001", "Zhang", None)),
        ("7) João Carreira, Henrique Madeira. Software fault injection in practice. IEEE Trans. 24, 125-136, 1998. doi:10.1109/32.666826.", ("Software fault injection in practice", "1998", "Carreira", "10.1109/32.666826")),
        ("Smith, short. 10.1007/978- then 10.1145/abcde", (None, None, "Smith", None)),
        ("Smith, J. 10.1016/j. then 10.1145/abcde.", (None, None, "Smith", "10.1145/abcde")),
    ]
    for entry, (title, year, author, doi) in cases:
        assert bibliography.parse_entry(entry) == {"title": title, "year": year, "first_author": author, "doi": doi}, entry
    assert bibliography.display_form(" [Gamma 94]  Design   patterns ") == "Design patterns"


def test_vectors(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(200)] + [(999, None)], "ordinal long, embedding array<float>").repartition(5)
    q = x[:2] + 0.01
    cos = 1 - (x @ q.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1))
    got = {(g.query, g["rank"]): g.ordinal for g in vectors.nearest(df, q.tolist(), 5).collect()}
    for i in range(2):
        assert [got[i, k + 1] for k in range(5)] == np.argsort(cos[:, i])[:5].tolist()
    m = vectors.multi_facet(df, q.tolist(), 50).collect()
    assert len(m) == 18
    assert sorted(g.ordinal for g in m) == sorted(np.argsort(cos.min(axis=1))[:18].tolist())


def test_possible_duplicates_compare_given_names(spark):
    names = ["Ana Maria Silva", "Maria Silva", "A. Silva", "Ana Silva", "Silva", "silva", "Rui Silva", "Ána Maria SILVA"]
    found = identity.possible_duplicates(spark.createDataFrame(list(enumerate(names)), "slug long, name string"))
    # 2 is within no other name; a name of one token is its own given name
    assert {(x.a, x.b) for x in found.collect()} == {(0, 3), (0, 7), (3, 7), (4, 5)}
    reviewed = spark.createDataFrame([(7, 0)], "a long, b long")
    again = identity.possible_duplicates(spark.createDataFrame(list(enumerate(names)), "slug long, name string"), reviewed)
    assert {(x.a, x.b) for x in again.collect()} == {(0, 3), (3, 7), (4, 5)}


def test_prose_tokens_fold_and_stop(spark):
    row = spark.createDataFrame([("Não há inteligência SEM a Optimização, the study of ﬁre e 3D nets",)], "t string")
    got = row.select(affinity.prose_tokens(F.col("t"), affinity.STOP_WORDS).alias("x")).first().x
    assert got == ["inteligencia", "sem", "optimizacao", "fire", "nets"]


def test_totals_of_chains_are_the_chains_added_up(spark, f):
    """Entries, roles, mentions, projects, theses and people that come twice, and a person without a thesis."""
    partners = spark.createDataFrame([(1, "P", "academic"), (1, "P", "academic"), (2, "P", "academic"), (2, "Q", "industry"), (3, "Q", "industry")], "project_id long, partner_name string, partner_type string")
    twice = [f["projects"].unionByName(f["projects"].where("project_id = 2").withColumn("title", F.lit("Aa"))), f["project_people"], f["people"].unionByName(f["people"].where("slug = 'ada'")), f["thesis_people"].unionByName(f["thesis_people"].where("handle = 'h4'")), f["theses"].unionByName(f["theses"].where("handle = 'h1'"))]
    keys = ["partner_name", "partner_type", "person_slug", "person_name", "handle", "thesis_role"]
    chains = relational.partner_thesis_links(partners, *twice).groupBy(*keys).agg(F.count("*").alias("paths"), F.countDistinct("project_id").alias("projects"), F.min("project_title").alias("first_project"))
    got = rows(relational.partner_thesis_totals(partners, *twice), *keys, "paths", "projects", "first_project")
    assert got == rows(chains, *keys, "paths", "projects", "first_project")
    assert ("P", "academic", "ada", "Ada Lovelace", "h4", "supervisor", 24, 2, "Aa") in got


def test_partner_thesis_links_makes_no_row_of_a_chain(spark, tmp_path):
    from lodestar.plans import catalogue

    spark.range(60).selectExpr("id as doc_id", "'t' as text", "'s' as source", "1L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(400).selectExpr("id % 7 as l_orderkey", "1L as l_partkey", "1L as l_suppkey", "cast(id as int) as l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select 1L as p_partkey, 'b' as p_brand, 'X' as p_type").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select 1L as s_suppkey, 'n' as s_name, 1L as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(7).selectExpr("id as o_orderkey", "1.0D as o_totalprice", "date'2020-01-01' as o_orderdate", "'F' as o_orderstatus", "'x' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    df = catalogue.QUERIES["partner_thesis_links"](spark, str(tmp_path))
    assert df.agg(F.sum("paths")).first()[0] > 5 * 400
    df = catalogue.QUERIES["partner_thesis_links"](spark, str(tmp_path))
    found = df.collect()
    plan, most = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        node = plan.pop()
        m = node.metrics().get("numOutputRows")
        most = max(most, m.get().value()) if m.isDefined() else most
        below = node.finalPhysicalPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else None
        plan += [below] if below is not None else [node.children().apply(i) for i in range(node.children().size())]
    assert found and most <= 400


def test_duplicates_without_a_successor_are_no_pairs(spark, tmp_path):
    from lodestar.plans import catalogue, more  # noqa: F401

    ids = [(0,), (1,), (2,), (6,), (7,), (7,), (10,), (None,)]
    spark.createDataFrame(ids, "doc_id long").withColumn("n_chars", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(catalogue.QUERIES["duplicate_validation"](spark, str(tmp_path)), "rule", "subject")
    assert got == [("differ", "0~1"), ("differ", "6~7"), ("missing", "1~-1"), ("missing", "7~-1"), ("missing", "7~-1")]


def test_duplicates_agree_in_every_row(spark):
    theses = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "b"), (4, None), (5, None)], "handle long, title string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 3), (4, 5), (4, 9)], "duplicate_handle long, kept_handle long")
    assert rows(validate.duplicate_thesis_problems(pairs, theses, ["title"]), "rule", "subject") == [("differ", "1~3"), ("differ", "3~3"), ("missing", "4~9")]


def test_possible_duplicates_meet_in_blocks_and_cells(spark, monkeypatch):
    monkeypatch.setattr(identity, "BLOCK", 2)
    monkeypatch.setattr(identity, "CELL", 2)
    monkeypatch.setattr(identity, "PAIRS_OF_A_TASK", 5)
    given = ["Rui", "Rui Ana", "R.", "Ana Rui", "Rui R."]
    people = [(i, f"{given[i % 5]} Silva{i % 2}") for i in range(60)]
    tokens = {i: n.lower().replace(".", "").split() for i, n in people}

    def fit(x, y):
        a, b = tokens[x], tokens[y]
        within = set(a) <= set(b) or set(b) <= set(a)
        return a[-1] == b[-1] and within and a[0][0] == b[0][0] and (a[0] == b[0] or 1 in (len(a[0]), len(b[0])))

    df = identity.possible_duplicates(spark.createDataFrame(people, "slug long, name string"))
    got = [(x.a, x.b) for x in df.collect()]
    assert sorted(got) == [(x, y) for x in range(60) for y in range(x + 1, 60) if fit(x, y)]
    assert df.rdd.getNumPartitions() > 50  # some 1,000 combinations in tasks of 5


def test_pairs_of_projects_are_dealt_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_OF_A_TASK", 10)
    members = [(p, s, "researcher") for p in range(20) for s in range(p % 6 + 1)]
    people, aliases = spark.createDataFrame(members, "project_id long, person_slug long, role string"), spark.createDataFrame([(3, 2)], "from_slug long, to_slug long")
    m = graph.spread(people, "project_id")
    assert m.rdd.getNumPartitions() == 1 + sum((p % 6 + 1) * (p % 6) // 2 for p in range(20)) // 10
    want = {}
    for p in range(20):
        team = {2 if s == 3 else s for s in range(p % 6 + 1)}
        for x in team:
            for y in team:
                if x < y:
                    n, w = want.get((x, y), (0, 0.0))
                    want[x, y] = n + 1, w + 1 / (p % 6)
    got = {(x.person_a, x.person_b): (x.weight, x.weight_normalized) for x in graph.co_project_edges(people, aliases).collect()}
    assert got == {k: (n, round(w, 3)) for k, (n, w) in want.items()}


def test_affinity_of_rare_terms_and_many_groups(spark, monkeypatch):
    """Terms that few documents have are joined, groups come in portions, a bag is counted in its row: the same scores."""
    docs = spark.createDataFrame([(i, f"g{i % 5}" if i % 7 else None, " ".join(f"w{(i * k) % 11}x" for k in range(i % 9))) for i in range(40)], "handle long, group_code string, t string")

    def scores(once):
        counts = affinity.term_counts(docs, ["handle", "group_code"], [(F.col("t"), 2), (F.col("t"), 1)], once=once)
        assert {tuple(r) for r in counts.collect()} == {tuple(r) for r in affinity.term_counts(docs, ["handle", "group_code"], [(F.col("t"), 3)]).collect()}
        return rows(affinity.affinity(affinity.bags_of(counts, "handle"), affinity.bags_of(counts, "group_code"), 40), "handle", "group_code", "score", "affinity_rank")

    want = scores(False)
    assert len(want) > 100 and any(x[1] is None for x in want)
    monkeypatch.setattr(affinity, "COMMON_TERMS", 3)
    monkeypatch.setattr(affinity, "GROUPS_AT_ONCE", 2)
    assert scores(True) == want
