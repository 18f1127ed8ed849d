"""Stores whose readers always find whole tables, re-indexing that survives a kill at any step; bodies and pages."""

import os

import pytest
from pyspark.sql import functions as F

from lodestar.api import Api
from lodestar.operators import affinity, helpers, versions
from lodestar.sources import markdown, state
from lodestar.sources.roles import Roles

DATA = "/root/testdata/sf0.001"


def docs(spark, texts):
    return spark.createDataFrame([(h, t) for h, t in texts.items()], "handle string, text string").withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))


def split(text):
    return F.split(F.coalesce(text, F.lit("")), " ")


def seen(store):
    d, c = store.read("documents"), store.read("chunks")
    if d is None:
        return {}
    held: dict = {}
    for x in c.collect():
        held.setdefault(x.handle, {})[x.ordinal] = x.chunk
    out = {x.handle: " ".join(held.get(x.handle, {})[i] for i in range(x.chunks)) for x in d.collect()}
    assert set(held) <= set(out) and all(len(held[h]) == len(out[h].split(" ")) for h in held)
    return out


def test_reindex_takes_up_what_changed(spark, tmp_path):
    store = versions.Store(spark, f"file://{tmp_path}/s", buckets=4)
    assert store.read("documents") is None and seen(store) == {}
    assert versions.reindex(store, docs(spark, {"a": "x y z", "b": "p"}), split) == 2
    assert versions.reindex(store, docs(spark, {"a": "x y z", "b": "p"}), split) == 0 and store.state()[0] == 1
    # fewer chunks than before: no stale tail stays
    assert versions.reindex(store, docs(spark, {"a": "x", "b": "p", "c": None}), split) == 2
    assert seen(store) == {"a": "x", "b": "p", "c": ""}
    first = store.state()[1]
    store.replace({"documents": store.read("documents").where("false"), "chunks": store.read("chunks").where("false")}, spark.createDataFrame([("a",)], "handle string"), "handle")
    assert seen(store) == {"b": "p", "c": ""} and store.read("documents", first).count() == 3
    assert store.vacuum(keep=1) > 0 and seen(store) == {"b": "p", "c": ""}


@pytest.mark.parametrize("step", range(6))
def test_a_kill_at_any_step_is_never_seen(spark, tmp_path, monkeypatch, step):
    store = versions.Store(spark, f"file://{tmp_path}/s", buckets=3)
    old, new = {"a": "x y z", "b": "p"}, {"a": "x", "b": "p", "c": "n m"}
    versions.reindex(store, docs(spark, old), split)
    calls = iter(range(100))

    class Killed(Exception):
        pass

    def at(f):
        def call(*args, **kwargs):
            if next(calls) == step:
                raise Killed
            out = f(*args, **kwargs)
            assert seen(versions.Store(spark, store.path, 3)) in (old, new)
            return out

        return call

    with monkeypatch.context() as m:
        # before, between and behind the two tables' writes, and around the commit
        m.setattr(versions.Store, "_bucket", at(versions.Store._bucket))
        m.setattr(versions.Store, "_commit", at(versions.Store._commit))
        with pytest.raises(Killed):
            versions.reindex(store, docs(spark, new), split)
            if step > 3:
                raise Killed
    assert seen(store) == (old if step < 4 else new)
    versions.reindex(store, docs(spark, new), split)
    assert seen(store) == new


def test_texts_are_not_dealt_out_to_tell_what_changed(spark, tmp_path, monkeypatch):
    """The stored rows are more than a broadcast takes, the changed keys are few: texts stay where they lie."""
    store = versions.Store(spark, f"file://{tmp_path}/s", buckets=2)
    texts = {f"h{i}": f"text {i}" for i in range(300)}
    versions.reindex(store, docs(spark, texts), split)
    plans, replace = [], versions.Store.replace

    def kept(self, tables, *args):
        plans.extend(t._jdf.queryExecution().executedPlan().toString() for t in tables.values())
        return replace(self, tables, *args)

    monkeypatch.setattr(versions.Store, "replace", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        assert versions.reindex(store, docs(spark, texts | {"h7": "other", "h300": "new one"}), split) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(plans) == 2 and not any("Exchange hashpartitioning" in p for p in plans)
    assert seen(store) == texts | {"h7": "other", "h300": "new one"}


def test_the_second_of_two_writers_fails_whole(spark, tmp_path):
    store = versions.Store(spark, f"file://{tmp_path}/s", buckets=2)
    one = spark.createDataFrame([("a", 1)], "handle string, n long")
    store.replace({"t": one}, one.select("handle"), "handle")
    number, state = store.state()
    store.replace({"t": one.withColumn("n", F.lit(2).cast("long"))}, one.select("handle"), "handle")
    with pytest.raises(versions.Conflict):
        store._commit(number + 1, state)
    assert [tuple(x) for x in store.read("t").collect()] == [("a", 2)]
    assert not [f for f in os.listdir(tmp_path / "s/commits") if f.startswith(".") and not f.endswith(".crc")]


def test_null_keys_have_a_bucket(spark, tmp_path):
    store = versions.Store(spark, f"file://{tmp_path}/s", buckets=2)
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "k string, n long")
    store.replace({"t": rows}, rows.select("k"), "k")
    store.replace({"t": rows.where("k is null").withColumn("n", F.lit(5).cast("long"))}, rows.where("k is null").select("k"), "k")
    assert sorted((str(x.k), x.n) for x in store.read("t").collect()) == [("None", 5), ("a", 2)]
    assert store.replace({"t": rows}, rows.select("k").where("false"), "k") == 2


def test_bodies_read_only_the_files_asked_for(spark, tmp_path):
    texts = {"10316-1": "---\ntitle: x\n---\n\n\nthe body\nof it\n", "10316-2": "no head at all", "10316-3": "---\nhead without end\n", "10316-4": "---\n---\n", "10316-5": "---\na: b\n---\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.md").write_text(text)
    got = {x.handle: x.body for x in markdown.read_bodies(spark, f"file://{tmp_path}", ["10316/1", "10316/2", "10316/3", "10316/4", "10316/5", "10316/9", "10316/1"]).collect()}

    def slow(raw):
        end = raw.find("\n---\n", 4)
        return raw if not raw.startswith("---\n") or end == -1 else raw[end + 5 :].lstrip("\n")

    assert got == {n.replace("-", "/"): slow(t) for n, t in texts.items()} | {"10316/9": None}
    one = markdown.read_bodies(spark, f"file://{tmp_path}", ["10316/2"])
    assert [f.rsplit("/", 1)[1] for f in one.inputFiles()] == ["10316-2.md"]
    assert [tuple(x) for x in markdown.read_bodies(spark, f"file://{tmp_path}", ["none"]).collect()] == [("none", None)]


def test_page_and_total_are_one_job(spark):
    df = spark.range(1000).where("id % 3 = 0")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("page", "page")
    rows, total = helpers.page_and_total(df, [F.desc("id")], 5, 2)
    jobs = tracker.getJobIdsForGroup("page")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [x.id for x in rows] == [993, 990, 987, 984, 981] and total == 334 and len(jobs) == 1
    got = helpers.paged(df.where("id < 0"), [F.desc("id")], 5)
    assert got.count() == 0 and got.columns == ["id", "total"]


def test_frequencies_count_empty_bags_and_grow(spark):
    a = affinity.term_counts(spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "bag long, t string"), "bag", [(F.col("t"), 2)])
    b = affinity.term_counts(spark.createDataFrame([(9, "beta gamma")], "bag long, t string"), "bag", [(F.col("t"), 3)])
    both = affinity.document_frequencies(a, b)
    want = {"alpha": 1, "beta": 2, "gamma": 1}
    assert {x.term: x.df for x in both.collect()} == want
    assert {x.term: x.df for x in affinity.added_frequencies(affinity.document_frequencies(a), b).collect()} == want
    import math

    assert all(abs(x.idf - (math.log(5 / (want[x.term] + 1)) + 1)) < 1e-12 for x in affinity.idf_of(both, 4).collect())


def test_terms_of_bags_are_counted_where_they_lie(spark):
    """As many as term_counts gives, keys once or twice or null; where they come once, no pair of bag and term is shuffled."""
    one = spark.createDataFrame([(1, "alpha alpha the beta", "beta"), (2, "", None), (None, "alpha", "Caf\u00e9 cafe")], "bag long, t string, u string")
    shuffled = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(bag")
    for docs, exchanges in ((one, 0), (one.unionByName(one), 1)):
        got = affinity.bag_terms(docs, "bag", F.col("t"), F.col("u"))
        want = affinity.term_counts(docs, "bag", [(F.col("t"), 2), (F.col("u"), 3)]).select("bag", "term")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and shuffled(got) == exchanges


@pytest.fixture(scope="module")
def api(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return Api(Roles(spark, DATA))


def test_api_pages_and_their_totals(api):
    for page, every in ((api.projects(limit=3, total=True), api.r.projects), (api.bibliography(limit=3, total=True), api.r.references.where("cited_by >= 2")), (api.collab_pairs(limit=3, min_weight=1, total=True), api.edges())):
        rows = page.collect()
        assert len(rows) == 3 and {x.total for x in rows} == {every.count()}
    with pytest.raises(ValueError):
        api.projects(limit=0)
    with pytest.raises(ValueError):
        api.bibliography(limit=201)
    with pytest.raises(ValueError):
        api.collab_pairs(sort="other")


def test_api_composites(api, tmp_path):
    first = api.r.project_people.where("role = 'coordinator'").first()
    p = api.project(first.project_id).collect()
    assert len(p) == 1 and p[0].people[0].role == "coordinator" and [x.ordinal for x in p[0].partners] == sorted(x.ordinal for x in p[0].partners)
    assert api.project(-1).count() == 0
    (tmp_path / "3.md").write_text("---\nt: 1\n---\nbody three")
    t = api.thesis(3, corpus=f"file://{tmp_path}").collect()
    assert len(t) == 1 and t[0].body == "body three" and t[0].abstract_pt is None and t[0].authors
    assert api.thesis(4, corpus=f"file://{tmp_path}").first().body is None and api.thesis(4).first().body is None
    assert api.thesis(-5).count() == 0 and api.thesis_body(3, f"file://{tmp_path}").first().body == "body three"
    names = [x.display for x in api.thesis_authors().collect()]
    assert names == sorted(names) and len(names) > 10
    assert api.bibliography_theses().count() == api.r.theses.count()
    spelled = api.funding({"1-URGENT": "2-HIGH"}).collect()
    plain = {x.funder: x.project_count for x in api.funding().collect()}
    assert {x.funder: x.project_count for x in spelled}["2-HIGH"] == plain["1-URGENT"] + plain["2-HIGH"]


def test_store_states(spark, api, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/t")
    (tmp_path / "empty").mkdir()
    got = {x.name: (x.state, x.reason) for x in state.store_states(spark, {"ok": (f"file://{tmp_path}/t", ["id"]), "none": (f"file://{tmp_path}/x", []), "lacks": (f"file://{tmp_path}/t", ["id", "v"]), "empty": (f"file://{tmp_path}/empty", []), "odd": ("nowhere://x/y", [])}).collect()}
    assert {k: v[0] for k, v in got.items()} == {"ok": "ready", "none": "missing", "lacks": "unavailable", "empty": "unavailable", "odd": "unavailable"}
    assert got["ok"][1] is None and got["lacks"][1].endswith("lacks v")
    assert {x.state for x in api.store_state().collect()} == {"ready"}
