import os

import pytest

from lodestar.llm import jaccard, quality_rules
from lodestar.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    start, seen = docs.columns, []
    for name, stage in p.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, DATA)
        if name != p.STAGES[-1][0]:
            assert docs.columns == start
            docs = p.cut(docs)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        seen.append((name, len(set(ids))))
        if name == "quality_rules":
            labels = spark.read.parquet(f"{DATA}/labels.parquet")
            want = {r.doc_id for r in quality_rules.score_rules(spark.read.parquet(f"{DATA}/documents.parquet"), labels).where("kept").collect()}
            assert set(ids) == want
        elif name == "ngram_jaccard_join":
            assert len(ids) == len(set(ids))
        else:
            assert set(ids) == set(before)
    assert seen[0][1] > seen[1][1] > 50, seen


def test_pipeline_keeps_one_of_each(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in jaccard.one_of_each(docs).collect()}
    found = jaccard.join(docs, 5, 80).collect()
    assert {r.component_id for r in found} == kept
