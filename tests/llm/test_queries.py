import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from logistra.llm import ngram_join

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(corpus_pipeline.LLM_ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(corpus_pipeline.LLM_ORACLES[name])
    columns = [c[0] for c in want.description]
    got = corpus_pipeline.LLM_QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [{r.doc_id for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, FOLDER).cache()
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert docs.columns[:5] == columns[:5] == corpus_pipeline.COLUMNS
        assert kept[-1] <= kept[-2]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    # Some 80 labels are enough for most of what is bad.
    bad = {i for i, quality in labels.items() if quality == 0}
    assert len(bad & kept[1]) <= len(bad) / 3
    assert sum(labels.get(i) == 1 for i in kept[0] - kept[1]) <= 2
    whole = corpus_pipeline.run(spark, FOLDER)
    rows = lambda df: sorted((r.doc_id, r.text, r.taken, r.position) for r in df.collect())
    assert rows(whole) == rows(docs)


def test_stages_take_odd_rows(spark):
    import corpus

    docs = corpus.clashing(corpus.frame(spark))
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.where("false")):
            out = stage(spark, table, FOLDER)
            assert out.columns[:5] == corpus_pipeline.COLUMNS
            assert out.count() >= 0, name


def test_join_rule_bounds():
    import numpy as np

    rule = ngram_join.Rule(5, 80, 100, 0.25)
    n = np.arange(1, 2000)
    assert (rule.extended(n) <= n).all() and (rule.prefix(n) >= 1).all()
    assert (rule.least(n) * 100 >= n * 80).all()
