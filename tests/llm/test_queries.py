"""Queries beside their oracle SQL, and the pipeline, on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from launchlens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


def test_pipeline_keeps_clean_texts_and_one_of_each_group(spark):
    docs = queries.table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    n = docs.count()
    left = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            left.append(docs.count())
    assert n > left[0] >= left[1] >= left[2] > 0
    assert docs.select("doc_id").distinct().count() == left[2]
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_stages_take_edge_rows(spark, edge, no_docs):
    for docs in (edge, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).collect()


def test_classifier_stage_takes_the_operators_decision(spark):
    docs = queries.table(spark, SF, "documents")
    decided = {r.doc_id for r in queries.QUERIES["op8_quality_classifier"](spark, SF).where("predicted = 1").collect()}
    stays = {r.doc_id for r in corpus_pipeline.classifier_stage(spark, docs, SF).collect()}
    assert stays == decided and 0 < len(stays) < docs.count()
