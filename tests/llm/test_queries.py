"""The registered queries over the small tables, with SQL where there is some, and the pipeline against its stages' rules."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))
    assert got
    if sql := queries.ORACLE_SQL.get(name):
        assert got == sorted(map(str, duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()))


def test_pipeline(spark, duck):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("keep_id", F.lit("own"))
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], SF)
        assert out.columns == docs.columns, name
        kept.append(out.cache())
    texts = [{r.doc_id: r.text for r in d.collect()} for d in kept]
    assert all(set(b) <= set(a) for a, b in zip(texts, texts[1:]))
    # exact copies: one row of each text stays, the one with the largest id
    last = {}
    for i, t in texts[1].items():
        last[t] = max(i, last.get(t, i))
    assert set(texts[2]) == set(last.values())
    # near copies and leaks: what the operators say of the stage's own input
    groups = queries.jaccard.jaccard_components(kept[2]).collect()
    assert set(texts[3]) == {r.component_id for r in groups}
    hits = queries.decontam.contamination(queries.decontam.benchmark_hits(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert set(texts[4]) == {r.doc_id for r in hits.where("NOT contaminated").collect()}
    packed = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in packed} == set(texts[4]) and all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)
