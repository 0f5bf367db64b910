import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from evalspark.llm import oracle, queries


def canonical(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine, theirs = canonical(queries.QUERIES[name](spark, sf).toPandas()), canonical(con.execute(oracle.ORACLE[name]).df())
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False)


def test_pipeline(spark, table):
    docs = table("documents", "sf0.01")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "/root/testdata/sf0.01").cache()
        seen[name] = now.count()
        if name != "encoding":
            assert now.columns == docs.columns
    assert docs.count() > seen["quality"] > seen["exact_dedup"] >= seen["near_dedup"] > seen["mixing"] == seen["encoding"] > 0
    labels = table("labels", "sf0.01")
    good = docs.join(labels.where("quality = 1"), "doc_id")
    assert corpus_pipeline.keep_good(spark, docs, "/root/testdata/sf0.01").join(good.select("doc_id"), "doc_id").count() > 0.95 * good.count()


def test_pipeline_runs_on_an_empty_table(spark, docs):
    now = docs([]).drop("bucket", "token", "rep")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "/root/testdata/sf0.001")
    assert now.count() == 0
