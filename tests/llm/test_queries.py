"""Registered queries on the smallest tables, against DuckDB where SQL expresses them."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from eventide.llm import catalog
from eventide.session import stages

SF = "/root/testdata/sf0.001"
KEYS = {"op3_quotation_linking": ["conv_id", "turn"], "op7_host_reputation": ["page_id"]}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    with stages(spark):
        got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.sql(catalog.ORACLES[name]).df()[list(got.columns)]
    key = KEYS.get(name, ["doc_id"])
    got, want = (d.sort_values(key).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) > 0
    for c in got.columns:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, name):
    with stages(spark):
        df = catalog.QUERIES[name](spark, SF)
        n = df.count()
    assert n == {"op8_packing": n, "op12_conversation_repair": 20}.get(name, 200) and n > 0


def test_pipeline_stages_keep_their_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    assert docs.where("n_tokens > 0 and length(ids_sha256) = 64").count() == counts[5]
