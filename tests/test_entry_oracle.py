"""Driver contract: entry() runs, every query has an oracle, a sample of queries matches it."""

from __future__ import annotations

import os

import pytest
from conftest import SF_SMALL

import __spark_entry__ as E

NO_ORACLE = {"classifier_scores"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"PersonId", "history_types", "label"}


def test_every_query_has_an_oracle():
    from eventide.plans import catalog

    missing = set(catalog.queries()) - set(E.oracle_sql()) - NO_ORACLE
    assert not missing, missing


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    return str(v)


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["account_extract", "test_samples", "user_split",
                                  "sample_points", "train_samples", "churn_scores",
                                  "ingest_progress", "request_progress", "message_json",
                                  "quarantined_events", "route_requests", "score_metrics"])
def test_query_matches_oracle_sf0001(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    got = df.collect()
    assert got and _bag(df.columns, got) == _bag(ocols, res.fetchall())
