"""H07 whole preprocessing run, S07 read-back, K01-K04 layout, S03 extract files, A05, M05, C14."""

from __future__ import annotations

import os
import tempfile
from datetime import datetime

from conftest import SF_SMALL, make_events
from pyspark.sql import functions as F

from eventide.functions.time import sample_key
from eventide.operators.extract import account_counts, preview
from eventide.plans.preprocess import PrepParams, preprocess_dataset
from eventide.plans.scoring import ChurnPipeline, trained_today
from eventide.sinks.tables import partitions_present, read_run_table, write_extract, write_run_table
from eventide.sources.tables import load_events, read_prepared


def test_preprocess_dataset_writes_every_table(spark):
    out = tempfile.mkdtemp(prefix="eventide-prep-")
    ev = load_events(spark, SF_SMALL, "orders")
    paths = preprocess_dataset(spark, ev, out, PrepParams(horizon_days=28, history_size=16))
    t = read_prepared(spark, out)
    assert set(paths) == set(t)
    assert t["vocab"].count() == 5
    assert t["time_stats"].count() == 1
    tr, va = t["train_prepared"], t["validation_prepared"]
    assert tr.count() > 0 and va.count() > 0
    assert tr.join(va, "PersonId", "left_semi").count() == 0  # split is disjoint by person
    assert t["test_prepared"].where(F.col("history_len") > 16).count() == 0


def test_run_layout_and_skip_list(spark):
    root = tempfile.mkdtemp(prefix="eventide-runs-")
    ev = make_events(spark, [(1, "2023-07-10 00:00:00", "a", 1, "app"),
                             (2, "2023-07-11 00:00:00", "b", 2, None)])
    write_run_table(ev, f"{root}/extract", "2023-07-12")
    got = read_run_table(spark, f"{root}/extract", account_id=1, dt="2023-07-12")
    assert [r.PersonId for r in got.collect()] == [1]
    keys = spark.createDataFrame([(1, "app", "m1", "2023-07-12"), (3, "x", "m1", "2023-07-12")],
                                 "AccountId long, ApplicationId string, ModelId string, dt string")
    present = partitions_present(spark, f"{root}/extract", keys)
    assert [r.AccountId for r in present.collect()] == [1]


def test_extract_files_are_chunked(spark):
    out = tempfile.mkdtemp(prefix="eventide-ext-")
    ev = load_events(spark, SF_SMALL, "events").coalesce(1)
    write_extract(ev, f"{out}/x", chunk_rows=300)
    files = [f for f in os.listdir(f"{out}/x") if f.endswith(".parquet")]
    assert len(files) == 4  # 1,000 rows in files of at most 300
    assert spark.read.parquet(f"{out}/x").count() == 1000


def test_account_counts_keep_missing_accounts(spark):
    ev = make_events(spark, [(1, "2023-07-10 00:00:00", "a", 7), (2, "2023-07-10 00:00:00", "a", 7)])
    accts = spark.createDataFrame([(7,), (8,)], "AccountId long")
    got = {r.AccountId: r.n_rows for r in account_counts(ev, accts).collect()}
    assert got == {7: 2, 8: None}


def test_registry_and_reuse(spark):
    root = tempfile.mkdtemp(prefix="eventide-reg-")
    samples = spark.createDataFrame(
        [([{"OccurredTime": datetime(2023, 1, 1), "OccurredTimeTicks": 0, "DefinitionId": "a",
            "EventKey": 1, "AccountId": 1, "ApplicationId": None}], 1, 2)],
        "history array<struct<OccurredTime:timestamp_ntz,OccurredTimeTicks:bigint,DefinitionId:string,"
        "EventKey:bigint,AccountId:bigint,ApplicationId:string>>, history_len int, label int")
    pipe = ChurnPipeline().fit(samples)
    path = pipe.save(spark, root, 1, "m", datetime(2023, 7, 12, 10))
    assert ChurnPipeline.load(spark, path).pdf.count() == 2  # segment 'a' and the global row
    assert [tuple(r) for r in trained_today(spark, root, "2023-07-12").collect()] == [(1, "m")]
    assert trained_today(spark, root, "2023-07-13").count() == 0


def test_sample_key_and_preview(spark):
    df = spark.createDataFrame([(5, datetime(2023, 7, 10, 1, 2, 3))], "p long, t timestamp_ntz")
    assert df.select(sample_key("p", "t").alias("k")).first().k == "5_2023-07-10 01:02:03.000000"
    assert preview(load_events(spark, SF_SMALL, "events"), 3).count() == 3


def test_prepared_sets_are_built_once_per_input(spark, tmp_path):
    from eventide.plans.preprocess import PrepParams, drop_prepared, prepared_dir, shared_train_validation
    from eventide.session import stages
    from eventide.sources.tables import read_events

    path, built = f"{tmp_path}/events", []
    p = PrepParams(horizon_days=7, history_size=4, sample_buckets=2)

    def load():
        built.append(1)
        return read_events(spark, path)

    def some(days):
        return make_events(spark, [(u, f"2032-01-{1 + (u + k) % days:02d} 10:00:0{k}", "xyz"[k % 3])
                                   for u in range(9) for k in range(8)])

    some(28).write.parquet(path)
    with stages(spark):
        first = shared_train_validation(spark, path, load, p)
        n = first.count()
    again = shared_train_validation(spark, path, load, p)
    assert len(built) == 1 and again.count() == n > 0 and {r.split for r in again.collect()} <= {"train", "validation"}
    shared_train_validation(spark, path, load, PrepParams(horizon_days=6, history_size=4, sample_buckets=2))
    assert len(built) == 2  # other parameters
    some(27).write.mode("append").parquet(path)
    shared_train_validation(spark, path, load, p)
    assert len(built) == 3  # other input
    assert len(os.listdir(prepared_dir(spark))) >= 3 and not [x for x in os.listdir(prepared_dir(spark)) if len(x) > 45]
    drop_prepared(spark)
    assert not os.path.exists(prepared_dir(spark))


def test_extract_of_a_store_is_distinct_and_latest(spark):
    from eventide.sources.tables import extracted

    rows = [(1, f"2032-02-0{d} 00:00:00", "x", 5, a, d) for d in range(1, 7) for a in ("m", "n")]
    ev = make_events(spark, [*rows, *rows, (2, "2032-02-01 00:00:00", "x", 6, "m", 99)])
    assert extracted(ev, 5).count() == 12
    got = extracted(ev, 5, "n", latest_n=2).collect()
    assert sorted((r.ApplicationId, r.EventKey) for r in got) == [("n", 5), ("n", 6)]


def test_counts_carry_their_time(spark):
    ev = make_events(spark, [(1, "2032-02-01 00:00:00", "x", 5), (2, "2032-02-01 00:00:00", "x", 5)])
    before = spark.sql("SELECT localtimestamp() AS t").first().t
    row = account_counts(ev, with_time=True).first()
    assert row.n_rows == 2 and before <= row.counted_at <= spark.sql("SELECT localtimestamp() AS t").first().t


def test_input_state_follows_every_file(spark, tmp_path):
    import os

    from eventide.sinks.tables import input_state

    at = f"{tmp_path}/in"
    spark.range(10).selectExpr("id", "id % 2 AS k").write.partitionBy("k").parquet(at)
    before = input_state(spark, at)
    assert input_state(spark, at) == before
    part, *_ = (os.path.join(r, f) for r, _, fs in os.walk(f"{at}/k=1") for f in fs if f.startswith("part-"))
    folder = os.stat(at).st_mtime_ns
    with open(part, "r+b") as f:  # same length, same folders, another time
        f.write(f.read(1))
    os.utime(part, ns=(1_000_000_000_000, 1_000_000_000_000))
    assert os.stat(at).st_mtime_ns == folder and input_state(spark, at) != before


def test_incomplete_tables_are_replaced(spark, tmp_path):
    import os

    from eventide.sinks.tables import write_once

    at = f"{tmp_path}/once"
    spark.range(3).write.parquet(at)
    os.remove(f"{at}/_SUCCESS")
    assert write_once(spark, at, lambda: spark.range(5)).count() == 5
    assert write_once(spark, at, lambda: spark.range(7)).count() == 5
    assert [f for f in os.listdir(tmp_path) if f != "once"] == []


def test_stage_tables_belong_to_their_job(spark):
    """Threads that store and read inside their own blocks leave each other's tables alone."""
    import os
    import threading

    from eventide.session import cut_lineage, stages

    outside = cut_lineage(spark.range(4), "outside")
    failures, kept = [], []

    def work(k):
        try:
            for i in range(6):
                with stages(spark) as own:
                    a = cut_lineage(spark.range(100 + k), "a")
                    with stages(spark):
                        b = cut_lineage(a.where("id % 2 = 0"), "b")
                        assert b.count() == (100 + k + 1) // 2
                    assert a.count() == 100 + k
                    kept.append(list(own.paths))
                assert not any(os.path.exists(p) for p in kept[-1]) or len(kept) > 1
        except Exception as e:  # noqa: BLE001 - reported below
            failures.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert failures == [] and len(kept) == 24
    assert not any(os.path.exists(p) for paths in kept for p in paths)
    assert outside.count() == 4
