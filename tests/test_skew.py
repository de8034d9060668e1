"""One person holding more than a third of all rows: results stay exact and the work is split."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.config import DAY_US
from eventide.functions.time import epoch_us
from eventide.operators.extract import with_event_seq
from eventide.operators.history import histories_for_samples, histories_at
from eventide.schema import EVENT_SCHEMA

BASE = datetime(2024, 1, 1)


def _skewed(spark, hot_rows=3000, others=40, per_other=30):
    rows = []
    key = 0
    for i in range(hot_rows):  # person 1: every 10 minutes for ~3 weeks, ties every 7th row
        t = BASE + timedelta(minutes=10 * (i - i % 7 // 6))
        rows.append((1, None, "m", "ab"[i % 2], t, int((t - datetime(1970, 1, 1)).total_seconds() * 1e6), 1, key))
        key += 1
    for p in range(2, 2 + others):
        for k in range(per_other):
            t = BASE + timedelta(hours=13 * k + p)
            rows.append((1, None, "m", "c", t, int((t - datetime(1970, 1, 1)).total_seconds() * 1e6), p, key))
            key += 1
    return spark.createDataFrame(rows, EVENT_SCHEMA), rows


def test_hot_person_numbering_is_exact_and_split(spark):
    ev, rows = _skewed(spark)
    hot = sorted((r for r in rows if r[6] == 1), key=lambda r: (r[4], r[5], r[3], r[7]))
    want = {r[7]: i + 1 for i, r in enumerate(hot)}
    got = with_event_seq(ev, chunk_days=1.0).where("PersonId = 1").select("EventKey", "seq")
    assert {r.EventKey: r.seq for r in got.collect()} == want
    # the hot person's window work is spread over (person, day) partitions
    chunks = ev.where("PersonId = 1").select(
        F.floor(epoch_us("OccurredTime") / F.lit(DAY_US)).alias("c")).distinct().count()
    assert chunks >= 20


def test_hot_person_histories_match_single_t0_form(spark):
    ev, _ = _skewed(spark)
    t0s = [BASE + timedelta(days=d, minutes=7 * d) for d in range(0, 22, 3)]
    samples = spark.createDataFrame([(p, t) for p in (1, 2, 5) for t in t0s],
                                    "PersonId long, t0 timestamp_ntz")
    many = {(r.PersonId, r.t0): ([e.EventKey if e else None for e in r.history],
                                 r.next_event.EventKey if r.next_event else None)
            for r in histories_for_samples(ev, samples, 16, chunk_days=1.0,
                                           materialize=False).collect()}
    for t in t0s:  # the positional many-t0 form equals the per-t0 aggregate form
        one = histories_at(ev, t, 16, include_empty=True).where(F.col("PersonId").isin(1, 2, 5))
        for r in one.collect():
            want = ([e.EventKey if e else None for e in r.history],
                    r.next_event.EventKey if r.next_event else None)
            assert many[(r.PersonId, t)] == want, (r.PersonId, t)


def test_ranged_running_sum_spreads_rows_of_one_instant(spark):
    """All rows of a key at one time, where a window per time chunk would be one task."""
    from eventide.operators.positions import ranged_running_sum

    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.lit(None)).alias("k"),
                                  F.lit(5).alias("t"), "id", (F.col("id") % 2).alias("w"))
    got = ranged_running_sum(df, ["k"], ["t", "id"], "w", out="r")
    want = df.withColumn("r", F.sum("w").over(
        Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(tuple, got.select("id", "r").collect())) == sorted(map(tuple, want.select("id", "r").collect()))
    assert ranged_running_sum(df.limit(0), ["k"], ["t", "id"], "w").count() == 0
