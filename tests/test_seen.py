"""Filters beside the feed: nothing stored is missed, little else is read."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from eventide.schema import EVENT_MESSAGE
from eventide.sinks import seen
from eventide.streaming import flows

COLS = [f.name for f in EVENT_MESSAGE.fields]


def events(spark, rows):
    out = [(a, None if k % 2 else "", "m", f"type{k % 3}", datetime(2031, 1, 1) + timedelta(days=d, seconds=k), k, p)
           for a, d, k, p in rows]
    return spark.createDataFrame(out, EVENT_MESSAGE).withColumn("day", F.to_date("OccurredTime"))


def test_filters_miss_nothing_and_hit_little(spark, monkeypatch):
    monkeypatch.setattr(seen, "PER_BITMAP", 300)
    stored = events(spark, [(a, d, k, k % 7) for a in (1, 2) for d in range(3) for k in range(700)])
    table = seen.filters(stored, COLS)
    assert table.where("length(bits) <> 4096").count() == 0 and table.select("n_maps").distinct().count() == 1
    again = seen.maybe_stored(stored, table, COLS)
    assert again.count() == 4200 and again.where("not maybe").count() == 0
    strangers = events(spark, [(a, d, 10_000 + k, k % 7) for a in (1, 2, 9) for d in range(4) for k in range(700)])
    hits = seen.maybe_stored(strangers, table, COLS).where("maybe")
    assert hits.count() < 40 and hits.where("AccountId = 9 or day > '2031-01-03'").count() == 0


def test_sets_of_several_appends_count_together(spark, tmp_path):
    parts = [[(1, 0, k, 1) for k in range(i * 50, i * 50 + 50)] for i in range(4)] + [[(1, 0, k, 2) for k in range(5000)]]
    for p in parts:
        seen.filters(events(spark, p), COLS).write.mode("append").partitionBy("day").parquet(f"{tmp_path}/f")
    table = spark.read.parquet(f"{tmp_path}/f")
    assert {r.n_maps for r in table.select("n_maps").distinct().collect()} == {1, 3}
    every = events(spark, [r for p in parts for r in p])
    assert seen.maybe_stored(every, table, COLS).where("not maybe").count() == 0


def _read_days(path, frame):
    """The days that the plan's scan of the feed is pruned to; None without such a scan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "PartitionFilters: [" in line]
    of_feed = [s.split("PartitionFilters: ")[1].split("PushedFilters")[0] for s in scans if "day#" in s.split("PartitionFilters: ")[1]]
    return sorted(set(re.findall(r"\d{4}-\d{2}-\d{2}", " ".join(of_feed)))) if of_feed else None


def test_a_late_event_reads_its_own_day_only(spark, tmp_path, monkeypatch):
    feed = f"{tmp_path}/events"
    handle = flows.append_new_events(feed)
    year = [(1, d, d, 5) for d in range(0, 360, 30)]
    raw = events(spark, year).drop("day")
    handle(raw, 0)
    assert spark.read.parquet(feed).count() == len(year)
    read = []
    real = seen.new_events

    def watch(new, path, filter_path, cols):
        out = real(new, path, filter_path, cols)
        read.append(_read_days(path, out))
        return out

    monkeypatch.setattr(flows, "new_events", watch)
    handle(raw, 0)  # the whole batch again: every day is compared, nothing is added
    handle(events(spark, [(1, 30, 30, 5), (1, 200, 77, 5)]).drop("day"), 1)  # one repeat, one late event
    handle(events(spark, [(1, 300, 99, 6)]).drop("day"), 2)  # certainly new
    assert len(read[0]) > 3 and set(read[0]) <= {str(r.day) for r in events(spark, year).collect()}
    assert read[1] == ["2031-01-31"] and read[2] is None
    got = spark.read.schema(EVENT_MESSAGE).parquet(feed)
    assert got.count() == got.distinct().count() == len(year) + 2


def test_filters_left_by_a_crash_only_cost_a_comparison(spark, tmp_path):
    feed = f"{tmp_path}/events"
    rows = events(spark, [(1, 0, k, 5) for k in range(20)])
    seen.filters(rows, COLS).write.partitionBy("day").parquet(f"{feed}-filters")
    handle = flows.append_new_events(feed)
    for epoch in (3, 3):
        handle(rows.drop("day"), epoch)
        assert spark.read.parquet(feed).count() == 20
