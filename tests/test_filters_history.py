"""Golden rows and brute-force equality."""

from __future__ import annotations

from datetime import datetime, timedelta

from conftest import SF_SMALL, VISITS, make_events, ts

from eventide.operators.filters import (persons_active_in_window, persons_with_history,
                                        time_cutoff)
from eventide.operators.history import (histories_at, histories_for_samples, next_event_at,
                                        with_label)


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _visits(keep):
    return sorted((p, ts(t)) for p, t, _ in VISITS if keep(p, ts(t)))


def test_time_cutoff_keeps_earlier_rows(spark):
    cut = datetime(2031, 3, 15, 23, 59, 59, 500000)  # exactly one visit's time, which stays out
    got = _rows(time_cutoff(make_events(spark, VISITS), cut), "PersonId", "OccurredTime")
    assert got == _visits(lambda p, t: t < cut) and len(got) == 3


def test_time_cutoff_is_strict(spark):
    ev = make_events(spark, [(4, "2031-05-01 00:00:00", "a"), (4, "2031-04-30 23:59:59.999999", "a")])
    assert time_cutoff(ev, datetime(2031, 5, 1)).count() == 1


def test_persons_with_history_keeps_all_rows(spark):
    got = _rows(persons_with_history(make_events(spark, VISITS), datetime(2031, 3, 4)), "PersonId", "OccurredTime")
    # both rows of person 10, the later one too; person 20 starts after the threshold
    assert got == _visits(lambda p, t: p == 10) and len(got) == 2


def test_active_window_is_open_on_both_ends(spark):
    end = datetime(2031, 6, 20)
    ev = make_events(spark, [(5, str(end), "a"), (6, str(end - timedelta(days=9)), "a"),
                             (7, str(end - timedelta(microseconds=1)), "a"),
                             (8, str(end - timedelta(days=9) + timedelta(microseconds=1)), "a")])
    got = persons_active_in_window(ev, end, 9)
    assert sorted(r.PersonId for r in got.collect()) == [7, 8]


def test_next_event_found_and_not_found(spark):
    ev = make_events(spark, VISITS)
    after = {r.PersonId: r.next_event for r in next_event_at(ev, datetime(2031, 3, 16)).collect()}
    assert (after[20].DefinitionId, after[20].OccurredTime) == ("pay", datetime(2031, 3, 21, 6))
    assert after[10].DefinitionId == "close" and after[30].DefinitionId == "pay"
    assert all(r.next_event is None for r in next_event_at(ev, datetime(2031, 4, 1)).collect())


def test_next_event_includes_t0(spark):
    ev = make_events(spark, [(1, "2031-07-01 05:00:00", "now"), (1, "2031-07-01 05:00:01", "next")])
    assert next_event_at(ev, datetime(2031, 7, 1, 5)).first().next_event.DefinitionId == "now"


def test_history_padding_and_order(spark):
    h = {r.PersonId: r for r in histories_at(make_events(spark, VISITS), datetime(2031, 3, 20), 5).collect()}
    assert h[20].history_len == 3 and h[20].next_event.DefinitionId == "pay"
    assert [e and (e.DefinitionId, e.OccurredTime.day) for e in h[20].history] == [
        None, None, ("open", 4), ("open", 9), ("close", 15)]


def test_history_sizes_below_at_above_h(spark):
    base = datetime(2023, 1, 1)
    rows = [(p, str(base + timedelta(hours=i)), "a") for p, n in ((1, 3), (2, 4), (3, 5))
            for i in range(n)]
    ev = make_events(spark, rows)
    h = {r.PersonId: r.history_len for r in histories_at(ev, datetime(2024, 1, 1), 4).collect()}
    assert h == {1: 3, 2: 4, 3: 4}


def test_label_from_last_event(spark):
    ev = make_events(spark, [(1, "2023-07-01 00:00:00", "a"), (1, "2023-07-05 00:00:00", "b")])
    s = histories_at(ev, datetime(2023, 7, 3), 8).withColumn("t0", __import__(
        "pyspark.sql.functions", fromlist=["lit"]).lit(datetime(2023, 7, 3)).cast("timestamp_ntz"))
    assert with_label(s).first().label == 2          # 4 days after the last event: [3, 7)
    assert with_label(s, label_from="t0").first().label == 1  # 2 days after t0


def _brute_histories(events, samples, h):
    out = {}
    by_p = {}
    for e in events:
        by_p.setdefault(e.PersonId, []).append(e)
    for p in by_p:
        by_p[p].sort(key=lambda e: (e.OccurredTime, e.OccurredTimeTicks, e.DefinitionId,
                                    e.EventKey))
    for p, t0 in samples:
        evs = by_p.get(p, [])
        before = [e.EventKey for e in evs if e.OccurredTime < t0][-h:]
        after = [e.EventKey for e in evs if e.OccurredTime >= t0]
        out[(p, t0)] = (before, after[0] if after else None)
    return out


def test_many_t0_equals_brute_force_for_any_chunking(spark):
    from eventide.sources.tables import load_events

    ev = load_events(spark, SF_SMALL, "events").cache()
    rows = ev.collect()
    persons = sorted({r.PersonId for r in rows})
    t_lo = min(r.OccurredTime for r in rows)
    samples = []
    for i, p in enumerate(persons):
        for k in range(4):
            samples.append((p, t_lo + timedelta(days=3 * k + i % 5, hours=k)))
    # a sample exactly at an event time: the event is "next", not history
    r0 = rows[10]
    samples.append((r0.PersonId, r0.OccurredTime))
    sdf = spark.createDataFrame(samples, "PersonId long, t0 timestamp_ntz")
    want = _brute_histories(rows, samples, 8)
    for chunk in (1.0 / 24, 3.0, 365.0):
        got = histories_for_samples(ev, sdf, 8, chunk_days=chunk, materialize=False).collect()
        assert len(got) == len(want)
        for g in got:
            keys = [e.EventKey for e in g.history if e is not None]
            nk = g.next_event.EventKey if g.next_event else None
            assert (keys, nk) == want[(g.PersonId, g.t0)], (chunk, g.PersonId, g.t0)
