"""P01 split, P02/P03 sampling, A08/W01/W03 extract operators."""

from __future__ import annotations

import hashlib
from datetime import datetime, timedelta

from conftest import SF_SMALL, VISITS, make_events, ts
from pyspark.sql import functions as F

from eventide.operators.extract import canonical_events, latest_per_person, with_event_seq
from eventide.operators.sampling import random_second, sample_points
from eventide.operators.split import user_split
from eventide.sources.tables import load_events


def test_split_sizes_round_down(spark):
    rows = [(p, f"2031-01-{d:02d} 00:00:00", "k") for p in range(11) for d in range(1, 2 + p % 4)]
    sp = [r.split for r in user_split(make_events(spark, rows).repartition(5), ratio=0.6).collect()]
    assert (sp.count("train"), sp.count("validation")) == (6, 5)


def test_split_equals_full_sort_rank(spark):
    ev = load_events(spark, SF_SMALL, "orders")
    got = {r.PersonId: (r.split_rank, r.split) for r in
           user_split(ev, ratio=0.8, seed=7, prefix_hex=1).collect()}
    persons = sorted(got)
    order = sorted(persons, key=lambda p: (hashlib.md5(f"7:{p}".encode()).hexdigest(), p))
    k = int(len(order) * 0.8)
    for rank, p in enumerate(order, start=1):
        assert got[p] == (rank, "train" if rank <= k else "validation")


def test_split_is_reproducible_and_disjoint(spark):
    ev = load_events(spark, SF_SMALL, "events")
    a = sorted(tuple(r) for r in user_split(ev).select("PersonId", "split").collect())
    b = sorted(tuple(r) for r in user_split(ev.repartition(3)).select("PersonId", "split").collect())
    assert a == b
    assert len({p for p, _ in a}) == len(a)


def test_random_second_range(spark):
    lo = int((datetime(2023, 7, 10) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    hi = int((datetime(2023, 7, 28) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    df = spark.range(0, 2000).select((F.col("id") / 2000.0).alias("u"))
    r = df.select(random_second(F.lit(lo), F.lit(hi), F.col("u")).alias("t")).agg(
        F.min("t").alias("mn"), F.max("t").alias("mx")).first()
    assert lo <= r.mn and r.mx < hi
    # an empty range gives the end
    one = spark.range(1).select(random_second(F.lit(hi), F.lit(hi), F.lit(0.3)).alias("t")).first()
    assert one.t == hi


def _brute_sampling(rows, lo, hi, h, b, seed):
    def u(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2 ** 32

    def us(t):
        return int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))

    persons = {}
    for r in rows:
        p = persons.setdefault(r.PersonId, [r.OccurredTime, r.OccurredTime, 0])
        p[0] = min(p[0], r.OccurredTime)
        p[1] = max(p[1], r.OccurredTime)
        p[2] += 1
    bucket = {p: int(hashlib.md5(f"{seed}:b:{p}".encode()).hexdigest()[:8], 16) % b for p in persons}
    out = set()
    for bk in set(bucket.values()):
        members = [p for p in persons if bucket[p] == bk]
        n = sum(persons[p][2] for p in members)
        blo = max(us(min(persons[p][0] for p in members)), us(lo))
        bhi = min(us(max(persons[p][1] for p in members)) + 86_400_000_000, us(hi))
        ordered = sorted(members, key=lambda p: (us(persons[p][0]), p))
        for slot in range(n // h + 1):
            rng = (bhi - blo) // 1_000_000
            t = bhi if rng <= 0 else blo + int(u(f"{seed}:{bk}:{slot}:t") * rng) * 1_000_000
            cands = [p for p in ordered if us(persons[p][0]) <= t]
            if not cands:
                continue
            out.add((cands[int(u(f"{seed}:{bk}:{slot}:p") * len(cands))], t))
    return out


def test_sampling_equals_brute_force(spark):
    ev = load_events(spark, SF_SMALL, "events")
    rows = ev.collect()
    lo = min(r.OccurredTime for r in rows)
    hi = max(r.OccurredTime for r in rows) - timedelta(days=7)
    got = sample_points(ev, min_time=lo, max_time=hi, history_size=8, buckets=3, seed=5,
                        materialize=False)
    got = {(r.PersonId, int((r.t0 - datetime(1970, 1, 1)) / timedelta(microseconds=1)))
           for r in got.collect()}
    assert got == _brute_sampling(rows, lo, hi, 8, 3, 5)
    assert all(t < int((hi - datetime(1970, 1, 1)) / timedelta(microseconds=1)) + 1 for _, t in got)


def test_copies_go_and_persons_come_in_time_order(spark):
    rows = [(p, t, d, 77, "app", 5) for p, t, d in VISITS]
    ev = make_events(spark, rows + rows[::-1] + rows[2:5])
    out = with_event_seq(canonical_events(ev, 3)).orderBy("PersonId", "seq").collect()
    want = sorted({(p, ts(t), d) for p, t, d in VISITS})
    assert [(r.PersonId, r.OccurredTime, r.DefinitionId) for r in out] == want
    assert all(r.OccurredTimeTicks == (r.OccurredTime - datetime(1970, 1, 1)) // timedelta(microseconds=1) for r in out)


def test_latest_n_plans_group_limit(spark):
    ev = load_events(spark, SF_SMALL, "events")
    df = latest_per_person(ev, 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert df.groupBy("PersonId").count().agg(F.max("count")).first()[0] == 3
