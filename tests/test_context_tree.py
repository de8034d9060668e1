"""The context tree against counting in Python, and where order matters."""

from __future__ import annotations

import math
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from eventide.operators import context_tree as CT
from eventide.operators.model import attach_pdf, bucket_pdf
from eventide.operators.metrics import mean_log_loss

SAMPLE = ("sid long, ModelId string, history array<struct<OccurredTime timestamp_ntz, DefinitionId string>>, label int")
T0 = datetime(2031, 1, 1)
EDGES = (1, 3, 7, 14, 28)


def history(gaps_and_types, pad=0):
    t, out = T0, [None] * pad
    for gap, kind in gaps_and_types:
        t += timedelta(days=gap)
        out.append((t, kind))
    return out


def full(h, depth):
    ev = [e for e in h if e is not None]
    out = []
    for i in range(len(ev) - 1, max(-1, len(ev) - 1 - depth), -1):
        gap = (ev[i][0] - ev[i - 1][0]).total_seconds() / 86400 if i else None
        out.append((ev[i][1] or "") + "~" + ("f" if gap is None else str(sum(gap >= e for e in EDGES))))
    return out


def mixed(train, depth, strength, least):
    counts = {}
    for h, label in train:
        if label is None:
            continue
        x = full(h, depth)
        for d in range(len(x) + 1):
            counts.setdefault(tuple(x[:d]), Counter())[label] += 1

    def pdf(c):
        n = sum(counts[c].values())
        if not c:
            return [(counts[c][k] + 1) / (n + 6) for k in range(6)]
        up = pdf(c[:-1])
        return [(counts[c][k] + strength * up[k]) / (n + strength) for k in range(6)]

    return {c: (sum(v.values()), pdf(c)) for c, v in counts.items() if not c or sum(v.values()) >= least}


def random_samples(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 1, 2, 3, 5, 8])
        h = history([(rng.choice([0, 0.5, 1, 2, 3, 9, 40]), rng.choice(["a", "b", None])) for _ in range(size)], pad=8 - size)
        rows.append((i, "mn"[i % 3 == 0], h, None if rng.random() < 0.1 or not size else rng.randrange(6)))
    return rows


def test_symbols_of_short_long_and_empty_histories(spark):
    rows = random_samples(60, 1)
    got = spark.createDataFrame(rows, SAMPLE).select("sid", CT.symbols(3).alias("x")).collect()
    assert {r.sid: r.x for r in got} == {i: full(h, 3) for i, _, h, _ in rows}


def test_tree_equals_counting(spark):
    rows = random_samples(700, 2)
    df = spark.createDataFrame(rows, SAMPLE)
    tree = CT.context_tree(df, depth=3, strength=5.0, least=2)
    want = mixed([(h, y) for _, _, h, y in rows], 3, 5.0, 2)
    got = {tuple(r.context): r for r in tree.collect()}
    assert set(got) == set(want) and max(map(len, want)) == 3
    for c, (n, pdf) in want.items():
        assert got[c].n == n and got[c].depth == len(c)
        assert max(abs(a - b) for a, b in zip(got[c].pdf, pdf)) < 1e-12 and abs(sum(got[c].pdf) - 1) < 1e-12
    # the longest stored context decides
    for r in CT.attach_context_pdf(df, tree, depth=3).collect():
        x = tuple(full([e and (e.OccurredTime, e.DefinitionId) for e in r.history], 3))
        d = next(d for d in range(len(x), -1, -1) if x[:d] in want)
        assert r.order == d and max(abs(a - b) for a, b in zip(r.pdf, want[x[:d]][1])) < 1e-12


def test_many_trees_in_one_table_equal_single_ones(spark):
    rows = random_samples(500, 3)
    df = spark.createDataFrame(rows, SAMPLE)
    every = CT.context_tree(df, by=["ModelId"])
    for m in "mn":
        own = CT.context_tree(df.where(F.col("ModelId") == m))
        a = sorted((tuple(r.context), r.n, [round(p, 12) for p in r.pdf]) for r in own.collect())
        b = sorted((tuple(r.context), r.n, [round(p, 12) for p in r.pdf])
                   for r in every.where(F.col("ModelId") == m).collect())
        assert a == b
    stranger = df.limit(3).withColumn("ModelId", F.lit("unknown"))
    got = CT.attach_context_pdf(stranger, every, by=["ModelId"]).collect()
    assert len(got) == 3 and all(r.pdf is None and r.order is None for r in got)


def test_order_of_events_is_learnt(spark):
    """The label follows the type before the last one: the last type alone cannot tell."""
    rng = random.Random(8)
    rows = []
    for i in range(1200):
        kinds = [rng.choice("ab") for _ in range(4)]
        label = (0 if kinds[-2] == "a" else 3) if rng.random() < 0.9 else rng.randrange(6)
        rows.append((i, "m", history([(2, k) for k in kinds]), label))
    df = spark.createDataFrame(rows, SAMPLE)
    train, val = df.where("sid % 4 > 0"), df.where("sid % 4 = 0")
    deep = mean_log_loss(CT.attach_context_pdf(val, CT.context_tree(train))).first()
    flat = mean_log_loss(attach_pdf(val, bucket_pdf(train))).first()
    assert deep.n == flat.n == 300 and deep.log_loss < flat.log_loss - 0.2
    assert math.isclose(flat.log_loss, 1.0, abs_tol=0.3)


def test_no_samples(spark):
    none = spark.createDataFrame([], SAMPLE)
    tree = CT.context_tree(none)
    assert tree.count() == 0
    some = spark.createDataFrame(random_samples(3, 4), SAMPLE)
    assert [r.pdf for r in CT.attach_context_pdf(some, tree).collect()] == [None] * 3
