"""All models in one fit against an independent fit of each."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from eventide.operators import newton as N

L2 = 1e-3


def rows_of(n, seed, models=("a", "b", "c")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        m = rng.choice(models + models[:1] * 5)  # one model has most of the rows
        x = [round(rng.gauss(0, 1), 1), rng.choice([0.0, 1.0])]
        bias = {"a": 0.0, "b": 1.5, "c": -1.0}.get(m, 0.3)
        z = [bias + x[0], -x[0] + 0.5 * x[1], 0.0]
        p = np.exp(z) / np.exp(z).sum()
        out.append((i % 3, m, *x, None if rng.random() < 0.05 else int(rng.choices(range(3), p)[0])))
    return out


SCHEMA = "AccountId long, ModelId string, f long, g double, label int"


def frame(spark, rows):
    return spark.createDataFrame(rows, "AccountId long, ModelId string, f double, g double, label int")


def descended(rows, classes=3):
    """Weights by gradient steps with momentum in numpy, another way to the same minimum."""
    x = np.array([[1.0, r[2], r[3]] for r in rows if r[4] is not None])
    y = np.eye(classes)[[r[4] for r in rows if r[4] is not None]]
    w, v = np.zeros((classes - 1, 3)), np.zeros((classes - 1, 3))
    ridge = np.array([0.0, L2, L2])
    for _ in range(40_000):
        z = np.concatenate([x @ (w + 0.9 * v).T, np.zeros((len(x), 1))], axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - y)[:, :-1].T @ x / len(x) + ridge * (w + 0.9 * v)
        v = 0.9 * v - 0.5 * g
        w = w + v
        if np.abs(g).max() < 1e-11:
            break
    return w.ravel()


def test_all_models_at_once_equal_single_fits(spark):
    rows = rows_of(3000, 1)
    df = frame(spark, rows).repartition(3)
    by, feats = ["AccountId", "ModelId"], ["f", "g"]
    got = N.fit_all(N.sufficient(df, by, feats, n_classes=3), by, l2=L2, n_classes=3).collect()
    assert len(got) == 9 and all(r.converged and r.gradient_max < 1e-8 and 1 < r.steps < 30 for r in got)
    for r in got:
        own = [x for x in rows if (x[0], x[1]) == (r.AccountId, r.ModelId)]
        assert r.n == sum(x[4] is not None for x in own)
        assert np.abs(np.array(r.weights) - descended(own)).max() < 1e-5
    one = df.where("AccountId = 1 and ModelId = 'a'")
    (single,) = N.fit_all(N.sufficient(one, by, feats, n_classes=3), by, l2=L2, n_classes=3).collect()
    (same,) = [r for r in got if (r.AccountId, r.ModelId) == (1, "a")]
    assert np.abs(np.array(single.weights) - np.array(same.weights)).max() < 1e-9


def test_equal_rows_fold_into_the_statistics(spark):
    df = frame(spark, rows_of(400, 2) * 5)
    stats = N.sufficient(df, ["ModelId"], ["f", "g"], n_classes=3)
    assert stats.count() < 400
    assert stats.agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c))).first()[0] == \
        df.where("label is not null").count()


def test_separable_and_one_sided_models_converge(spark):
    rows = [(1, "sharp", float(i % 2), 0.0, 0 if i % 2 else 2) for i in range(50)]
    rows += [(1, "one", float(i % 5), 0.0, 1) for i in range(20)]
    by = ["AccountId", "ModelId"]
    models = N.fit_all(N.sufficient(frame(spark, rows), by, ["f", "g"], n_classes=3), by, l2=0.01, n_classes=3)
    got = {r.ModelId: r for r in models.collect()}
    assert got["sharp"].converged and got["sharp"].loss < 0.25
    pdf = {(r.ModelId, r.f): r.pdf for r in N.predict_all(frame(spark, rows), models, by, ["f", "g"], 3).collect()}
    assert pdf["sharp", 1.0][0] > 0.9 and pdf["sharp", 0.0][2] > 0.9 and pdf["one", 3.0][1] > 0.9
    assert all(abs(sum(p) - 1) < 1e-12 for p in pdf.values())
    stranger = frame(spark, [(9, "none", 1.0, 0.0, 1)])
    assert N.predict_all(stranger, models, by, ["f", "g"], 3).first().pdf is None


def test_nothing_to_fit(spark):
    stats = N.sufficient(frame(spark, []), ["ModelId"], ["f"], n_classes=3)
    assert N.fit_all(stats, ["ModelId"], n_classes=3).count() == 0
