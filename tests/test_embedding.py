"""The distributed factorisation against numpy, co-occurrence against counting in Python."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from eventide.operators import embedding as E


def table(spark, a):
    rows = [(f"t{i:02d}", f"t{j:02d}", float(a[i, j])) for i in range(len(a)) for j in range(len(a)) if a[i, j] != 0]
    return spark.createDataFrame(rows, "row string, col string, value double").repartition(3)


def dense(q, n):
    out = np.zeros((n, len(q[0].vector)))
    for r in q:
        out[int(r.key[1:])] = r.vector
    return out


@pytest.mark.parametrize("n,rank", [(30, 4), (5, 8)])
def test_factorisation_equals_numpy(spark, n, rank):
    rng = np.random.default_rng(n)
    basis, _ = np.linalg.qr(rng.normal(size=(n, n)))
    spectrum = np.array([9.0, -7.0, 4.0, 2.0] + [0.02] * (n - 4))[:n]
    a = (basis * spectrum) @ basis.T
    a = (a + a.T) / 2
    q, values = E.factorised(table(spark, a), rank)
    v = dense(q.collect(), n)
    want = sorted(np.linalg.eigvalsh(a), key=abs, reverse=True)[:rank]
    assert np.abs(values - np.array(want)[:len(values)]).max() < 1e-6 and len(values) == min(n, rank)
    assert np.abs(v.T @ v - np.eye(len(values))).max() < 1e-9
    error = np.linalg.norm(a - (v * values) @ v.T, 2)
    assert error < (0.021 if rank < n else 1e-8)
    if rank < n:
        return
    again, same = E.factorised(table(spark, a), rank)
    assert np.allclose(same, values) and np.allclose(dense(again.collect(), n), v, atol=1e-7)


def test_low_rank_and_empty_tables(spark):
    u = np.arange(1.0, 7.0)
    q, values = E.factorised(table(spark, np.outer(u, u)), 3)
    assert len(values) == 1 and abs(values[0] - u @ u) < 1e-9
    none = spark.createDataFrame([], "row string, col string, value double")
    q, values = E.factorised(none, 3)
    assert q.count() == 0 and len(values) == 0
    assert E.ppmi(spark.createDataFrame([], "row string, col string, n long")).count() == 0


def test_vectors_follow_the_table(spark):
    a = np.diag([3.0, 2.0, 1.0]) + 0.5
    vectors = {r.token: np.array(r.vector) for r in E.embeddings(table(spark, a), 3).collect()}
    for i in range(3):
        for j in range(3):  # all eigenvalues are positive here
            assert abs(vectors[f"t{i:02d}"] @ vectors[f"t{j:02d}"] - a[i, j]) < 1e-8


def test_cooccurrence_and_ppmi_equal_counting(spark):
    rng = random.Random(3)
    logs = {p: [rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(1, 12))] for p in range(40)}
    rows = [(p, i, t) for p, log in logs.items() for i, t in enumerate(log)]
    got = E.cooccurrence(spark.createDataFrame(rows, "PersonId long, pos long, DefinitionId string"), 3)
    want = Counter()
    for log in logs.values():
        for i, x in enumerate(log):
            for y in log[i + 1:i + 4]:
                if x and y:
                    want[x, y] += 1
                    want[y, x] += 1
    assert {(r.row, r.col): r.n for r in got.collect()} == want
    total, own = sum(want.values()), Counter()
    for (x, _), n in want.items():
        own[x] += n
    values = {(r.row, r.col): r.value for r in E.ppmi(got, 0.0).collect()}
    for (x, y), n in want.items():
        v = math.log(n * total / (own[x] * own[y]))
        assert abs(values.get((x, y), 0.0) - max(v, 0.0)) < 1e-12
