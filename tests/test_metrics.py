"""A09 on exact scores, against a pairwise count."""

from __future__ import annotations

import random

from eventide.operators.metrics import classification_metrics


def _pairwise(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_scores_that_differ_in_the_seventh_place_are_ranked(spark):
    rows = [(0.4999998, 0), (0.5, 1), (0.49999985, 0)]
    m = classification_metrics(spark.createDataFrame(rows, "score double, actual int")).first()
    assert (m.auc, m.precission, m.recall, m.accuracy, m.n) == (1.0, 1.0, 1.0, 1.0, 3)


def test_auc_over_several_ranges_equals_the_pairwise_count(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice([rnd.random(), round(rnd.random(), 1)]), rnd.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows + [(None, 1)], "score double, actual int").repartition(6)
    m = classification_metrics(df).first()
    assert abs(m.auc - _pairwise(rows)) < 1e-12 and m.n == 400
