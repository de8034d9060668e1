"""Preparation, fit and metrics keyed by model equal those of each model alone."""

from __future__ import annotations

from conftest import SF_SMALL
from pyspark.sql import functions as F

from eventide.operators.model import bucket_pdf
from eventide.plans import preprocess as prep
from eventide.plans.preprocess import PrepParams, train_validation_samples
from eventide.plans.scoring import horizon_metrics
from eventide.session import cut_lineage
from eventide.sources.tables import load_events

BY = ["AccountId", "ModelId"]
P = PrepParams(horizon_days=7, history_size=4, sample_buckets=4)


def bag(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def test_keyed_sets_fits_and_metrics_equal_single_ones(spark):
    ev = cut_lineage(load_events(spark, SF_SMALL, "events"), "ev")
    # persons of one account also belong to a second model of it
    second = ev.where("AccountId = 1").withColumn("ModelId", F.lit("second"))
    ev = cut_lineage(ev.unionByName(second), "ev")
    both = cut_lineage(train_validation_samples(ev, P, BY), "both")
    tests = cut_lineage(prep.test_set_by(ev, P, BY), "tests")
    pdf = cut_lineage(bucket_pdf(both.where("split = 'train'"), by=BY), "pdf")
    metrics = cut_lineage(horizon_metrics(ev, pdf, P, by=BY), "metrics")
    keys = [tuple(r) for r in ev.select(*BY).distinct().collect()]
    assert len(keys) > 5 and {tuple(r) for r in both.select(*BY).distinct().collect()} == set(keys)
    cols = ["PersonId", "t0", "history", "history_len", "next_event", "label"]
    for a, m in [k for k in keys if k[0] == 1 and k[1] != "second"][:1] + [(1, "second")]:
        key = (F.col("AccountId") == a) & (F.col("ModelId") == m)
        own = ev.where(key)
        alone = cut_lineage(train_validation_samples(own, P), "alone")
        assert bag(both.where(key), *cols, "split") == bag(alone, *cols, "split") != []
        assert bag(tests.where(key), *cols) == bag(prep.test_set(own, P), *cols) != []
        one = bucket_pdf(alone.where("split = 'train'"))
        assert bag(pdf.where(key), "segment", "n", "pdf") == bag(one, "segment", "n", "pdf")
        numbers = ["auc", "f1", "precission", "recall", "accuracy", "n"]
        assert bag(metrics.where(key), *numbers) == bag(horizon_metrics(own, one, P).where("n is not null"), *numbers)
