"""M04 façade end to end: 11 events of 5 persons -> fit -> one score per person (5 rows)."""

from __future__ import annotations

from datetime import datetime

from conftest import make_events

from eventide.plans.preprocess import PrepParams, train_validation_sets
from eventide.plans.scoring import ChurnPipeline

E_MODEL = [
    (1, "2023-10-02 10:00:00", "open"), (1, "2023-10-20 11:00:00", "click"),
    (1, "2023-12-30 09:30:00", "buy"),
    (2, "2023-10-05 08:00:00", "open"), (2, "2023-11-01 18:00:00", "open"),
    (3, "2023-10-10 12:00:00", "click"), (3, "2024-01-02 07:00:00", "leave"),
    (4, "2023-11-15 15:00:00", "buy"), (4, "2023-12-01 16:00:00", "open"),
    (5, "2023-10-25 20:00:00", "leave"), (5, "2024-01-05 21:00:00", "click"),
]


def test_fit_and_score_every_person(spark):
    ev = make_events(spark, E_MODEL)
    train, _ = train_validation_sets(ev, PrepParams(horizon_days=7, history_size=8,
                                                    sample_buckets=2))
    pipe = ChurnPipeline(history_size=64, extract_rows=32).fit(train)
    reqs = spark.createDataFrame([(12345, None, "m1", "churn")],
                                 "AccountId long, ApplicationId string, ModelId string, task_type string")
    scores = pipe.score(ev, reqs, datetime(2024, 1, 10)).select("PersonId", "score").collect()
    assert sorted(r.PersonId for r in scores) == [1, 2, 3, 4, 5]
    assert all(r.score is not None and 0.0 <= r.score <= 1.0 for r in scores)
    by_p = {r.PersonId: r.score for r in scores}
    assert by_p[2] == 1.0  # last event 70 days before as_of: past the 28-day churn horizon
