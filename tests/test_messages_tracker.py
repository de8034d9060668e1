"""K08 keys, C15 JSON, V01 validation, E01 tracker (batch twin + stream), J07 routing."""

from __future__ import annotations

import json
import tempfile
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from eventide.functions.messages import encode_messages, message_key, to_message
from eventide.operators.validate import parse_and_validate
from eventide.plans.requests import route_requests, routed
from eventide.schema import EVENT_MESSAGE, PREDICTION, TRAINING_REQUEST
from eventide.streaming.tracker import TrackerParams, progress_batch, training_starts


def test_message_key_format(spark):
    # fixed format: name='value' pairs, comma separated; an unknown name leaves its place empty
    df = spark.createDataFrame([(7, "m-42", "churn")], "AccountId long, ModelId string, task_type string")

    def key(*names):
        return df.select(message_key(df, *([list(names)] if names else [])).alias("k")).first().k

    assert key() == "AccountId='7', ModelId='m-42'"
    assert key("ModelId") == "ModelId='m-42'" and key("ModelId", "Other") == "ModelId='m-42', "


def test_prediction_json_shape(spark):
    df = spark.createDataFrame(
        [(31, "web", "m-42", 900, datetime(2031, 8, 9, 10, 11, 12, 131415), "churn", 0.25)],
        "AccountId long, ApplicationId string, ModelId string, PersonId long, "
        "prediction_time timestamp_ntz, task_type string, score double")
    v = json.loads(df.select(to_message(PREDICTION).alias("v")).first().v)
    # fixed format: field names of the message; times to the second
    assert v == {"AccountId": 31, "ApplicationId": "web", "ModelId": "m-42", "PersonId": 900,
                 "prediction_time": "2031-08-09T10:11:12", "task_type": "churn", "score": 0.25}


def test_training_request_roundtrip(spark):
    df = spark.createDataFrame([(1, "app", "m", "churn", 0)],
                               "AccountId long, ApplicationId string, ModelId string, task_type string, total_no_of_records long")
    enc = encode_messages(df, TRAINING_REQUEST)
    back = parse_and_validate(enc, TRAINING_REQUEST).first()
    assert back.valid and back.AccountId == 1 and back.task_type == "churn"


def test_validation_quarantines_bad_rows(spark):
    msgs = [
        '{"AccountId":1,"ApplicationId":null,"ModelId":"m","DefinitionId":"a","OccurredTime":"2031-08-09T10:11:12","OccurredTimeTicks":5,"PersonId":3}',
        '{"AccountId":-1,"ApplicationId":null,"ModelId":"m","DefinitionId":"","OccurredTime":"2031-08-09T10:11:12","OccurredTimeTicks":5,"PersonId":3}',
        '{"AccountId":1,"ModelId":"m","OccurredTime":"2031-08-09T10:11:12","OccurredTimeTicks":5,"PersonId":3}',
        'not json at all',
    ]
    df = spark.createDataFrame([(m,) for m in msgs], "value string")
    out = parse_and_validate(df, EVENT_MESSAGE).collect()
    assert [r.valid for r in out] == [True, False, False, False]
    assert "AccountId:negative" in out[1].reasons and "DefinitionId:empty" in out[1].reasons
    assert out[2].reasons == ["DefinitionId:missing"]
    assert len(out[3].reasons) > 0


def _arrivals(spark, secs):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(1, t0 + timedelta(seconds=s)) for s in secs],
                                 "AccountId long, arrival_time timestamp_ntz")


def _req(spark, limit):
    return spark.createDataFrame([(1, datetime(2024, 1, 1), limit)],
                                 "AccountId long, requested_at timestamp_ntz, total_no_of_records long")


def _polls(spark, secs, limit, **p):
    out = progress_batch(_arrivals(spark, secs), _req(spark, limit), TrackerParams(**p))
    return [(r.poll, r.no_of_records, r.is_last) for r in out.orderBy("poll").collect()]


def test_tracker_emits_on_change_and_finishes_on_limit(spark):
    # polls every 3 s: 2 rows by 3 s, none by 6 s, 4 more by 9 s, which passes the limit of 5
    assert _polls(spark, [1, 2, 7, 8, 9, 9, 11], 5, poll_s=3, idle_s=60, abort_s=60) == [(1, 2, False), (3, 6, True)]
    assert _polls(spark, [3, 3], 2, poll_s=3, idle_s=60, abort_s=60) == [(1, 2, True)]


def test_tracker_finishes_by_idle_time(spark):
    # 12 s without a change is not more than the idle time, 15 s is
    assert _polls(spark, [2, 14], 9, poll_s=3, idle_s=12, abort_s=60) == [(1, 1, False), (5, 2, True)]
    assert _polls(spark, [2, 17], 9, poll_s=3, idle_s=12, abort_s=60) == [(1, 1, True)]


def test_tracker_aborts_without_data(spark):
    assert _polls(spark, [40], 9, poll_s=3, idle_s=6, abort_s=30) == []


def test_tracker_counts_rows_that_were_there_before(spark):
    assert _polls(spark, [-500, -3, 0], 2, poll_s=3, idle_s=6, abort_s=30) == [(0, 3, True)]
    assert _polls(spark, [-500, 4], 2, poll_s=3, idle_s=6, abort_s=30) == [(0, 1, False), (2, 2, True)]


def test_tracker_keeps_requests_of_one_account_apart(spark):
    t0 = datetime(2024, 1, 1)
    reqs = [(1, t0, 3, "x"), (1, t0, 3, "y"), (1, t0 + timedelta(seconds=30), 5, "x"), (2, t0, 1, "z")]
    req = spark.createDataFrame(reqs, "AccountId long, requested_at timestamp_ntz, total_no_of_records long, ModelId string")
    req = req.withColumn("ApplicationId", F.lit(None).cast("string")).withColumn("task_type", F.lit("churn"))
    prog = progress_batch(_arrivals(spark, [1, 1, 2, 31, 32]), req, TrackerParams(poll_s=5, idle_s=20, abort_s=20))
    got = sorted((r.requested_at.second, r.poll, r.no_of_records, r.is_last) for r in prog.collect())
    assert got == [(0, 1, 3, True), (30, 0, 3, False), (30, 1, 5, True)]  # account 2 aborts
    starts = sorted((r.ModelId, r.no_of_records) for r in training_starts(prog, req).collect())
    assert starts == [("x", 3), ("x", 5), ("y", 3)]


def _wait(query, reached, seconds=90):
    """Timeouts keep the stream running, so it is stopped once the result is there."""
    end = time.time() + seconds
    try:
        while not reached() and time.time() < end:
            time.sleep(0.5)
    finally:
        query.stop()


def test_tracker_stream_counts_match_batch(spark):
    from eventide.streaming.tracker import progress_stream

    d = tempfile.mkdtemp(prefix="eventide-stream-")
    for i, n in enumerate((3, 4, 5)):
        spark.createDataFrame([(i % 2, j) for j in range(n)], "AccountId long, x long") \
            .write.mode("append").parquet(f"{d}/in")
    src = spark.readStream.schema("AccountId long, x long").option("maxFilesPerTrigger", 1) \
        .parquet(f"{d}/in")
    q = (progress_stream(src, limit=100, p=TrackerParams(poll_s=1, idle_s=3600, abort_s=3600))
         .writeStream.format("memory").queryName("tracker_out").outputMode("append")
         .option("checkpointLocation", f"{d}/ckpt").start())

    def counts():
        out = spark.sql("SELECT AccountId, max(no_of_records) AS n FROM tracker_out GROUP BY AccountId")
        return {r.AccountId: r.n for r in out.collect()}

    _wait(q, lambda: counts() == {0: 8, 1: 4})
    assert counts() == {0: 8, 1: 4}


def test_tracker_stream_finishes_on_each_requests_limit(spark):
    from eventide.streaming.tracker import progress_stream

    d = tempfile.mkdtemp(prefix="eventide-stream-")
    for i, n in enumerate((3, 4, 5)):
        spark.createDataFrame([(i % 2, j) for j in range(n)], "AccountId long, x long") \
            .write.mode("append").parquet(f"{d}/in")
    src = spark.readStream.schema("AccountId long, x long").option("maxFilesPerTrigger", 1) \
        .parquet(f"{d}/in")
    # two requests for account 0, no request for account 1
    reqs = spark.createDataFrame([(0, 8), (0, 8), (0, 3)], "AccountId long, total_no_of_records long")
    q = (progress_stream(src, reqs, TrackerParams(poll_s=1, idle_s=3600, abort_s=3600))
         .writeStream.format("memory").queryName("tracker_limits").outputMode("append")
         .option("checkpointLocation", f"{d}/ckpt").start())
    _wait(q, lambda: spark.sql("SELECT * FROM tracker_limits WHERE finished").count() >= 2)
    rows = spark.sql("SELECT * FROM tracker_limits").collect()
    fin = sorted((r.AccountId, r.no_of_records, r.total_no_of_records) for r in rows if r.finished)
    assert [(a, t) for a, _, t in fin] == [(0, 3), (0, 8)] and {r.AccountId for r in rows} == {0}
    assert max(n for _, n, _ in fin) == 8  # not multiplied by the number of requests


def test_tracker_stream_of_requests_counts_and_aborts(spark):
    from eventide.streaming.tracker import progress_stream

    d = tempfile.mkdtemp(prefix="eventide-stream-")
    spark.createDataFrame([(4, i) for i in range(7)], "AccountId long, x long").write.parquet(f"{d}/in")
    asked = [(4, "a", 7), (4, "b", 0), (4, "c", 50), (6, "d", 5)]
    spark.createDataFrame(asked, "AccountId long, request string, total_no_of_records long").write.parquet(f"{d}/req")
    src = spark.readStream.schema("AccountId long, x long").parquet(f"{d}/in")
    req = spark.readStream.schema("AccountId long, request string, total_no_of_records long").parquet(f"{d}/req")
    q = (progress_stream(src, req, TrackerParams(poll_s=1, idle_s=3, abort_s=3))
         .writeStream.format("memory").queryName("tracker_asked").outputMode("append")
         .option("checkpointLocation", f"{d}/ckpt").start())
    _wait(q, lambda: spark.sql("SELECT * FROM tracker_asked WHERE finished OR aborted").count() >= 4)
    end = {r.request: (r.no_of_records, r.total_no_of_records, r.finished, r.aborted)
           for r in spark.sql("SELECT * FROM tracker_asked WHERE finished OR aborted").collect()}
    assert end == {"a": (7, 7, True, False), "b": (7, 0, True, False), "c": (7, 50, True, False),
                   "d": (0, 5, False, True)}


class _Handle:
    """State and timers of one group, as ``RequestTracker`` sees them, with a clock of its own."""

    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Map(dict):
        def iterator(self):
            return iter(list(self.items()))

        def updateValue(self, key, value):  # noqa: N802
            self[key] = value

        def removeKey(self, key):  # noqa: N802
            del self[key]

    def __init__(self):
        self.now, self.timers = 0, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self.Value()

    def getMapState(self, name, key, value):  # noqa: N802
        return self.Map()

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def _step(tracker, handle, at_s, rows=None):
    """Rows at a time, or what the timers due until then do."""
    import pandas as pd

    if rows is None:
        out = []
        for t in sorted(t for t in handle.timers if t <= at_s * 1000):
            handle.now = at_s * 1000
            handle.timers.remove(t)
            out += [tuple(r)[1:] for x in tracker.handleExpiredTimer((4,), handle, None) for r in x.itertuples(index=False)]
        return out
    handle.now = at_s * 1000
    pdfs = [pd.DataFrame(rows, columns=["AccountId", "n", "asked"])]
    return [tuple(r)[1:] for x in tracker.handleInputRows((4,), iter(pdfs), handle) for r in x.itertuples(index=False)]


def _tracker(standing, **p):
    from eventide.streaming.tracker import RequestTracker

    handle, tracker = _Handle(), RequestTracker(TrackerParams(**p), standing=standing)
    tracker.init(handle)
    return tracker, handle


def test_tracker_state_follows_messages():
    t, s = _tracker(False, poll_s=1, idle_s=10, abort_s=20)
    assert _step(t, s, 0, [(4, 0, '{"x": 5}')]) == [] and s.timers == {20_001}
    assert _step(t, s, 20) == []
    assert _step(t, s, 21) == [("x", 0, 5, False, True)]
    # an ended request leaves neither state nor timer
    assert not t.open and not t.done and not s.timers
    # rows that nobody asks for are counted; the next week's request finds them
    assert _step(t, s, 30, [(4, 3, None)]) == [] and not s.timers
    assert _step(t, s, 900, [(4, 0, '{"x": 5}')]) == [("x", 3, 5, False, False)]
    # the idle time runs from the request, not from the rows of the week before
    assert _step(t, s, 909) == []
    assert _step(t, s, 910, [(4, 1, None)]) == [("x", 4, 5, False, False)] and s.timers == {920_001}
    assert _step(t, s, 921) == [("x", 4, 5, True, False)]
    assert _step(t, s, 2000, [(4, 1, '{"x": 5, "y": 9}')]) == [
        ("x", 5, 5, True, False), ("y", 5, 9, False, False)]


def test_each_request_has_its_own_end():
    t, s = _tracker(False, poll_s=1, idle_s=10, abort_s=20)
    assert _step(t, s, 0, [(4, 0, '{"a": 9}')]) == []
    assert _step(t, s, 8, [(4, 0, '{"b": 9}')]) == [] and s.timers == {20_001}
    assert _step(t, s, 21) == [("a", 0, 9, False, True)] and s.timers == {28_001}
    assert _step(t, s, 25, [(4, 2, '{"c": 2}')]) == [("b", 2, 9, False, False), ("c", 2, 2, True, False)]
    assert s.timers == {35_001}
    assert _step(t, s, 36) == [("b", 2, 9, True, False)] and not s.timers and not t.open


def test_standing_requests_stay_done_while_they_are_asked_for():
    t, s = _tracker(True, poll_s=1, idle_s=10, abort_s=20)
    assert _step(t, s, 0, [(4, 2, '{"a": 2, "b": 7}')]) == [("a", 2, 2, True, False), ("b", 2, 7, False, False)]
    assert _step(t, s, 1, [(4, 1, '{"a": 2, "b": 7}')]) == [("b", 3, 7, False, False)]
    assert _step(t, s, 2, [(4, 1, '{"c": 4}')]) == [("c", 4, 4, True, False)]
    assert not t.open and set(t.done) == {("c",)}
    assert _step(t, s, 3, [(4, 0, '{"a": 2}')]) == [("a", 4, 2, True, False)]


def test_route_requests_hit_and_miss(spark):
    reqs = spark.createDataFrame([(1, None, "a", "churn"), (2, "x", "b", "churn")],
                                 "AccountId long, ApplicationId string, ModelId string, task_type string")
    reg = spark.createDataFrame([(1, "a")], "AccountId long, ModelId string")
    hit, miss = route_requests(reqs, reg)
    assert [r.AccountId for r in hit.collect()] == [1]
    m = miss.first()
    assert (m.AccountId, m.total_no_of_records) == (2, 0)
    assert {r.AccountId: r.route for r in routed(reqs, reg).collect()} == {1: "predict", 2: "train"}


def test_metrics_become_one_message_per_request(spark):
    from eventide.operators.metrics import classification_metrics
    from eventide.plans.requests import metrics_messages

    reqs = spark.createDataFrame([(3, None, "k"), (3, "b", "k")], "AccountId long, ApplicationId string, ModelId string")
    scored = spark.createDataFrame([(0.9, 1), (0.7, 0), (0.2, 0), (0.6, 1)], "score double, actual int")
    at = datetime(2033, 4, 5, 6)
    got = metrics_messages(reqs, classification_metrics(scored), at).orderBy("ApplicationId").collect()
    assert [(r.ApplicationId, r.timestamp, r.auc, r.recall, r.accuracy) for r in got] == [
        (None, at, 0.75, 1.0, 0.75), ("b", at, 0.75, 1.0, 0.75)]
    # one kind of persons only: there is no AUC, so no message
    assert metrics_messages(reqs, classification_metrics(scored.where("actual = 1")), at).count() == 0
