"""S09 validated feed stream and the E03 / E04 / E05 message handlers over file topics."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import datetime, timedelta, timezone

from conftest import make_events
from pyspark.sql import functions as F

from eventide.schema import EVENT_SCHEMA
from eventide.sinks import tables as flows_tables
from eventide.streaming import flows
from eventide.streaming.tracker import TrackerParams


def _write_lines(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, f"part-{len(os.listdir(path)):04d}.json"), "w") as f:
        f.write("\n".join(lines) + "\n")


def _event_msg(acc, pid, t, d="a"):
    return json.dumps({"AccountId": acc, "ApplicationId": None, "ModelId": "m",
                       "DefinitionId": d, "OccurredTime": t, "OccurredTimeTicks": 1,
                       "PersonId": pid})


def test_validated_feed_dedupes_and_quarantines(spark):
    d = tempfile.mkdtemp(prefix="eventide-feed-")
    good = _event_msg(1, 7, "2024-01-01T00:00:01")
    _write_lines(f"{d}/topics/events", [good, good, _event_msg(-1, 7, "2024-01-01T00:00:02")])
    _write_lines(f"{d}/topics/events", [good, "{broken", _event_msg(1, 8, "2024-01-01T00:00:03")])
    raw = flows.read_topic(spark, "events", path=f"{d}/topics")
    valid, quarantine = flows.validated_events(raw)
    q1, q2 = flows.start_feed(valid, quarantine, f"{d}/out", f"{d}/ckpt")
    assert q1.awaitTermination(120) and q2.awaitTermination(120)
    ev = spark.read.parquet(f"{d}/out/events")
    assert sorted((r.PersonId, str(r.OccurredTime)) for r in ev.collect()) == [
        (7, "2024-01-01 00:00:01"), (8, "2024-01-01 00:00:03")]
    assert spark.read.parquet(f"{d}/out/quarantine").count() == 2


def test_late_events_of_any_age_are_kept(spark):
    d = tempfile.mkdtemp(prefix="eventide-late-")
    os.makedirs(f"{d}/topics/events")
    raw = flows.read_topic(spark, "events", path=f"{d}/topics")

    def batch(*lines):
        _write_lines(f"{d}/topics/events", list(lines))
        valid, quarantine = flows.validated_events(raw)
        for q in flows.start_feed(valid, quarantine, f"{d}/out", f"{d}/ckpt"):
            assert q.awaitTermination(120)

    first, late = _event_msg(4, 1, "2024-03-20T10:00:00"), _event_msg(4, 1, "2024-03-02T09:00:00")
    batch(first)
    batch(_event_msg(4, 2, "2024-03-21T00:00:00"))
    batch(late, first)  # 18 days older than what has been seen, beside a repeat
    batch(late)
    ev = spark.read.parquet(f"{d}/out/events")
    assert sorted((r.PersonId, str(r.OccurredTime)) for r in ev.collect()) == [
        (1, "2024-03-02 09:00:00"), (1, "2024-03-20 10:00:00"), (2, "2024-03-21 00:00:00")]


def test_one_prediction_per_application_and_person(spark, monkeypatch):
    d = tempfile.mkdtemp(prefix="eventide-apps-")
    base = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0) - timedelta(days=140)
    apps = ("007", "y")
    rows = [(p, str(base + timedelta(days=8 * k + p)), "uvw"[(p * k) % 3], 55, apps[p % 2], 50 * p + k)
            for p in range(1, 7) for k in range(7 + p)]
    # idle for longer than the curve reaches
    rows += [(9, str(base - timedelta(days=1500 + k)), "u", 55, "y", 900 + k) for k in range(3)]
    make_events(spark, rows).write.parquet(f"{d}/events")
    cfg = flows.FlowConfig(events_path=f"{d}/events", root_path=f"{d}/root", out_topics=f"{d}/topics",
                           history_size=8, extract_rows=32, horizon_days=7)
    asked = [{"AccountId": 55, "ApplicationId": a, "ModelId": "q", "task_type": "churn"} for a in (None, *apps)]
    _write_lines(f"{d}/in/start", [json.dumps({**a, "no_of_records": 1}) for a in asked])
    flows.on_training_model_start(cfg)(spark.read.text(f"{d}/in/start"), 0)
    extract = flows_tables.read_run_table(spark, f"{d}/root/extract")
    assert {r.ApplicationId for r in extract.select("ApplicationId").distinct().collect()} == {None, "007", "y"}
    whole = flows.model_extract(extract).select("PersonId", "EventKey")
    assert whole.count() == whole.distinct().count() == len(rows)
    # files keep the person order
    files = extract.select("ApplicationId", "PersonId", "OccurredTime", F.input_file_name().alias("f"),
                           F.monotonically_increasing_id().alias("i")).orderBy("i").collect()
    for f in {r.f for r in files}:
        own = [(r.PersonId, r.OccurredTime) for r in files if r.f == f]
        assert own == sorted(own)
    before = {r.f for r in files}

    # a failure while training leaves no 100 % status of that step
    import eventide.plans.scoring as scoring
    with monkeypatch.context() as m:
        m.setattr(scoring, "save_models", lambda *a: (_ for _ in ()).throw(ValueError("no")))
        try:
            flows.on_training_model_status(cfg)(spark.read.text(f"{d}/topics/training_model_status"), 0)
            raise AssertionError("the failure was swallowed")
        except ValueError:
            pass
    said = [json.loads(x.value) for x in spark.read.text(f"{d}/topics/training_model_status").collect()]
    assert {(x["current_step"], x["current_step_percentage"]) for x in said} == {
        (0, 0.0), (0, 1.0), (1, 0.0), (1, 1.0), (2, 0.0)}

    flows.on_training_model_status(cfg)(spark.read.text(f"{d}/topics/training_model_status"), 1)
    assert spark.read.parquet(f"{d}/root/registry").count() == 1
    metrics = [json.loads(x.value) for x in spark.read.text(f"{d}/topics/model_metrics").collect()]
    assert all(0 <= m[k] <= 1 for m in metrics for k in ("auc", "f1", "precission", "recall", "accuracy"))
    assert len(metrics) in (0, 3) and len({m["ApplicationId"] for m in metrics}) == len(metrics)
    flows.on_start_prediction(cfg)(spark.read.text(f"{d}/topics/start_prediction"), 0)
    preds = [json.loads(x.value) for x in spark.read.text(f"{d}/topics/prediction").collect()]
    got = sorted((x["ApplicationId"] or "", x["PersonId"]) for x in preds)
    people = {a: sorted({r[0] for r in rows if a in ("", r[4])}) for a in ("", *apps)}
    assert got == sorted((a, p) for a in people for p in people[a])
    assert {x["score"] for x in preds if x["PersonId"] == 9} == {1.0}

    # the same requests again leave every partition as it is
    flows.on_training_model_start(cfg)(spark.read.text(f"{d}/in/start"), 1)
    again = flows_tables.read_run_table(spark, f"{d}/root/extract")
    assert {r.f for r in again.select(F.input_file_name().alias("f")).collect()} == before


def test_training_data_requests_start_the_training(spark):
    d = tempfile.mkdtemp(prefix="eventide-data-")
    _write_lines(f"{d}/topics/events", [_event_msg(3, i, "2024-05-01T00:00:0%d" % i) for i in range(4)])
    ask = {"ApplicationId": None, "task_type": "churn"}
    _write_lines(f"{d}/topics/start_training_data", [
        json.dumps({"AccountId": 3, "ModelId": "k", "total_no_of_records": 4, **ask}),
        json.dumps({"AccountId": 8, "ModelId": "k", "total_no_of_records": 4, **ask})])
    cfg = flows.FlowConfig(events_path="", root_path="", out_topics=f"{d}/out")
    events, _ = flows.validated_events(flows.read_topic(spark, "events", path=f"{d}/topics"))
    asked = flows.read_topic(spark, "start_training_data", path=f"{d}/topics")
    p = TrackerParams(poll_s=1, idle_s=60, abort_s=4)
    progress = flows.training_data_progress(asked, events, p)
    flows.run_until_closed(progress, flows.on_training_data_progress(cfg), f"{d}/ckpt", p)
    assert not spark.streams.active
    said = [json.loads(r.value) for r in spark.read.text(f"{d}/out/training_data_status").collect()]
    assert said == [{"AccountId": 3, "ModelId": "k", "no_of_records": 4, "total_no_of_records": 4}]
    starts = [json.loads(r.value) for r in spark.read.text(f"{d}/out/training_model_start").collect()]
    assert starts == [{"AccountId": 3, "ModelId": "k", "no_of_records": 4, **ask}]


def test_a_later_run_goes_on_with_counts_and_stored_rows(spark):
    """The second run of the tracker knows what the first has counted; stored events count from the start."""
    d = tempfile.mkdtemp(prefix="eventide-again-")
    p = TrackerParams(poll_s=1, idle_s=3, abort_s=3)
    ask = {"AccountId": 3, "ApplicationId": None, "task_type": "churn"}
    stored = spark.createDataFrame([(3, i) for i in range(5)], "AccountId long, x long")

    def run(rows, model, limit):
        _write_lines(f"{d}/topics/events", [_event_msg(3, i, f"2024-05-01T00:00:{i:02d}") for i in rows])
        _write_lines(f"{d}/topics/start_training_data", [
            json.dumps({**ask, "ModelId": model, "total_no_of_records": limit})])
        cfg = flows.FlowConfig(events_path="", root_path="", out_topics=f"{d}/out")
        events, _ = flows.validated_events(flows.read_topic(spark, "events", path=f"{d}/topics"))
        asked = flows.read_topic(spark, "start_training_data", path=f"{d}/topics")
        progress = flows.training_data_progress(asked, events, p, stored=stored)
        flows.run_until_closed(progress, flows.on_training_data_progress(cfg), f"{d}/ckpt", p)
        assert not spark.streams.active
        starts = [json.loads(r.value) for r in spark.read.text(f"{d}/out/training_model_start").collect()]
        return {r["ModelId"]: r["no_of_records"] for r in starts}

    assert run(range(4), "a", 9) == {"a": 9}
    # the limit is not reached: the run ends by idle time
    assert run(range(10, 13), "b", 99) == {"a": 9, "b": 12}


def test_handlers_repeated_with_one_epoch_send_nothing_twice(spark, monkeypatch):
    from eventide.sinks import outbox

    d = tempfile.mkdtemp(prefix="eventide-once-")
    cfg = flows.FlowConfig(events_path="", root_path=f"{d}/root", out_topics=f"{d}/out")
    asked = json.dumps({"AccountId": 1, "ApplicationId": None, "ModelId": "m", "task_type": "churn",
                        "total_no_of_records": 3})
    rows = spark.createDataFrame([(asked, 3, True, False), (asked, 2, False, False)],
                                 "request string, no_of_records long, finished boolean, aborted boolean")

    def said(topic):
        return spark.read.text(f"{d}/out/{topic}").count()

    handle = flows.on_training_data_progress(cfg)
    # a crash after the staged messages were final, and one between two moves
    for fail_at in (1, 2):
        real, calls = outbox.mark_sent, []

        def crash(*a, **k):
            calls.append(a)
            if len(calls) == fail_at:
                raise OSError("lost")
            return real(*a, **k)

        with monkeypatch.context() as m:
            m.setattr(outbox, "mark_sent", crash)
            try:
                handle(rows, 7)
                raise AssertionError("the failure was swallowed")
            except OSError:
                pass
        assert said("training_data_status") == 2
    for _ in range(2):
        handle(rows, 7)
        assert (said("training_data_status"), said("training_model_start")) == (2, 1)
    handle(rows, 8)  # another epoch is another batch
    assert (said("training_data_status"), said("training_model_start")) == (4, 2)


def test_a_restarted_query_sends_what_the_lost_batch_did_not(spark):
    """The batch fails between its two topics; the query's next start repeats it with the same epoch."""
    d = tempfile.mkdtemp(prefix="eventide-replay-")
    _write_lines(f"{d}/in/start", [json.dumps({"AccountId": 5, "ApplicationId": None, "ModelId": "m",
                                               "task_type": "churn", "total_no_of_records": 2})])
    cfg = flows.FlowConfig(events_path="", root_path="", out_topics=f"{d}/out")
    raw = flows.read_topic(spark, "start", path=f"{d}/in")
    runs = []

    def handle(batch, epoch):
        send = flows.Sender(cfg, batch, "test", epoch)
        rows = flows._parse(batch, flows.TRAINING_REQUEST)
        send(rows, flows.TRAINING_REQUEST, "one")
        runs.append(send.run)
        if len(runs) == 1:
            raise OSError("lost")
        send(rows, flows.TRAINING_REQUEST, "two")

    for _ in range(2):
        try:
            flows.run_handler(raw, handle, f"{d}/ckpt").awaitTermination(60)
        except Exception as e:  # noqa: BLE001 - the query's own exception
            assert "lost" in str(e)
    assert len(runs) == 2 and runs[0] == runs[1] and "direct" not in runs[0]
    assert spark.read.text(f"{d}/out/one").count() == spark.read.text(f"{d}/out/two").count() == 1


def _events_table(spark, path):
    base = datetime.now(timezone.utc).replace(tzinfo=None).replace(microsecond=0) - timedelta(days=150)
    rows = []
    for p in range(1, 9):
        for k in range(6 + p):
            rows.append((p, str(base + timedelta(days=9 * k + p, hours=p)), "ab"[(p + k) % 2],
                         12345, None, p * 100 + k))
    make_events(spark, rows).write.mode("overwrite").parquet(path)


def test_message_handlers_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="eventide-flow-")
    _events_table(spark, f"{d}/events")
    cfg = flows.FlowConfig(events_path=f"{d}/events", root_path=f"{d}/root",
                           out_topics=f"{d}/topics", history_size=8, extract_rows=32,
                           horizon_days=7)
    # E05 before any training: a miss becomes a training request
    _write_lines(f"{d}/in/start_prediction", [json.dumps(
        {"AccountId": 12345, "ApplicationId": None, "ModelId": "m", "task_type": "churn"})])
    flows.on_start_prediction(cfg)(spark.read.text(f"{d}/in/start_prediction"), 0)
    req = [json.loads(x.value) for x in spark.read.text(f"{d}/topics/start_training_data").collect()]
    assert req == [{"AccountId": 12345, "ApplicationId": None, "ModelId": "m",
                    "task_type": "churn", "total_no_of_records": 0}]
    # Extract + status 0 % and 100 %
    _write_lines(f"{d}/in/start", [json.dumps(
        {"AccountId": 12345, "ApplicationId": None, "ModelId": "m", "task_type": "churn",
         "no_of_records": 5})])
    flows.on_training_model_start(cfg)(spark.read.text(f"{d}/in/start"), 0)
    st = [json.loads(x.value) for x in spark.read.text(f"{d}/topics/training_model_status").collect()]
    assert sorted(s["current_step_percentage"] for s in st) == [0.0, 1.0]
    # Gate on step 0 at 100 %, train, register, ask for predictions
    flows.on_training_model_status(cfg)(spark.read.text(f"{d}/topics/training_model_status"), 0)
    assert spark.read.parquet(f"{d}/root/registry").count() == 1
    preq = spark.read.text(f"{d}/topics/start_prediction").collect()
    assert len(preq) == 1
    # E05 again: a hit, every person scored in one job
    flows.on_start_prediction(cfg)(spark.read.text(f"{d}/topics/start_prediction"), 1)
    preds = [json.loads(x.value) for x in spark.read.text(f"{d}/topics/prediction").collect()]
    assert len(preds) == 8
    # the same start and status messages again: extract and model are reused, not redone
    flows.on_training_model_start(cfg)(spark.read.text(f"{d}/in/start"), 2)
    flows.on_training_model_status(cfg)(spark.read.text(f"{d}/topics/training_model_status"), 2)
    assert spark.read.parquet(f"{d}/root/registry").count() == 1
    assert all(0.0 <= p["score"] <= 1.0 for p in preds)
    assert {p["PersonId"] for p in preds} == set(range(1, 9))
    _ = EVENT_SCHEMA
