"""Structured Streaming dataflow: topics in, validated feeds, message handlers.

Topics are read with the Kafka source when it is on the classpath; every function also takes
any streaming DataFrame with a ``value`` text column, so a file source (JSON lines) stands in
for a topic in tests. Consumer groups are replaced by the query checkpoint.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.functions.messages import encode_messages, from_message, to_message
from eventide.operators.validate import parse_and_validate
from eventide.schema import (EVENT_MESSAGE, MODEL_METRICS, PREDICTION, START_PREDICTION, TRAINING_MODEL_START,
                             TRAINING_DATA_STATUS, TRAINING_MODEL_STATUS, TRAINING_REQUEST)
from eventide.session import cut_lineage, stages
from eventide.sinks.outbox import append_once, is_sent, mark_sent, run_name
from eventide.sinks.seen import filters, new_events
from eventide.sinks.tables import path_exists
from eventide.streaming.tracker import TrackerParams, open_requests, progress_stream

log = logging.getLogger(__name__)


# ---- topics -----------------------------------------------------------------------------------

def read_topic(spark: SparkSession, topic: str, *, bootstrap: str | None = None,
               path: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A topic as a stream of (key, value) text, from the earliest offset.

    With ``bootstrap`` the Kafka source is used; with ``path`` a directory of JSON-lines files
    stands in for the topic (one message per line).
    """
    if bootstrap:
        r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
             .option("subscribe", topic).option("startingOffsets", "earliest"))
        for k, v in (options or {}).items():
            r = r.option(k, v)
        return r.load().select(F.col("key").cast("string"), F.col("value").cast("string"))
    if path is None:
        raise ValueError("read_topic needs bootstrap servers or a path")
    return spark.readStream.schema("value string").text(f"{path}/{topic}").select(
        F.lit(None).cast("string").alias("key"), "value")


def publish(df: DataFrame, schema: T.StructType, topic: str, *, bootstrap: str | None = None,
            path: str | None = None, key_attrs=("AccountId", "ModelId"), once: str | None = None) -> bool:
    """K06 (batch): encode rows as messages and append them to a topic in one distributed write.

    ``once`` names this set of messages: a set that is out is not sent again (see ``sinks.outbox``; with
    a broker, ``path`` holds the ledger). Returns whether this call sent them.
    """
    msgs = encode_messages(df, schema, key_attrs)
    if bootstrap:
        if once and path and is_sent(df.sparkSession, path, topic, once):
            return False
        (msgs.write.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("topic", topic).save())
        if once and path:
            mark_sent(df.sparkSession, path, topic, once)
    elif path and once:
        return append_once(msgs.select("value"), path, topic, once)
    elif path:
        msgs.select("value").write.mode("append").text(f"{path}/{topic}")
    else:
        raise ValueError("publish needs bootstrap servers or a path")
    return True


# ---- S09: validated event feed ----------------------------------------------------------------

def validated_events(raw_stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S09 + V01: the parsed, validated event stream, and the quarantine.

    No watermark: an event may be late by any time. Repeats are dropped where the feed is stored
    (``append_new_events``), so there is no state that would have to forget.
    """
    checked = parse_and_validate(raw_stream, EVENT_MESSAGE)
    valid = checked.where("valid").select(*[f.name for f in EVENT_MESSAGE.fields])
    quarantine = checked.where("NOT valid").select(
        F.col("_raw").alias("value"), "reasons", F.current_timestamp().alias("seen_at"))
    return valid, quarantine


def append_new_events(path: str) -> Callable[[DataFrame, int], None]:
    """A08 on the stored feed: append the events of a batch that the table does not hold yet.

    The table is partitioned by account and day, with filters of its events beside it (``sinks.seen``):
    events that no filter has seen are stored at once, the others are compared with the stored
    events of their own days. The cost follows the batch, not the age of the feed or of its events.
    Replaying a batch adds nothing.
    """
    cols = [f.name for f in EVENT_MESSAGE.fields]

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        with stages(spark):
            new = cut_lineage(batch.select(*cols).dropDuplicates().withColumn("day", F.to_date("OccurredTime")), "feed")
            new = cut_lineage(new_events(new, path, f"{path}-filters", cols), "new")
            if not new.limit(1).count():
                return
            filters(new, cols).write.mode("append").partitionBy("day").parquet(f"{path}-filters")
            new.write.mode("append").partitionBy("AccountId", "day").parquet(path)

    return handle


def start_feed(valid: DataFrame, quarantine: DataFrame, out_path: str, checkpoint: str, *,
               trigger: dict | None = None):
    """Sinks of the feed: new events to parquet by account and day, quarantine beside it."""
    trig = trigger or {"availableNow": True}
    q1 = run_handler(valid, append_new_events(f"{out_path}/events"), f"{checkpoint}/events", trigger=trig)
    q2 = (quarantine.writeStream.format("parquet").option("path", f"{out_path}/quarantine")
          .option("checkpointLocation", f"{checkpoint}/quarantine").trigger(**trig).start())
    return q1, q2


# ---- E01-E05 handlers -------------------------------------------------------------------------

@dataclass
class FlowConfig:
    events_path: str          # canonical event table (S04 layout)
    root_path: str            # run layout root (K03) and model registry (M05)
    out_topics: str           # where status / request / prediction messages go (file topics)
    bootstrap: str | None = None
    history_size: int = 64
    extract_rows: int = 32
    horizon_days: int = 28


class Sender:
    """What one run of a handler sends; a repeated run sends nothing twice."""

    def __init__(self, cfg: FlowConfig, batch: DataFrame, handler: str, epoch: int) -> None:
        self.cfg, self.run = cfg, run_name(batch, handler, epoch)

    def __call__(self, df: DataFrame, schema: T.StructType, topic: str, step: str = "all") -> bool:
        return publish(df, schema, topic, bootstrap=self.cfg.bootstrap, path=self.cfg.out_topics,
                       once=f"{self.run}-{step}")


def _parse(batch: DataFrame, schema: T.StructType) -> DataFrame:
    v = parse_and_validate(batch, schema).where("valid")
    return v.select(*[f.name for f in schema.fields]).dropDuplicates()


def training_data_progress(raw_requests: DataFrame, events: DataFrame, p: TrackerParams = TrackerParams(),
                           *, stored: DataFrame | None = None) -> DataFrame:
    """The progress of each request of the training-data topic over the feed of valid events.

    ``request`` is the request's own message; equal messages while one is open are one request.
    ``stored`` are events of the feed from before this stream, which count from its first run on.
    """
    asked = parse_and_validate(raw_requests, TRAINING_REQUEST).where("valid").select(
        "AccountId", to_message(TRAINING_REQUEST).alias("request"), "total_no_of_records")
    return progress_stream(events, asked, p, stored=stored)


def on_training_data_progress(cfg: FlowConfig) -> Callable[[DataFrame, int], None]:
    """A data status per change; a finished request starts the training, an aborted one does not."""

    def handle(batch: DataFrame, epoch: int) -> None:
        with stages(batch.sparkSession):
            rows = cut_lineage(batch.select(
                from_message(F.col("request"), TRAINING_REQUEST).alias("m"), "no_of_records", "finished", "aborted"),
                "progress")
            rows = rows.select("m.*", "no_of_records", "finished", "aborted")
            send = Sender(cfg, batch, "training-data", epoch)
            send(rows.where("not aborted").select(*[f.name for f in TRAINING_DATA_STATUS.fields]),
                 TRAINING_DATA_STATUS, "training_data_status")
            send(rows.where("finished").select(*[f.name for f in TRAINING_MODEL_START.fields]),
                 TRAINING_MODEL_START, "training_model_start")
            lost = rows.where("aborted").count()
            if lost:
                log.error("%d requests aborted: no data arrived", lost)

    return handle


def on_training_model_start(cfg: FlowConfig) -> Callable[[DataFrame, int], None]:
    """Extract each requested account (S01 + W03) into the run layout; status 0 % / 100 %."""
    from eventide.operators.extract import canonical_events
    from eventide.plans.requests import download_status
    from eventide.plans.scoring import request_extract
    from eventide.sinks.tables import partitions_present, write_run_table
    from eventide.sources.tables import read_events

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        starts = _parse(batch, TRAINING_MODEL_START)
        status = download_status(starts)
        send = Sender(cfg, batch, "model-start", epoch)
        send(status.where("current_step_percentage = 0.0"), TRAINING_MODEL_STATUS, "training_model_status", "0")
        day = datetime.now(timezone.utc).replace(tzinfo=None).strftime("%Y-%m-%d")
        keys = starts.select("AccountId", "ApplicationId", "ModelId").withColumn("dt", F.lit(day))
        # A request whose extract already exists for today is not downloaded again
        p = partitions_present(spark, f"{cfg.root_path}/extract", keys).select(
            F.col("AccountId").alias("_a"), F.col("ApplicationId").alias("_p"), F.col("ModelId").alias("_m"))
        todo = starts.join(p, F.col("AccountId").eqNullSafe(F.col("_a")) & F.col("ModelId").eqNullSafe(F.col("_m"))
                           & F.col("ApplicationId").eqNullSafe(F.col("_p")), "left_anti")
        ext = request_extract(read_events(spark, cfg.events_path), todo)
        ext = ext.drop("AccountId", "ApplicationId", "ModelId").withColumnsRenamed(
            {"req_AccountId": "AccountId", "req_ApplicationId": "ApplicationId",
             "req_ModelId": "ModelId"})
        write_run_table(canonical_events(ext), f"{cfg.root_path}/extract", day)
        send(status.where("current_step_percentage = 1.0"), TRAINING_MODEL_STATUS, "training_model_status", "1")

    return handle


def model_extract(extract: DataFrame) -> DataFrame:
    """The training events of each model (AccountId, ModelId) among the extracts of its applications.

    An extract without application holds all events of the account, so it stands for the others;
    without one, the applications' extracts are disjoint and all are used. No event appears twice.
    """
    key = ["AccountId", "ModelId"]
    whole = extract.where("ApplicationId is null").select(*key).distinct().withColumn("_whole", F.lit(True))
    return extract.join(whole, key, "left").where("_whole is null or ApplicationId is null").drop("_whole")


def on_training_model_status(cfg: FlowConfig) -> Callable[[DataFrame, int], None]:
    """F08 gate -> preprocess (step 1) -> fit (step 2), register, metrics -> prediction request.

    A model is (AccountId, ModelId), however many applications asked for it, and trains once. All models
    of a batch are prepared, fitted, saved and measured in the same jobs, keyed by model; nothing loops
    over them. Each status goes out when its step has been done; a model that got no fit (no events
    left to learn from) has no 100 % of step 2 and no prediction request.
    """
    from eventide.operators.model import bucket_pdf
    from eventide.plans.preprocess import PrepParams, train_validation_samples
    from eventide.plans.requests import (metrics_messages, prediction_requests, ready_to_train,
                                         training_status_steps)
    from eventide.plans.scoring import MODEL_KEY, horizon_metrics, save_models, trained_today
    from eventide.sinks.tables import read_run_table

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        send = Sender(cfg, batch, "model-status", epoch)
        p = PrepParams(horizon_days=cfg.horizon_days, history_size=cfg.history_size)
        today = datetime.now(timezone.utc).replace(tzinfo=None)
        day = today.strftime("%Y-%m-%d")
        registry = f"{cfg.root_path}/registry"

        def tell(asked: DataFrame, step: int, share: float) -> None:
            rows = training_status_steps(asked).where(
                (F.col("current_step") == step) & (F.col("current_step_percentage") == share))
            send(rows, TRAINING_MODEL_STATUS, "training_model_status", f"{step}-{share}")

        with stages(spark):
            ready = cut_lineage(ready_to_train(_parse(batch, TRAINING_MODEL_STATUS)).select(
                "AccountId", "ApplicationId", "ModelId").distinct(), "ready")
            if not ready.limit(1).count():
                return
            todo = ready.select(*MODEL_KEY).distinct()
            if path_exists(spark, registry):
                # A model already trained today is reused, not trained again
                todo = todo.join(trained_today(spark, cfg.root_path, day), MODEL_KEY, "left_anti")
            todo = cut_lineage(todo, "todo")
            tell(ready, 1, 0.0)
            if todo.limit(1).count() and path_exists(spark, f"{cfg.root_path}/extract"):
                extract = read_run_table(spark, f"{cfg.root_path}/extract", dt=day).join(todo, MODEL_KEY, "left_semi")
                events = cut_lineage(model_extract(extract), "model-events")
                samples = train_validation_samples(events, p, MODEL_KEY)
                train = cut_lineage(samples.where("split = 'train'"), "train")
                tell(ready, 1, 1.0)
                tell(ready, 2, 0.0)
                pdf = cut_lineage(bucket_pdf(train, by=MODEL_KEY), "models")
                if pdf.limit(1).count():
                    save_models(pdf, cfg.root_path, today)
                    asked = ready.join(todo, MODEL_KEY, "left_semi")
                    send(metrics_messages(asked, horizon_metrics(events, pdf, p, by=MODEL_KEY), today), MODEL_METRICS,
                         "model_metrics")
            else:
                tell(ready, 1, 1.0)
                tell(ready, 2, 0.0)
            if path_exists(spark, registry):
                done = ready.join(trained_today(spark, cfg.root_path, day), MODEL_KEY, "left_semi")
                tell(done, 2, 1.0)
                send(prediction_requests(done), START_PREDICTION, "start_prediction")

    return handle


def on_start_prediction(cfg: FlowConfig) -> Callable[[DataFrame, int], None]:
    """J07 routing; hits are scored for all their persons in one job (M03 + F10 + K07).

    One message per (request, person); persons without a score are counted in the same job (F10)
    and reported as ``null_predictions``.
    """
    import os

    from eventide.plans.requests import prediction_messages, route_requests
    from eventide.plans.scoring import latest_models, score_requests
    from eventide.sources.tables import read_events

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        reqs = _parse(batch, START_PREDICTION)
        if path_exists(spark, os.path.join(cfg.root_path, "registry")):
            registry = spark.read.parquet(os.path.join(cfg.root_path, "registry"))
        else:  # nothing trained yet
            registry = spark.createDataFrame(
                [], "AccountId long, ModelId string, model_path string, trained_at timestamp_ntz")
        hit, miss = route_requests(reqs, registry)
        send = Sender(cfg, batch, "start-prediction", epoch)
        send(miss, TRAINING_REQUEST, "start_training_data")
        if not hit.limit(1).count():
            return
        as_of = datetime.now(timezone.utc).replace(tzinfo=None)
        pdf = latest_models(spark, cfg.root_path, registry, hit)
        scores = score_requests(read_events(spark, cfg.events_path), hit, pdf, as_of,
                                extract_rows=cfg.extract_rows, history_size=cfg.history_size)
        seen = Observation("null_predictions")
        good, _ = prediction_messages(scores, F.lit(as_of).cast("timestamp_ntz"), observation=seen)
        if not send(good, PREDICTION, "prediction"):
            return  # a repeated batch: nothing ran that could be counted
        nulls = seen.get.get("null_scores") or 0
        if nulls:
            log.warning("%d of %d persons have no score", nulls, seen.get["scored"])

    return handle


def run_handler(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
                *, trigger: dict | None = None):
    """Attach a handler with ``foreachBatch``; the checkpoint replaces the consumer group."""
    return (stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def run_until_closed(progress: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
                     p: TrackerParams = TrackerParams()) -> None:
    """E01 as a bounded run: ends when all input has been read and no request is open any more.

    Polls every ``poll_s``. What comes later is read by the next run from the same checkpoint; a run that
    fails raises, and the next one goes on where it stood.
    """
    spark = progress.sparkSession
    query = run_handler(progress, handler, checkpoint, trigger={"processingTime": f"{p.poll_s} seconds"})
    try:
        while not query.awaitTermination(p.poll_s):
            last = query.lastProgress
            if (last is not None and last["numInputRows"] == 0 and not query.status["isDataAvailable"]
                    and open_requests(spark, checkpoint) == 0):
                break
    finally:
        query.stop()
