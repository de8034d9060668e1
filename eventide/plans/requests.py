"""Message dataflow as DataFrame jobs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.config import SUPPORTED_TASK_TYPE
from eventide.schema import MODEL_METRICS, PREDICTION, START_PREDICTION, TRAINING_MODEL_STATUS, TRAINING_REQUEST

MODEL_KEY = ["AccountId", "ModelId"]
TOTAL_STEPS = 3


def _project(df: DataFrame, schema) -> DataFrame:
    """Q14: build a message from a wider row by projecting to the target schema."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def training_requests(models: DataFrame, task_type: str = SUPPORTED_TASK_TYPE) -> DataFrame:
    """One training request per registered model, total = 0."""
    return _project(models.withColumn("task_type", F.lit(task_type))
                    .withColumn("total_no_of_records", F.lit(0)), TRAINING_REQUEST)


def prediction_requests(models: DataFrame, task_type: str = SUPPORTED_TASK_TYPE) -> DataFrame:
    """One prediction request per registered model."""
    return _project(models.withColumn("task_type", F.lit(task_type)), START_PREDICTION)


def route_requests(requests: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests whose (AccountId, ModelId) has a trained model -> predict, else -> a
    training request with total 0. ApplicationId is not part of the registry key."""
    keys = registry.select(*MODEL_KEY).distinct()
    hit = requests.join(keys, MODEL_KEY, "left_semi")
    miss = requests.join(keys, MODEL_KEY, "left_anti")
    return hit, training_requests(miss)


def routed(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """J07 as one frame with a ``route`` column ('predict' | 'train')."""
    keys = registry.select(*MODEL_KEY).distinct().withColumn("_hit", F.lit(True))
    return requests.join(keys, MODEL_KEY, "left").select(
        *requests.columns,
        F.when(F.col("_hit"), F.lit("predict")).otherwise(F.lit("train")).alias("route"))


def download_status(starts: DataFrame) -> DataFrame:
    """For each training start, step 0 at 0 % and at 100 % (of 3 steps)."""
    base = starts.select("AccountId", "ApplicationId", "ModelId")
    pct = F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("current_step_percentage")
    rows = base.select("*", F.lit(0).alias("current_step"), pct,
                       F.lit(TOTAL_STEPS).alias("total_no_of_steps"))
    return _project(rows, TRAINING_MODEL_STATUS)


def training_status_steps(ready: DataFrame) -> DataFrame:
    """Status rows of the preprocessing (step 1) and training (step 2) stages."""
    base = ready.select("AccountId", "ApplicationId", "ModelId")
    steps = F.explode(F.array(
        *[F.struct(F.lit(s).alias("current_step"), F.lit(p).alias("current_step_percentage"))
          for s in (1, 2) for p in (0.0, 1.0)])).alias("_s")
    rows = base.select("*", steps).select(
        "AccountId", "ApplicationId", "ModelId", "_s.current_step",
        "_s.current_step_percentage", F.lit(TOTAL_STEPS).alias("total_no_of_steps"))
    return _project(rows, TRAINING_MODEL_STATUS)


def ready_to_train(statuses: DataFrame, account_id: int | None = None,
                   model_id: str | None = None) -> DataFrame:
    """F08 (+ optional F09 filters): only step 0 at 100 % starts preprocessing + training."""
    out = statuses.where((F.col("current_step") == 0) & (F.col("current_step_percentage") == 1.0))
    if account_id is not None:
        out = out.where(F.col("AccountId") == F.lit(int(account_id)))
    if model_id is not None:
        out = out.where(F.col("ModelId") == F.lit(model_id))
    return out


def metrics_messages(requests: DataFrame, metrics: DataFrame, timestamp: datetime,
                     task_type: str = SUPPORTED_TASK_TYPE) -> DataFrame:
    """A09 as messages: a model's row of metrics for each request of it.

    ``metrics`` is one row, for all requests, or has a row per (AccountId, ModelId). A metric without
    a value (all persons of one kind, say) leaves an incomplete message, which is not sent.
    """
    if set(MODEL_KEY) <= set(metrics.columns):
        numbers = [c for c in metrics.columns if c not in MODEL_KEY]
        rows = requests.join(metrics.dropna(subset=numbers), MODEL_KEY)
        return _project(rows.withColumns({"timestamp": F.lit(timestamp), "task_type": F.lit(task_type)}), MODEL_METRICS)
    row = metrics.first()  # seven numbers
    values = {f.name: row[f.name] for f in MODEL_METRICS.fields if f.name in metrics.columns}
    if any(v is None for v in values.values()):
        return requests.sparkSession.createDataFrame([], MODEL_METRICS)
    return _project(requests.withColumns({
        "timestamp": F.lit(timestamp), "task_type": F.lit(task_type), **{k: F.lit(v) for k, v in values.items()}}),
        MODEL_METRICS)


def latest_status(statuses: DataFrame, order: Column | str, keys=("AccountId", "ModelId"),
                  ) -> DataFrame:
    """The latest status row per key (``max_by`` over a struct of the fields)."""
    o = F.col(order) if isinstance(order, str) else order
    fields = [c for c in statuses.columns if c not in keys]
    agg = statuses.groupBy(*keys).agg(F.max_by(F.struct(*fields), o).alias("_last"))
    return agg.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in fields])


def prediction_messages(scores: DataFrame, prediction_time: Column,
                        task_type: str = SUPPORTED_TASK_TYPE, observation=None
                        ) -> tuple[DataFrame, DataFrame]:
    """F10 + K07: one Prediction row per scored (request, person); NULL scores are split off.

    With a ``pyspark.sql.Observation`` the number of NULL scores is reported as a metric of
    the same job that writes the messages (no extra pass).
    """
    rows = scores.withColumn("prediction_time", prediction_time).withColumn(
        "task_type", F.lit(task_type))
    if observation is not None:
        rows = rows.observe(observation, F.sum(F.col("score").isNull().cast("int"))
                            .alias("null_scores"), F.count(F.lit(1)).alias("scored"))
    good = _project(rows.where(F.col("score").isNotNull()), PREDICTION)
    bad = rows.where(F.col("score").isNull()).select("AccountId", "ApplicationId", "ModelId",
                                                     "PersonId")
    return good, bad
