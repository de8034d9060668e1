"""Explicit schemas: the canonical event frame and the message types."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_COLUMNS = [
    "AccountId",
    "ApplicationId",
    "ModelId",
    "DefinitionId",
    "OccurredTime",
    "OccurredTimeTicks",
    "PersonId",
]

# EventKey is the source row id: the last tie-break when two events share time and ticks.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("AccountId", T.LongType(), True),
        T.StructField("ApplicationId", T.StringType(), True),
        T.StructField("ModelId", T.StringType(), True),
        T.StructField("DefinitionId", T.StringType(), True),
        T.StructField("OccurredTime", T.TimestampNTZType(), True),
        T.StructField("OccurredTimeTicks", T.LongType(), True),
        T.StructField("PersonId", T.LongType(), True),
        T.StructField("EventKey", T.LongType(), True),
    ]
)

# Event order used everywhere: time, then ticks, then type, then source id.
ORDER_COLUMNS = ["OccurredTime", "OccurredTimeTicks", "DefinitionId", "EventKey"]

# ---- messages -------------------------------------------------------------------------------

_ACC = T.StructField("AccountId", T.LongType(), True)
_APP = T.StructField("ApplicationId", T.StringType(), True)
_MOD = T.StructField("ModelId", T.StringType(), True)
_TASK = T.StructField("task_type", T.StringType(), True)

EVENT_MESSAGE = T.StructType(
    [
        _ACC,
        _APP,
        _MOD,
        T.StructField("DefinitionId", T.StringType(), True),
        T.StructField("OccurredTime", T.TimestampNTZType(), True),
        T.StructField("OccurredTimeTicks", T.LongType(), True),
        T.StructField("PersonId", T.LongType(), True),
    ]
)
TRAINING_REQUEST = T.StructType(
    [_ACC, _APP, _MOD, _TASK, T.StructField("total_no_of_records", T.LongType(), True)]
)
TRAINING_DATA_STATUS = T.StructType(
    [
        _ACC,
        _MOD,
        T.StructField("no_of_records", T.LongType(), True),
        T.StructField("total_no_of_records", T.LongType(), True),
    ]
)
TRAINING_MODEL_START = T.StructType(
    [_ACC, _APP, _MOD, _TASK, T.StructField("no_of_records", T.LongType(), True)]
)
TRAINING_MODEL_STATUS = T.StructType(
    [
        _ACC,
        _APP,
        _MOD,
        T.StructField("current_step", T.IntegerType(), True),
        T.StructField("current_step_percentage", T.DoubleType(), True),
        T.StructField("total_no_of_steps", T.IntegerType(), True),
    ]
)
START_PREDICTION = T.StructType([_ACC, _APP, _MOD, _TASK])
MODEL_METRICS = T.StructType(
    [
        _ACC,
        _APP,
        _MOD,
        T.StructField("timestamp", T.TimestampNTZType(), True),
        _TASK,
        T.StructField("auc", T.DoubleType(), True),
        T.StructField("f1", T.DoubleType(), True),
        T.StructField("precission", T.DoubleType(), True),
        T.StructField("recall", T.DoubleType(), True),
        T.StructField("accuracy", T.DoubleType(), True),
    ]
)
PREDICTION = T.StructType(
    [
        _ACC,
        _APP,
        _MOD,
        T.StructField("PersonId", T.LongType(), True),
        T.StructField("prediction_time", T.TimestampNTZType(), True),
        _TASK,
        T.StructField("score", T.DoubleType(), True),
    ]
)

MESSAGE_SCHEMAS: dict[str, T.StructType] = {
    "event": EVENT_MESSAGE,
    "realtime_event": EVENT_MESSAGE,
    "training_request": TRAINING_REQUEST,
    "training_data_status": TRAINING_DATA_STATUS,
    "training_model_start": TRAINING_MODEL_START,
    "training_model_status": TRAINING_MODEL_STATUS,
    "start_prediction": START_PREDICTION,
    "model_metrics": MODEL_METRICS,
    "prediction": PREDICTION,
}
