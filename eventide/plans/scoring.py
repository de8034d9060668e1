"""Scoring jobs (H08, M03, M04, M05): all persons of all requests in one job."""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.config import BUCKET_EDGES_DAYS, DAY_US, HISTORY_SIZE, PREDICT_EXTRACT_ROWS
from eventide.functions.time import epoch_us, ts_lit
from eventide.operators.history import HISTORY_FIELDS, event_struct, pad_left
from eventide.operators.metrics import classification_metrics
from eventide.operators.model import bucket_pdf, score_histories
from eventide.plans.preprocess import PrepParams, test_set, test_set_by
from eventide.session import cut_lineage

SALTS = 16
REQUEST_KEYS = ["AccountId", "ApplicationId", "ModelId"]


def request_extract(events: DataFrame, requests: DataFrame) -> DataFrame:
    """S01 per request: the account's rows, and only the request's application when it is set.

    An equi-join on AccountId plus the application predicate: every request gets exactly the
    rows its own extract would read. Output columns: the request keys that ``requests`` has
    (``req_*``) + event columns. A few accounts may hold the whole log, so the join key has a salt of
    the person: each request is ``SALTS`` rows, and an account's events go to as many tasks.
    """
    req = requests.select(*[F.col(k).alias(f"req_{k}") for k in REQUEST_KEYS if k in requests.columns]).distinct()
    # one row per registered model, stored: Spark knows its size and broadcasts it where it is small
    req = cut_lineage(req, "requests").withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    events = events.withColumn("_salt", F.pmod(F.xxhash64("PersonId"), F.lit(SALTS)).cast("int"))
    cond = (F.col("AccountId") == F.col("req_AccountId")) & (F.col("_salt") == F.col("_s")) & (
        F.col("req_ApplicationId").isNull() | (F.col("req_ApplicationId") == "")
        | (F.col("ApplicationId") == F.col("req_ApplicationId")))
    return events.join(req, cond, "inner").drop("_salt", "_s")


def histories_per_request(extract: DataFrame, as_of: datetime | Column, *,
                          extract_rows: int = PREDICT_EXTRACT_ROWS,
                          history_size: int = HISTORY_SIZE) -> DataFrame:
    """W01 (latest ``extract_rows`` per person and request) then H08 (last H before as_of).

    Every person of the extract appears, with an empty history when nothing precedes as_of. One
    shuffle: the window and the aggregate share their keys, and a list has at most
    ``extract_rows`` entries.
    """
    asked = [k for k in REQUEST_KEYS if f"req_{k}" in extract.columns]
    keys = [f"req_{k}" for k in asked] + ["PersonId"]
    order = [F.col(c).desc() for c in ("OccurredTimeTicks", "OccurredTime", "DefinitionId",
                                       "EventKey")]
    ext = (extract.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
           .where(F.col("_rn") <= F.lit(int(extract_rows))))
    t0 = ts_lit(as_of)
    etype = T.StructType([ext.schema[c] for c in HISTORY_FIELDS])
    hist = ext.groupBy(*keys).agg(F.sort_array(F.collect_list(
        F.when(F.col("OccurredTime") < t0, event_struct()))).alias("_all"))
    first = F.greatest(F.size("_all") - F.lit(int(history_size) - 1), F.lit(1))
    out = hist.withColumn("_h", F.slice("_all", first, F.lit(int(history_size))))
    return out.select(
        *[F.col(f"req_{k}").alias(k) for k in asked], "PersonId",
        pad_left(F.col("_h"), history_size, etype).alias("history"),
        F.size("_h").cast("int").alias("history_len"))


def score_requests(events: DataFrame, requests: DataFrame, pdf: DataFrame,
                   as_of: datetime, *, extract_rows: int = PREDICT_EXTRACT_ROWS,
                   history_size: int = HISTORY_SIZE,
                   time_to_churn: float = BUCKET_EDGES_DAYS[-1]) -> DataFrame:
    """M03 for every (request, person): churn score at ``as_of``.

    A model does not choose rows, so histories are built per (account, application) and meet their
    models at the end.
    """
    wanted = cut_lineage(requests.select(*REQUEST_KEYS).distinct(), "wanted")
    hist = histories_per_request(request_extract(events, wanted.drop("ModelId")), as_of,
                                 extract_rows=extract_rows, history_size=history_size)
    models = wanted.select(F.col("AccountId").alias("_a"), F.col("ApplicationId").alias("_p"), "ModelId")
    hist = hist.join(models, (F.col("AccountId") == F.col("_a")) & F.col("ApplicationId").eqNullSafe(F.col("_p")))
    hist = hist.select(*REQUEST_KEYS, "PersonId", "history", "history_len")
    return score_histories(hist, pdf, ts_lit(as_of), time_to_churn)


def horizon_metrics(events: DataFrame, pdf: DataFrame, p: PrepParams,
                    time_to_churn: float = BUCKET_EDGES_DAYS[-1], by: Sequence[str] = ()) -> DataFrame:
    """A09 on the test set (H05): scores at the horizon against whether the person stayed away.

    A person has churned without an event in the ``time_to_churn`` days from the horizon on. With ``by``
    one row per key, all models at once.
    """
    tests = test_set_by(events, p, by) if by else test_set(events, p)
    scored = score_histories(tests, pdf, F.col("t0"), time_to_churn)
    away = epoch_us(F.col("next_event.OccurredTime")) - epoch_us("t0") >= F.lit(int(time_to_churn * DAY_US))
    return classification_metrics(
        scored.withColumn("actual", (F.col("next_event").isNull() | away).cast("int")), by=by)


@dataclass
class ChurnPipeline:
    """Fit on labelled samples, score persons at an explicit ``as_of`` (no default)."""

    history_size: int = HISTORY_SIZE
    extract_rows: int = PREDICT_EXTRACT_ROWS
    alpha: float = 1.0
    pdf: DataFrame | None = None

    def fit(self, train_samples: DataFrame) -> ChurnPipeline:
        self.pdf = cut_lineage(bucket_pdf(train_samples, alpha=self.alpha), "model")
        return self

    def score(self, events: DataFrame, requests: DataFrame, as_of: datetime) -> DataFrame:
        if self.pdf is None:
            raise ValueError("model is not trained")
        return score_requests(events, requests, self.pdf, as_of,
                              extract_rows=self.extract_rows, history_size=self.history_size)

    def save(self, spark: SparkSession, registry_path: str, account_id: int, model_id: str,
             trained_at: datetime) -> str:
        """Write the model's pdf rows and append a registry row (AccountId, ModelId, path, time).

        All models lie in one table, partitioned by account, model and day; training again on a
        day replaces that partition only.
        """
        models = os.path.join(registry_path, "models")
        day = trained_at.strftime("%Y-%m-%d")
        (self.pdf.withColumn("AccountId", F.lit(int(account_id)).cast("bigint"))
         .withColumn("ModelId", F.lit(str(model_id))).withColumn("trained_on", F.lit(day))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("AccountId", "ModelId", "trained_on").parquet(models))
        path = os.path.join(models, f"AccountId={account_id}", f"ModelId={model_id}", f"trained_on={day}")
        row = spark.createDataFrame(
            [(int(account_id), str(model_id), path, trained_at)],
            "AccountId long, ModelId string, model_path string, trained_at timestamp_ntz")
        row.write.mode("append").parquet(os.path.join(registry_path, "registry"))
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, **kw) -> ChurnPipeline:
        return cls(pdf=spark.read.parquet(path), **kw)


MODEL_KEY = ["AccountId", "ModelId"]


def save_models(pdf: DataFrame, registry_path: str, trained_at: datetime) -> None:
    """M05 for all models of a table (AccountId, ModelId, segment, n, pdf) in two writes.

    The models first, then their registry rows, so the registry names no model that is not there.
    """
    day = trained_at.strftime("%Y-%m-%d")
    models = os.path.join(registry_path, "models")
    (pdf.withColumn("trained_on", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("AccountId", "ModelId", "trained_on").parquet(models))
    path = F.concat(F.lit(f"{models}/AccountId="), F.col("AccountId").cast("string"), F.lit("/ModelId="), "ModelId",
                    F.lit(f"/trained_on={day}"))
    (pdf.select(F.col("AccountId").cast("bigint").alias("AccountId"), F.col("ModelId").cast("string").alias("ModelId"))
     .distinct().select("*", path.alias("model_path"), F.lit(trained_at).cast("timestamp_ntz").alias("trained_at"))
     .write.mode("append").parquet(os.path.join(registry_path, "registry")))


def trained_today(spark: SparkSession, registry_path: str, day: str) -> DataFrame:
    """(AccountId, ModelId) already trained on ``day`` - reuse instead of retraining."""
    reg = spark.read.parquet(os.path.join(registry_path, "registry"))
    return reg.where(F.to_date("trained_at") == F.lit(day).cast("date")).select(
        "AccountId", "ModelId").distinct()


MODELS_SCHEMA = ("segment string, n bigint, pdf array<double>, AccountId bigint, ModelId string, "
                 "trained_on string")


def latest_models(spark: SparkSession, registry_path: str, registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """pdf rows of the latest model of each distinct (AccountId, ModelId) in ``wanted``.

    Models are found by a join on the keys of the models table; no list of paths on the driver.
    """
    keys = ["AccountId", "ModelId"]
    latest = (registry.join(wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys)
              .agg(F.date_format(F.max("trained_at"), "yyyy-MM-dd").alias("trained_on")))
    models = spark.read.schema(MODELS_SCHEMA).parquet(os.path.join(registry_path, "models"))
    return models.join(latest, [*keys, "trained_on"], "left_semi").drop("trained_on")
