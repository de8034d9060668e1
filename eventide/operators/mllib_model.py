"""M01(b) / M02: next-event-bucket classifier with ``pyspark.ml`` (multinomial logistic regression).

Features per sample, all built with Column expressions: counts of each event type in the
history (CountVectorizer over the history's type tokens, fitted on the training samples), the
cyclic + z-scored time features of the last history event (C09), the history length and the
days from the last event to t0. The fitted probability vector is the bucket pdf used by C12.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.config import BUCKET_EDGES_DAYS
from eventide.functions.churn import churn_probability
from eventide.functions.time import epoch_seconds, time_features
from eventide.operators.history import days_since_last, last_history_time

N_CLASSES = len(BUCKET_EDGES_DAYS) + 1
NUMERIC = ["history_len_d", "days_d", "day_sin", "day_cos", "week_sin", "week_cos",
           "month_sin", "month_cos", "year_sin", "year_cos", "z"]


def featurize(samples: DataFrame, mean: float, std: float) -> DataFrame:
    """Column-only feature frame; empty histories are dropped (no reference time, Q9)."""
    s = samples.where(F.col("history_len") > 0)
    secs = epoch_seconds(last_history_time())
    feats = time_features(secs, F.lit(float(mean)), F.lit(float(max(std, 1))))
    return s.select(
        "*",
        F.filter(F.transform("history", lambda x: x.getField("DefinitionId")),
                 lambda t: t.isNotNull()).alias("tokens"),
        F.col("history_len").cast("double").alias("history_len_d"),
        days_since_last(F.col("t0")).alias("days_d"),
        *[c.alias(n) for n, c in feats])


def fit_classifier(train: DataFrame, mean: float, std: float, *, max_iter: int = 50,
                   reg: float = 0.01) -> PipelineModel:
    """Fit on labelled training samples (distributed L-BFGS in MLlib)."""
    data = featurize(train.where(F.col("label").isNotNull()), mean, std).withColumn(
        "label_d", F.col("label").cast("double"))
    pipe = Pipeline(stages=[
        # every event type: the default would drop the rarer ones beyond 262,144
        CountVectorizer(inputCol="tokens", outputCol="type_counts", minDF=1.0, vocabSize=2**31 - 1),
        VectorAssembler(inputCols=["type_counts", *NUMERIC], outputCol="features",
                        handleInvalid="keep"),
        LogisticRegression(featuresCol="features", labelCol="label_d", family="multinomial",
                           maxIter=max_iter, regParam=reg),
    ])
    return pipe.fit(data)


def predict_pdf(model: PipelineModel, samples: DataFrame, mean: float, std: float) -> DataFrame:
    """M03 with the fitted classifier: pdf ARRAY<DOUBLE>(6) (zeros for classes never seen)."""
    out = model.transform(featurize(samples, mean, std))
    p = vector_to_array(F.col("probability"))
    pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(N_CLASSES) - F.size(p), F.lit(0)))
    return out.withColumn("pdf", F.slice(F.concat(p, pad), 1, N_CLASSES))


def churn_from_classifier(model: PipelineModel, samples: DataFrame, mean: float, std: float
                          ) -> DataFrame:
    """Churn probability at each sample's t0 from the classifier's pdf."""
    pred = predict_pdf(model, samples, mean, std)
    return pred.withColumn("score", churn_probability(F.col("pdf"), F.col("days_d")))
