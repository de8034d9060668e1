"""Token -> id lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_ids(events: DataFrame, vocab: DataFrame, column: str = "DefinitionId",
              out: str = "token_id") -> DataFrame:
    """Left join on the vocabulary; unknown or NULL tokens get id = vocabulary size.

    ``vocab`` is a stored table of one row per distinct event type, so Spark knows its size: it is
    broadcast below ``spark.sql.autoBroadcastJoinThreshold``, where the events are not shuffled on
    their few types, and joined by shuffle beyond it. Its number of rows is read as a scalar.
    """
    size = vocab.count()
    v = vocab.select(F.col("token").alias(column), F.col("token_id").alias("_tid"))
    j = events.join(v, column, "left")
    return j.withColumn(out, F.coalesce(F.col("_tid"), F.lit(size)).cast("int")).drop("_tid")
