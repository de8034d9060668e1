"""Aggregates over the event log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.config import SECOND_US
from eventide.functions.time import epoch_us
from eventide.operators.positions import ranged_running_sum
from eventide.session import cut_lineage


#: distinct values that one task may order
ONE_RANGE = 100_000


def time_bounds(events: DataFrame) -> DataFrame:
    """One row (min_time, max_time) in a single scan."""
    return events.agg(F.min("OccurredTime").alias("min_time"),
                      F.max("OccurredTime").alias("max_time"))


def time_bounds_values(events: DataFrame) -> tuple[datetime, datetime]:
    """A01 as scalars on the driver (two values), so later filters become pushed literals."""
    row = time_bounds(events).first()
    return row["min_time"], row["max_time"]


def distinct_persons(events: DataFrame) -> DataFrame:
    """A02."""
    return events.select("PersonId").distinct()


def vocabulary(events: DataFrame, column: str = "DefinitionId") -> DataFrame:
    """Distinct values -> dense 0-based ids in sorted order, as a stored table.

    Numbered range by range, so no task orders more than ``ONE_RANGE`` values; up to that many are one
    range. Stored, so Spark knows the size of the table when it joins it.
    """
    vals = cut_lineage(events.where(F.col(column).isNotNull()).select(F.col(column).alias("token")).distinct(), "types")
    if vals.count() <= ONE_RANGE:
        rank = F.row_number().over(Window.orderBy("token"))
        return cut_lineage(vals.select("token", (rank - 1).cast("int").alias("token_id")), "vocab")
    ids = ranged_running_sum(vals.withColumn("_one", F.lit(1)), [], ["token"], "_one")
    return cut_lineage(ids.select("token", (F.col("running") - 1).cast("int").alias("token_id")), "vocab")


def time_mean_std(events: DataFrame) -> DataFrame:
    """Mean and sample std of event time in whole seconds, truncated toward zero.

    The mean is an exact decimal sum of microseconds; the std is computed on microseconds.
    """
    us = epoch_us("OccurredTime")
    return events.agg(
        (F.sum(us.cast("decimal(20,0)")) / F.count(us)).alias("_mean_us"),
        F.stddev_samp(us).alias("_std_us"),
    ).select(
        (F.col("_mean_us") / SECOND_US).cast("bigint").alias("mean"),
        (F.col("_std_us") / SECOND_US).cast("bigint").alias("std"),
    )


def sample_count(samples: DataFrame) -> DataFrame:
    """Number of distinct samples."""
    return samples.agg(F.count_distinct("PersonId", "t0").cast("bigint").alias("n_samples"))
