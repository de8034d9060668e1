"""Day-bucket labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide.config import BUCKET_EDGES_DAYS, DAY_US
from eventide.functions.time import epoch_us


def day_bucket(delta_us: Column, edges_days: Sequence[int] = BUCKET_EDGES_DAYS) -> Column:
    """Index of the first edge with ``delta < edge`` (strict), else ``len(edges)``.

    A value on an edge goes to the upper bucket; a negative delta lands in bucket 0.
    """
    expr = F.lit(len(edges_days))
    for i in reversed(range(len(edges_days))):
        expr = F.when(delta_us < F.lit(int(edges_days[i]) * DAY_US), F.lit(i)).otherwise(expr)
    return expr.cast("int")


def next_event_label(
    next_time: Column,
    ref_time: Column,
    edges_days: Sequence[int] = BUCKET_EDGES_DAYS,
) -> Column:
    """No next event -> last bucket; else the bucket of ``next - ref``."""
    return (
        F.when(next_time.isNull(), F.lit(len(edges_days)))
        .otherwise(day_bucket(epoch_us(next_time) - epoch_us(ref_time), edges_days))
        .cast("int")
    )
