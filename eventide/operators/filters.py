"""Time filters and person-level predicates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.config import DAY_US
from eventide.functions.time import add_us, ts_lit


def _t(t: Column | datetime) -> Column:
    return ts_lit(t)


def time_cutoff(events: DataFrame, threshold: datetime) -> DataFrame:
    """rows strictly before ``threshold`` (a literal, so it reaches the parquet scan)."""
    return events.where(F.col("OccurredTime") < _t(threshold))


def persons_with_history(events: DataFrame, threshold: datetime,
                         latest_event_delta_days: float | None = None) -> DataFrame:
    """Every row of the persons that have an event before ``threshold``.

    With ``latest_event_delta_days`` the event must lie strictly inside
    ``(threshold - delta, threshold)``. Planned as a left-semi join against the distinct
    qualifying persons: a filtered, partially aggregated key set, never a shuffle of whole rows
    for the predicate itself.
    """
    cond = F.col("OccurredTime") < _t(threshold)
    if latest_event_delta_days is not None:
        lower = add_us(_t(threshold), -int(round(latest_event_delta_days * DAY_US)))
        cond = cond & (F.col("OccurredTime") > lower)
    persons = events.where(cond).select("PersonId").distinct()
    return events.join(persons, "PersonId", "left_semi")


def persons_active_in_window(events: DataFrame, threshold: datetime, delta_days: float
                             ) -> DataFrame:
    """rows of persons with an event in the open interval (threshold - delta, threshold)."""
    return persons_with_history(events, threshold, latest_event_delta_days=delta_days)
