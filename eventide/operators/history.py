"""History construction: last H events before t0 and the first event at or after t0.

* One shared t0 (H01 + H02 + H03, used by H04 / H05 / H08): a per-person top-H window
  (partial WindowGroupLimit before the shuffle) and a per-person ``min(struct)`` aggregate,
  joined on the shared person partitioning.
* Many t0 per person (J05 / J06, used by H06): positional design. Every event gets its 1-based
  position in its person's canonical order, every sample gets c = #events strictly before t0
  (samples sort before events of equal time). Each sample explodes the positions
  c-H+1 .. c+1 and equi-joins the events on (PersonId, position): H+1 rows per sample, no range
  join, no pairs. Positions come from the skew-safe chunked running count.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.config import BUCKET_EDGES_DAYS, DAY_US
from eventide.functions.labels import next_event_label
from eventide.functions.time import epoch_us, ts_lit
from eventide.operators.positions import chunked_running_sum
from eventide.session import cut_lineage

# element fields, in canonical sort order first (time, ticks, type, key)
HISTORY_FIELDS = ["OccurredTime", "OccurredTimeTicks", "DefinitionId", "EventKey",
                  "AccountId", "ApplicationId"]


def event_struct() -> Column:
    return F.struct(*[F.col(c) for c in HISTORY_FIELDS])


def _elem_type(events: DataFrame) -> T.StructType:
    return T.StructType([events.schema[c] for c in HISTORY_FIELDS])


def pad_left(arr: Column, size: int, elem_type: T.DataType) -> Column:
    """Left-pad an array with NULL elements up to ``size``."""
    n = F.coalesce(F.size(arr), F.lit(0))
    pad = F.array_repeat(F.lit(None).cast(elem_type), F.greatest(F.lit(size) - n, F.lit(0)))
    return F.concat(pad, F.coalesce(arr, F.array().cast(T.ArrayType(elem_type))))


def _t(t: Column | datetime) -> Column:
    return ts_lit(t)


def histories_at(events: DataFrame, t0: datetime, history_size: int, *,
                 include_empty: bool = False) -> DataFrame:
    """H01 + H02 at one t0 for every person.

    Returns PersonId, history (ARRAY<STRUCT> left-padded to H), history_len, next_event
    (STRUCT or NULL). Without ``include_empty`` only persons with an event before t0 appear
    (H04); with it every person does (H08).
    """
    t0c = _t(t0)
    etype = _elem_type(events)
    w = Window.partitionBy("PersonId").orderBy(*[F.col(c).desc() for c in HISTORY_FIELDS[:4]])
    top = (events.where(F.col("OccurredTime") < t0c)
           .withColumn("_rn", F.row_number().over(w))
           .where(F.col("_rn") <= F.lit(int(history_size))))
    hist = top.groupBy("PersonId").agg(F.sort_array(F.collect_list(event_struct())).alias("_h"))
    nxt = (events.where(F.col("OccurredTime") >= t0c).groupBy("PersonId")
           .agg(F.min(event_struct()).alias("next_event")))
    if include_empty:
        base = events.select("PersonId").distinct().join(hist, "PersonId", "left")
    else:
        base = hist
    out = base.join(nxt, "PersonId", "left")
    return out.select(
        "PersonId",
        pad_left(F.col("_h"), history_size, etype).alias("history"),
        F.coalesce(F.size("_h"), F.lit(0)).cast("int").alias("history_len"),
        "next_event",
    )


def next_event_at(events: DataFrame, t0: datetime) -> DataFrame:
    """H02 alone: per person the first event at or after t0, NULL when there is none."""
    t0c = _t(t0)
    return events.groupBy("PersonId").agg(
        F.min(F.when(F.col("OccurredTime") >= t0c, event_struct())).alias("next_event"))


def histories_for_samples(events: DataFrame, samples: DataFrame, history_size: int, *,
                          chunk_days: float = 1.0, materialize: bool = True,
                          by: Sequence[str] = ()) -> DataFrame:
    """J05 + J06 for many (PersonId, t0) samples (positional equi-join design).

    ``samples`` must be distinct on (PersonId, t0). Output: PersonId, t0, history,
    history_len, next_event, plus any extra sample columns carried through. With ``by`` (such as
    AccountId, ModelId) a person has a log of its own under every key, and so have its samples.
    """
    h = int(history_size)
    chunk_us = max(1, int(chunk_days * DAY_US))
    etype = _elem_type(events)
    person = ["PersonId", *by]
    extra = [c for c in samples.columns if c not in (*person, "t0")]
    ev = events.select(
        "PersonId", *[c for c in by if c not in HISTORY_FIELDS], epoch_us("OccurredTime").alias("_t"),
        F.lit(1).alias("_kind"), *HISTORY_FIELDS)
    # extra sample columns ride along on the sample rows (no join back to the samples)
    sm = samples.select(*person, epoch_us("t0").alias("_t"), F.lit(0).alias("_kind"),
                        "t0", *extra)
    u = ev.unionByName(sm, allowMissingColumns=True)
    order = [F.col("_t"), F.col("_kind"), F.col("OccurredTimeTicks"), F.col("DefinitionId"),
             F.col("EventKey")]
    r = chunked_running_sum(u, person, "_t", order, "_kind", chunk_us, out="_run")
    if materialize:
        r = cut_lineage(r, "event_positions")
    ev_pos = r.where(F.col("_kind") == 1).select(
        *person, F.col("_run").alias("_pos"), event_struct().alias("_e"))
    sm_c = r.where(F.col("_kind") == 0).select(*person, "t0", F.col("_run").alias("_c"),
                                               *extra)
    want = sm_c.select(
        *person, "t0", "_c", *extra,
        F.explode(F.sequence(F.greatest(F.col("_c") - F.lit(h - 1), F.lit(1)).cast("bigint"),
                             (F.col("_c") + 1).cast("bigint"))).alias("_pos"))
    got = want.join(ev_pos, [*person, "_pos"], "left")
    agg = got.groupBy(*person, "t0").agg(
        F.sort_array(F.collect_list(F.when(F.col("_pos") <= F.col("_c"), F.col("_e"))))
        .alias("_h"),
        F.max(F.when(F.col("_pos") == F.col("_c") + 1, F.col("_e"))).alias("next_event"),
        *[F.first(c).alias(c) for c in extra],
    )
    return agg.select(
        *person, "t0",
        pad_left(F.col("_h"), h, etype).alias("history"),
        F.size("_h").cast("int").alias("history_len"),
        "next_event", *extra,
    )


def last_history_time(history: str = "history") -> Column:
    """Time of the most recent history entry (NULL for an empty history)."""
    return F.element_at(F.col(history), -1).getField("OccurredTime")


def with_label(samples: DataFrame, *, label_from: str = "last_event",
               edges_days=BUCKET_EDGES_DAYS) -> DataFrame:
    """C03 on a sample frame.

    ``label_from="last_event"`` (default) measures from the last history event; ``"t0"`` from
    the sample time. An empty history has no label (NULL).
    """
    ref = last_history_time() if label_from == "last_event" else F.col("t0")
    lab = next_event_label(F.col("next_event.OccurredTime"), ref, edges_days)
    return samples.withColumn(
        "label", F.when(F.col("history_len") > 0, lab).otherwise(F.lit(None).cast("int")))


def days_since_last(as_of: Column, history: str = "history") -> Column:
    """C13 on the last history entry."""
    return (epoch_us(as_of) - epoch_us(last_history_time(history))) / float(DAY_US)
