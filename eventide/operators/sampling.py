"""Sampling of (person, t0) points.

Persons fall into ``buckets`` fixed logical buckets by md5 (replacing physical partitions, so
the sample does not depend on file layout). Per bucket:

* budget = floor(rows / H) + 1 slots (A06);
* t0 range [max(min_time, bucket min), min(bucket max + 1 day, max_time)); each slot draws a
  whole second from md5(seed:bucket:slot:t) (P02); an empty or negative range gives the end;
* candidates at t0 are the bucket's persons with first event <= t0 (F06). Ordered by
  (first_ts, PersonId) they form a prefix, so their number is a running count over the union
  of persons and slots, and the pick is the person at rank floor(u * count) with
  u from md5(seed:bucket:slot:p) - an equi-join on (bucket, rank). No cross join.

A slot with no candidate yields no sample. Samples are distinct on (PersonId, t0).
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.config import DAY_US, SECOND_US
from eventide.functions.time import epoch_us, from_epoch_us, ts_lit
from eventide.operators.positions import hex8_int, hex8_uniform, ranged_running_sum, seeded
from eventide.session import cut_lineage

SLOT_BATCH = 1_000_000


def person_bucket(seed: int, buckets: int) -> Column:
    return F.pmod(hex8_int(seeded(seed, "b", F.col("PersonId"))), F.lit(int(buckets)))


def random_second(lo_us: Column, hi_us: Column, u: Column) -> Column:
    """A whole second drawn from [lo, hi) as µs; ``hi`` when the range is under 1 s."""
    range_s = F.floor((hi_us - lo_us) / F.lit(SECOND_US))
    return F.when(range_s <= 0, hi_us).otherwise(
        lo_us + F.floor(u * range_s).cast("bigint") * F.lit(SECOND_US))


def _columns(group: str | Sequence[str] | None) -> list[str]:
    return [] if group is None else [group] if isinstance(group, str) else list(group)


def person_summary(events: DataFrame, seed: int, buckets: int, group: str | Sequence[str] | None = None
                   ) -> DataFrame:
    """One row per person (and group): first / last event time, row count, logical bucket."""
    g = _columns(group)
    persons = events.groupBy("PersonId", *g).agg(
        F.min("OccurredTime").alias("_first"), F.max("OccurredTime").alias("_last"),
        F.count(F.lit(1)).alias("_rows"))
    return persons.withColumn("bucket", person_bucket(seed, buckets))


def sample_points(events: DataFrame | None, *, min_time: datetime | Column | None = None,
                  max_time: datetime | Column | None = None, history_size: int,
                  buckets: int = 16, seed: int = 42,
                  persons: DataFrame | None = None, materialize: bool = True,
                  group: str | Sequence[str] | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """(PersonId, t0, [group,] bucket, slot).

    ``persons`` may be a precomputed :func:`person_summary` (it is read twice: bucket totals
    and candidate ranks). With ``group`` (e.g. the split) buckets, budgets and t0 ranges are
    per group and ``bounds`` gives each group's range as (group, _lo_us, _hi_us) - one row per
    group, broadcast for one column of groups. With ``materialize`` the running counts are a lineage cut, since both the
    person ranks and the slot picks are read from them.
    """
    g = _columns(group)
    if persons is None:
        persons = person_summary(events, seed, buckets, group)
    bstats = persons.groupBy(*g, "bucket").agg(
        F.sum("_rows").alias("_rows"), F.min("_first").alias("_bmin"),
        F.max("_last").alias("_bmax"))
    if bounds is not None:
        bstats = bstats.join(F.broadcast(bounds) if len(g) == 1 else bounds, g)
        lo, hi = F.col("_lo_us"), F.col("_hi_us")
    else:
        lo, hi = epoch_us(ts_lit(min_time)), epoch_us(ts_lit(max_time))
    bstats = bstats.select(
        *g, "bucket",
        (F.floor(F.col("_rows") / F.lit(int(history_size))) + 1).cast("bigint").alias("_budget"),
        F.greatest(epoch_us("_bmin"), lo).alias("_lo"),
        F.least(epoch_us("_bmax") + F.lit(DAY_US), hi).alias("_hi"),
    )
    # two-level slot generation: batches first (spread by a shuffle), then slots per batch
    batches = bstats.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                  F.floor((F.col("_budget") - 1) / F.lit(SLOT_BATCH))
                                  .cast("bigint"))).alias("_batch"))
    batches = batches.repartition(*g, "bucket", "_batch")
    slots = batches.select(
        *g, "bucket", "_lo", "_hi",
        F.explode(F.sequence(F.col("_batch") * SLOT_BATCH,
                             F.least(F.col("_budget"), (F.col("_batch") + 1) * SLOT_BATCH) - 1))
        .alias("slot"))
    slots = slots.select(
        *g, "bucket", "slot",
        random_second(F.col("_lo"), F.col("_hi"),
                      hex8_uniform(seeded(seed, F.col("bucket"), F.col("slot"), "t")))
        .alias("_t"))
    # union persons (kind 0, at first_ts) and slots (kind 1, at t0); persons first on ties (<=)
    pu = persons.select(*g, "bucket", epoch_us("_first").alias("_t"), F.lit(0).alias("_kind"),
                        "PersonId", F.lit(None).cast("bigint").alias("slot"))
    su = slots.select(*g, "bucket", "_t", F.lit(1).alias("_kind"),
                      F.lit(None).cast("bigint").alias("PersonId"), "slot")
    u = pu.unionByName(su).withColumn("_isp", (1 - F.col("_kind")).cast("bigint"))
    # by ranges of rows: in a young log nearly all persons have their first event on one day
    r = ranged_running_sum(u, [*g, "bucket"], ["_t", "_kind", "PersonId", "slot"], "_isp", out="_run")
    if materialize:
        r = cut_lineage(r, "sample_ranks")
    ranked = r.where(F.col("_kind") == 0).select(*g, "bucket", "PersonId",
                                                 (F.col("_run") - 1).alias("_rank"))
    picks = r.where((F.col("_kind") == 1) & (F.col("_run") > 0)).select(
        *g, "bucket", "slot", "_t",
        F.floor(hex8_uniform(seeded(seed, F.col("bucket"), F.col("slot"), "p"))
                * F.col("_run")).cast("bigint").alias("_rank"))
    chosen = picks.join(ranked, [*g, "bucket", "_rank"], "inner")
    return (chosen.groupBy("PersonId", "_t", *g)
            .agg(F.min("bucket").alias("bucket"), F.min("slot").alias("slot"))
            .select("PersonId", from_epoch_us("_t").alias("t0"), *g, "bucket", "slot"))
