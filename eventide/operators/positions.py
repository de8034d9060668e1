"""Skew-safe running counts and md5-derived uniform numbers.

A running count "per person, ordered by time" written as one window puts every row of a person
into one task; with one person holding a third of the rows that task is a third of the job.
Here the time axis is cut into chunks: the window runs per (key, chunk) and each chunk adds the
total of the earlier chunks of its key, taken from a small per-(key, chunk) aggregate. The
result is identical to the single window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.session import cut_lineage


def hex8_uniform(text: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of md5(text) (identical in DuckDB)."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hex8_int(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def seeded(seed: int | str, *parts: Column | str | int) -> Column:
    """``seed:part1:part2...`` as text, for md5-based draws (Columns or literal parts)."""
    cols: list[Column] = [F.lit(str(seed))]
    for p in parts:
        cols.append(F.lit(":"))
        cols.append(p.cast("string") if isinstance(p, Column) else F.lit(str(p)))
    return F.concat(*cols)


def chunked_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    time_us: str,
    order: Sequence[Column | str],
    weight: str,
    chunk_us: int,
    out: str = "running",
) -> DataFrame:
    """``sum(weight) over (partition by keys order by order rows unbounded preceding)``.

    ``order`` must start with ``time_us`` so the chunk order agrees with the row order.
    """
    keys = list(keys)
    d = df.withColumn("_chunk", F.floor(F.col(time_us) / F.lit(int(chunk_us))).cast("bigint"))
    per_chunk = d.groupBy(*keys, "_chunk").agg(F.sum(weight).alias("_w"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = per_chunk.select(*keys, "_chunk",
                               F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_local", F.sum(weight).over(local))
    return (d.join(offsets, [*keys, "_chunk"], "inner")
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_chunk", "_off", "_local"))


def ranged_running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str,
                       out: str = "running") -> DataFrame:
    """The running sum of :func:`chunked_running_sum` when nothing bounds the rows of a time chunk.

    Rows are dealt to ranges of (keys, order) of about equal size, summed inside a range, and
    offset by the totals of the key's ranges before it. The ranges are stored, since their bounds
    come from a sample; no task orders more than one range.
    """
    keys = list(keys)
    d = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (d.groupBy(*keys, "_range").agg(F.sum(weight).alias("_w"))
               .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"),
                       F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off")))
    local = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (d.withColumn("_local", F.sum(weight).over(local)).join(offsets, same)
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
            .drop("_range", "_r", "_off", "_local", *[f"_k_{k}" for k in keys]))
