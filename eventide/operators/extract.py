"""Extract-side operators: dedupe, latest-n per person, canonical layout, registry, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.schema import ORDER_COLUMNS


def dedupe_events(events: DataFrame) -> DataFrame:
    """Exact duplicate removal over every column (a hash aggregate with map-side combine)."""
    return events.dropDuplicates()


def latest_per_person(events: DataFrame, n: int, *, person: str = "PersonId") -> DataFrame:
    """Latest ``n`` rows per person by ticks (then time, key) descending.

    ``row_number() <= n`` plans as a partial WindowGroupLimit before the person shuffle, so a
    person with a huge share of the rows ships at most ``n`` rows per map task.
    """
    w = Window.partitionBy(person).orderBy(
        F.col("OccurredTimeTicks").desc(), F.col("OccurredTime").desc(),
        F.col("DefinitionId").desc(), F.col("EventKey").desc())
    return (events.withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= F.lit(int(n))).drop("_rn"))


def cluster_by_person(events: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Rows ordered by person, then canonical event order, clustered by person.

    Range partitioning on (PersonId, time, ...) keeps each person's rows contiguous and in
    order across the output files, and - unlike a hash partitioning on PersonId - splits a
    person holding a large share of the rows over several partitions by time.
    """
    keys = ["PersonId", *ORDER_COLUMNS]
    parts = (events.repartitionByRange(num_partitions, *keys) if num_partitions
             else events.repartitionByRange(*keys))
    return parts.sortWithinPartitions(*keys)


def canonical_events(events: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Typed account id, duplicates removed, clustered and ordered by person."""
    typed = events.withColumn("AccountId", F.col("AccountId").cast("bigint"))
    return cluster_by_person(dedupe_events(typed), num_partitions)


def with_event_seq(events: DataFrame, chunk_days: float = 1.0) -> DataFrame:
    """1-based canonical order number of each event inside its person.

    Computed with the chunked running count (windows per person and time chunk plus per-chunk
    offsets), so a very active person is numbered by many tasks.
    """
    from eventide.config import DAY_US
    from eventide.functions.time import epoch_us
    from eventide.operators.positions import chunked_running_sum

    d = events.withColumn("_t", epoch_us("OccurredTime")).withColumn("_one", F.lit(1))
    out = chunked_running_sum(d, ["PersonId"], "_t", [F.col("_t"), *ORDER_COLUMNS[1:]], "_one",
                              max(1, int(chunk_days * DAY_US)), out="seq")
    return out.withColumn("seq", F.col("seq").cast("int")).drop("_t", "_one")


def registered_models(events: DataFrame) -> DataFrame:
    """Distinct (AccountId, ModelId, ApplicationId)."""
    return events.select("AccountId", "ModelId", "ApplicationId").dropDuplicates()


def account_counts(events: DataFrame, accounts: DataFrame | None = None, *,
                   with_time: bool = False) -> DataFrame:
    """Rows per account. With ``accounts`` given, an account without rows keeps NULL.

    ``with_time`` adds the time of the count (the tracker's poll time in a live run).
    """
    counts = events.groupBy("AccountId").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
    if with_time:
        counts = counts.withColumn("counted_at", F.localtimestamp())
    if accounts is None:
        return counts
    return accounts.select("AccountId").dropDuplicates().join(counts, "AccountId", "left")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """A small preview (the limit is the feature here)."""
    return df.limit(int(n))
