"""Readers: driver tables and event parquet -> the canonical event frame."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions.time import epoch_us
from eventide.schema import EVENT_SCHEMA
from eventide.session import use_utc


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _canonical(cols: dict[str, Column]) -> list[Column]:
    return [cols[f.name].cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA.fields]


def events_from_events_table(df: DataFrame) -> DataFrame:
    """`events` as an event log: user -> person, event_type -> action, ts -> time.

    AccountId = user_id % 5; ApplicationId from props.k (k % 3 = 0 -> NULL, 1 -> app1,
    2 -> app2); ModelId = 'churn-' || user_id % 2; EventKey = event_id.
    """
    k = F.get_json_object(F.col("props"), "$.k").cast("bigint")
    return df.select(
        *_canonical(
            {
                "AccountId": F.col("user_id") % 5,
                "ApplicationId": F.when(k % 3 == 1, F.lit("app1"))
                .when(k % 3 == 2, F.lit("app2"))
                .otherwise(F.lit(None).cast("string")),
                "ModelId": F.concat(F.lit("churn-"), (F.col("user_id") % 2).cast("string")),
                "DefinitionId": F.col("event_type"),
                "OccurredTime": F.col("ts"),
                "OccurredTimeTicks": epoch_us("ts"),
                "PersonId": F.col("user_id"),
                "EventKey": F.col("event_id"),
            }
        )
    )


def events_from_orders_table(df: DataFrame) -> DataFrame:
    """`orders` as an event log: customer -> person, priority -> action, order date -> time."""
    return df.select(
        *_canonical(
            {
                "AccountId": F.col("o_custkey") % 5,
                "ApplicationId": F.col("o_orderstatus"),
                "ModelId": F.concat(F.lit("churn-"), (F.col("o_custkey") % 2).cast("string")),
                "DefinitionId": F.col("o_orderpriority"),
                "OccurredTime": F.col("o_orderdate"),
                "OccurredTimeTicks": epoch_us("o_orderdate"),
                "PersonId": F.col("o_custkey"),
                "EventKey": F.col("o_orderkey"),
            }
        )
    )


ADAPTERS = {"events": events_from_events_table, "orders": events_from_orders_table}


def load_events(spark: SparkSession, sf_dir: str, source: str = "events") -> DataFrame:
    """Canonical event frame from one of the driver tables."""
    return ADAPTERS[source](read_table(spark, sf_dir, source))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan of raw / processed event data with the declared schema."""
    use_utc(spark)
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def account_events(events: DataFrame, account_id: int, application_id: str | None = None
                   ) -> DataFrame:
    """One account's rows; the application filter applies only when it is non-empty.

    Typed literals (never string-built SQL), so both predicates reach the parquet scan.
    """
    out = events.where(F.col("AccountId") == F.lit(int(account_id)))
    if application_id is not None and application_id != "":
        out = out.where(F.col("ApplicationId") == F.lit(str(application_id)))
    return out


def read_jdbc_events(spark: SparkSession, url: str, table: str, *, account_id: int,
                     application_id: str | None = None, latest_n: int | None = None,
                     partition_column: str = "PersonId", num_partitions: int = 64,
                     fetchsize: int = 1_000_000, properties: dict[str, str] | None = None) -> DataFrame:
    """Parallel extract from a SQL store, split on a numeric column.

    The splits lie between the account's smallest and largest value of that column, which the store
    computes. Account and application are DataFrame filters, so Spark pushes them into each
    partition's query; repeats and all but the ``latest_n`` rows of a person go on Spark's side.
    """
    use_utc(spark)

    def reader(**options):
        return spark.read.format("jdbc").options(url=url, fetchsize=fetchsize, **(properties or {}), **options)

    ends = reader(query=f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi "
                        f"FROM {table} WHERE AccountId = {int(account_id)}").load().first()
    split = {} if ends[0] is None else {"partitionColumn": partition_column, "numPartitions": num_partitions,
                                        "lowerBound": int(ends[0]), "upperBound": int(ends[1]) + 1}
    return extracted(reader(dbtable=table, **split).load(), account_id, application_id, latest_n)


def extracted(rows: DataFrame, account_id: int, application_id: str | None = None,
              latest_n: int | None = None) -> DataFrame:
    """S01 + A08 + W01: an account's distinct rows, the latest of each person if asked for."""
    from eventide.operators.extract import dedupe_events, latest_per_person

    out = dedupe_events(account_events(rows, account_id, application_id))
    return latest_per_person(out, latest_n) if latest_n else out


def read_prepared(spark: SparkSession, out_path: str) -> dict[str, DataFrame]:
    """The tables written by the preprocessing run (vocabulary, time statistics, sets)."""
    names = ("vocab", "time_stats", "test_prepared", "train_prepared", "validation_prepared")
    return {n: spark.read.parquet(os.path.join(out_path, n)) for n in names}
