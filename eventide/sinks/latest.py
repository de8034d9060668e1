"""W01 kept up to date: the latest n rows per person as a stored table that grows by increments.

The full extract reads the whole log to find each person's latest rows. Here a table holds them, and an
increment reads only the rows past a stored mark: their own latest n per person (at most n rows of
a person leave a map task), merged with what is stored for the same persons. The latest n of
everything are the latest n of (stored latest n, new rows), so the table always equals the full
extract, whatever order events come in; a late event that is not among the latest n is dropped again.

The table is partitioned by a hash bucket of the person, and only buckets with new rows are read and
replaced. The mark is written last: an increment that fails is repeated from the old mark, and merging
the same rows again changes nothing. Equal rows are one row (A08). The mark column must grow with
arrival (a sequence number, an ingestion time); event times do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.extract import dedupe_events, latest_per_person
from eventide.session import cut_lineage, stages
from eventide.sinks.tables import path_exists

BUCKETS = 64


def stored_mark(spark: SparkSession, path: str):  # noqa: ANN201 - a value of the mark column's type
    """The mark up to which the table at ``path`` has read the log; None before the first increment."""
    if not path_exists(spark, f"{path}-mark/_SUCCESS"):
        return None
    return spark.read.parquet(f"{path}-mark").first()["mark"]


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def advance(log: DataFrame, path: str, n: int, *, mark: str, buckets: int = BUCKETS) -> int:
    """Bring the table at ``path`` up to the log; returns how many rows of the log were new."""
    spark = log.sparkSession
    with stages(spark):
        since = stored_mark(spark, path)
        new = log if since is None else log.where(F.col(mark) > F.lit(since))
        seen = new.agg(F.count(F.lit(1)).alias("n"), F.max(mark).alias("mark")).first()
        if not seen["n"]:
            return 0
        bucket = F.pmod(F.xxhash64("PersonId"), F.lit(int(buckets))).cast("int")
        top = cut_lineage(latest_per_person(dedupe_events(new.where(F.col(mark) <= F.lit(seen["mark"]))), n)
                          .withColumn("bucket", bucket), "latest-new")
        if path_exists(spark, path):
            touched = [r["bucket"] for r in top.select("bucket").distinct().collect()]  # at most ``buckets``
            old = spark.read.schema(top.schema).parquet(path).where(F.col("bucket").isin(touched))
            top = cut_lineage(latest_per_person(dedupe_events(old.select(*top.columns).unionByName(top)), n), "latest")
        (top.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(path))
        spark.createDataFrame([(seen["mark"],)], f"mark {log.schema[mark].dataType.simpleString()}").write.mode(
            "overwrite").parquet(f"{path}-mark")
        return seen["n"]
