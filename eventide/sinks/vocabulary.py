"""A03 / C01 across retrainings: a vocabulary that only grows.

Numbering types anew by their order shifts all ids when one type comes in, and a model that was
trained on the old ids reads wrong types. Here the ids are stored: new types get the next free
numbers, in sorted order among themselves; an id is never changed nor given again. Types are
compared with the stored table by an anti-join, and only the new ones are numbered.

One writer at a time. An append is one Spark write, so a run that fails has added all of its types or none, and
a repeated run finds them stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.operators.positions import ranged_running_sum
from eventide.session import cut_lineage, stages
from eventide.sinks.tables import path_exists

SCHEMA = "token string, token_id int"


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], SCHEMA)


def grow(events: DataFrame, path: str, column: str = "DefinitionId") -> int:
    """Add the types of ``events`` that are not stored yet; returns how many. NULL is no type."""
    spark = events.sparkSession
    with stages(spark):
        stored = read_vocabulary(spark, path)
        new = events.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("token")).distinct()
        new = cut_lineage(new.join(stored, "token", "left_anti"), "new-types")
        n = new.count()
        if n:
            free = (stored.agg(F.max("token_id")).first()[0] or 0) + 1 if path_exists(spark, path) else 0
            ids = ranged_running_sum(new.withColumn("_one", F.lit(1)), [], ["token"], "_one")
            (ids.select("token", (F.col("running") - 1 + F.lit(free)).cast("int").alias("token_id"))
             .write.mode("append").parquet(path))
        return n
