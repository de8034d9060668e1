"""Table sinks: stage boundaries, resized files, run layout."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.session import stages

RUN_PARTITIONS = ["AccountId", "ApplicationId", "ModelId", "dt"]
RUN_TYPES = {"AccountId": T.LongType(), "ApplicationId": T.StringType(), "ModelId": T.StringType(),
             "dt": T.StringType()}
ORDER = ("PersonId", "OccurredTime", "OccurredTimeTicks", "DefinitionId", "EventKey")


def write_and_read(spark: SparkSession, df: DataFrame, path: str, *, mode: str = "overwrite",
                   max_records_per_file: int | None = None) -> DataFrame:
    """Write parquet, then read it back: a lineage cut that survives executor loss."""
    w = df.write.mode(mode)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    w.parquet(path)
    return spark.read.parquet(path)


def input_state(spark: SparkSession, path: str) -> str:
    """What names the present content of an input: place, length and time of every file below it.

    The files' facts are read as a table (no contents), so many files need no loop on the driver.
    """
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fact = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    n, total, digest = files.agg(F.count(F.lit(1)), F.sum("length"), F.sum(fact)).first()
    return f"{fs.makeQualified(p).toString()} {n} {total} {digest}"


def write_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
    """The table at ``path``, built if it is not there yet or was left incomplete.

    It is written beside its place and moved there when complete, so readers never see a part of
    it; of two writers at a time one wins and the other's table is dropped.
    """
    if not path_exists(spark, f"{path}/_SUCCESS"):
        own = f"{path}-{uuid.uuid4().hex}"
        with stages(spark):
            build().write.partitionBy(*partition_by).parquet(own)
        to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(to(path)) and not fs.exists(to(f"{path}/_SUCCESS")):
            fs.delete(to(path), True)
        if fs.exists(to(path)) or not fs.rename(to(own), to(path)):
            fs.delete(to(own), True)
    return spark.read.parquet(path)


def rebalance(df: DataFrame, *cols: str) -> DataFrame:
    """Let AQE size the output files (advisoryPartitionSizeInBytes) via REBALANCE."""
    return df.hint("rebalance", *cols) if cols else df.hint("rebalance")


def _one_form(c: str) -> Column:
    """The empty string and NULL are one key of the layout."""
    return F.when(F.col(c) != "", F.col(c))


def write_run_table(df: DataFrame, path: str, dt: str, order: tuple[str, ...] = ORDER) -> None:
    """Run layout partitioned by account / application / model / date.

    Dynamic partition overwrite replaces only the partitions present in ``df``. Rows are ranged and
    sorted by layout columns, then ``order``: every file keeps the person order, files of a
    partition do not overlap, and a task writes to few partitions.
    """
    keys = [*RUN_PARTITIONS, *[c for c in order if c in df.columns]]
    (df.withColumn("ApplicationId", _one_form("ApplicationId")).withColumn("dt", F.lit(dt))
     .repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic")
     .partitionBy(*RUN_PARTITIONS).parquet(path))


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_run_table(spark: SparkSession, path: str, *, account_id: int | None = None,
                   model_id: str | None = None, dt: str | None = None) -> DataFrame:
    """K03 read with partition pruning; layout columns keep their declared types ("007" stays text)."""
    found = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, RUN_TYPES.get(f.name, f.dataType)) for f in found])
    df = spark.read.schema(schema).parquet(path)
    if account_id is not None:
        df = df.where(F.col("AccountId") == F.lit(int(account_id)))
    if model_id is not None:
        df = df.where(F.col("ModelId") == F.lit(model_id))
    if dt is not None:
        df = df.where(F.col("dt") == F.lit(dt))
    return df


def partitions_present(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Which (AccountId, ApplicationId, ModelId, dt) already have data (skip list).

    Keys match null-safe; a NULL and an empty application are the same key.
    """
    if not path_exists(spark, path):
        return keys.limit(0)
    there = read_run_table(spark, path).select(*[F.col(c).alias(f"_{c}") for c in RUN_PARTITIONS]).distinct()
    cond = _one_form("ApplicationId").eqNullSafe(F.col("_ApplicationId"))
    for c in ("AccountId", "ModelId", "dt"):
        cond &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return keys.join(there, cond, "left_semi")


def write_extract(df: DataFrame, path: str, *, chunk_rows: int = 1_000_000) -> None:
    """S03 / W03 output: person-clustered parquet in files of at most ``chunk_rows`` rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", int(chunk_rows)).parquet(path)
