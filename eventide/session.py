"""Spark session construction and cluster-safe checkpoint handling."""

from __future__ import annotations

import contextlib
import contextvars
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class StageTables:
    """The stage tables of one job. Only their owner removes them, whatever other threads do."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def drop(self, spark: SparkSession) -> None:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        paths, self.paths = self.paths, []
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


#: the owner of what a thread stores now; a new thread begins outside of any ``stages`` block
_OWNER: contextvars.ContextVar[StageTables | None] = contextvars.ContextVar("stage_tables", default=None)
_UNOWNED = StageTables()


def build_session(
    master: str | None = None,
    *,
    app_name: str = "eventide",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Session with AQE, skew-join handling, UTC and no UI.

    On a cluster pass ``master=None`` and let spark-submit decide; locally pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(64 * 1024 * 1024),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # a broadcast is only ever requested explicitly for size-bounded tables
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    }
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("EVENTIDE_DRIVER_MEMORY", "8g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(executors: int = 1000, cores_per_executor: int = 8) -> dict[str, str]:
    """Settings for a large cluster (100 TB class inputs); pass as ``extra`` to build_session.

    * Shuffle partitions start at ~3 per core and AQE coalesces them to 256 MB targets, so
      partitions fit executor memory without a per-job guess; skewed partitions are split.
    * Scan splits of 256 MB keep the task count of a 100 TB scan near 400k.
    * No automatic broadcast beyond 64 MB: explicit broadcasts are only used for tables with a
      proven bound (see README); AQE may still switch a join to broadcast from measured sizes.
    * ``spark.checkpoint.dir`` is left to the cluster (shared storage); it is never set here.
    """
    cores = executors * cores_per_executor
    return {
        "spark.sql.shuffle.partitions": str(3 * cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
        "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2",
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.session.timeZone": "UTC",
    }


def use_utc(spark: SparkSession) -> None:
    """All event times are zone-less; epoch arithmetic goes through a UTC cast."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, which this library only reads.

    Where it is unset, a single-machine session (``local[...]``) gets a scratch folder, once; any
    other session is an error, since executors could not see each other's files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="eventide-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def stage_path(spark: SparkSession, name: str) -> str:
    """A new place for a table in the shared folder, removed with the stage tables of its block."""
    path = os.path.join(checkpoint_dir(spark), "eventide-stages", f"{name}-{uuid.uuid4().hex}")
    (_OWNER.get() or _UNOWNED).paths.append(path)
    return path


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once as a Parquet table under ``spark.checkpoint.dir`` and read it back.

    Used where a result is read more than once: the plan stops growing, the stage is computed
    exactly once, later readers get column pruning, and a lost executor does not force
    recomputation of what lies before. The table belongs to the innermost ``stages`` block of this
    thread and goes with it; outside of any block it stays until ``drop_stages``.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def drop_stages(spark: SparkSession) -> None:
    """Delete the stage tables written outside of any ``stages`` block.

    To be called when the results built on them have been written or collected, and no other thread
    works outside of a block.
    """
    _UNOWNED.drop(spark)


@contextlib.contextmanager
def stages(spark: SparkSession) -> Iterator[StageTables]:
    """Stage tables that this thread writes inside the block are removed at its end, also after an error."""
    own = StageTables()
    before = _OWNER.set(own)
    try:
        yield own
    finally:
        _OWNER.reset(before)
        own.drop(spark)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_timed_state(spark: SparkSession) -> None:
    """State with timers lives in RocksDB stores; queries started from now on use them."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
