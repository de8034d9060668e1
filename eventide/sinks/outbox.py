"""Messages of a streaming batch, sent once however often the batch is repeated.

A batch that fails after its messages went out is run again with the same epoch. What a handler
sends is therefore named by (handler, query, epoch, step), and a ledger beside the topics knows the
names that are out:

1. the messages are written to a staging folder; its ``_SUCCESS`` file makes that final, and a repeated
   batch takes what lies there instead of computing it again;
2. the part files move into the topic under names of their own, one rename each; a repeated batch
   moves what is left;
3. the ledger entry is made, and the staging folder goes.

A crash between any two steps neither loses nor repeats a message of a file topic. Kafka sinks of
Spark have no transactions: there the entry follows the write, so a crash right between sends again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):  # noqa: ANN202 - a Hadoop file system and its Path class
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to


def run_name(batch: DataFrame, handler: str, epoch: int) -> str:
    """Names a run of a handler: the streaming query if there is one, and the epoch."""
    query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
    return f"{handler}-{query}-{int(epoch)}"


def is_sent(spark: SparkSession, ledger: str, topic: str, once: str) -> bool:
    fs, to = _files(spark, ledger)
    return fs.exists(to(f"{ledger}/_sent/{topic}/{once}"))


def mark_sent(spark: SparkSession, ledger: str, topic: str, once: str) -> None:
    fs, to = _files(spark, ledger)
    fs.mkdirs(to(f"{ledger}/_sent/{topic}"))
    fs.createNewFile(to(f"{ledger}/_sent/{topic}/{once}"))


def append_once(values: DataFrame, path: str, topic: str, once: str) -> bool:
    """Add the text rows of ``values`` to a file topic unless they are there; True if this call did."""
    if not re.fullmatch(r"[\w.-]+", once):
        raise ValueError(f"{once!r} cannot name a file")
    spark = values.sparkSession
    if is_sent(spark, path, topic, once):
        return False
    fs, to = _files(spark, path)
    staged = f"{path}/_staged/{topic}/{once}"
    if not fs.exists(to(f"{staged}/_SUCCESS")):
        values.write.mode("overwrite").text(staged)
    fs.mkdirs(to(f"{path}/{topic}"))
    for status in fs.listStatus(to(staged)):
        name = status.getPath().getName()
        if name.startswith("part-") and not fs.rename(status.getPath(), to(f"{path}/{topic}/{once}-{name}")):
            raise OSError(f"{topic}/{once}-{name} is there already")
    mark_sent(spark, path, topic, once)
    fs.delete(to(staged), True)
    return True
