"""Exact duplicate removal as a stateful stream (operator 4), JVM-side only.

Arrivals are (digest, stable identifier, content locator). A streaming aggregation keyed by digest
keeps, in a RocksDB state store without watermark (so no key ever expires), the smallest identifier
with its locator and the number of copies. The state lies under the given folder and survives
restarts: ``remember`` may be called again with further arrivals. ``known`` reads the state as a
table. A digest held by several rows is a *hit*: the full normalised texts are compared, byte for
byte, with the text of the row that the state names, and any digest whose texts differ is grouped
again by the texts themselves, so results do not rest on the digest.

Rows are one text when equal after each run of ``[\\x20\\x09-\\x0D]`` became one space; null counts
as the empty text. The identifier orders by doc_id (null last), then locator. Rows that repeat the
smallest doc_id of a group are all marked kept (they are one document); ``stage`` keeps the first
of them. An empty table gives no rows.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import SPACE, read
from eventide.session import checkpoint_dir, cut_lineage

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # a store is closed once its batch is in the shared folder: executors hold open stores of running tasks only
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
ARRIVAL = "digest string, doc_id long, file string, row long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")


def sha256(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def identifier(doc_id: str = "doc_id") -> Column:
    """Orders by doc_id with nulls last, then by locator."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), "file", "row")


def _with_conf(spark: SparkSession, conf: dict[str, str]) -> dict[str, str | None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    return before


def _restore(spark: SparkSession, before: dict[str, str | None]) -> None:
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def remember(spark: SparkSession, arrivals: str, state: str, bytes_per_batch: int = 64 << 30) -> None:
    """Run every arrival file not seen yet through the keyed state under ``state``, then stop.

    ``arrivals`` is a folder of Parquet files of ARRIVAL rows; files are taken in bounded
    micro-batches, and a restart after a failure continues at the last committed batch.
    """
    before = _with_conf(spark, STATE_CONF)
    try:
        stream = (spark.readStream.schema(ARRIVAL).option("maxBytesPerTrigger", bytes_per_batch)
                  .parquet(arrivals).groupBy("digest")
                  .agg(F.min(identifier()).alias("first"), F.count("*").alias("copies")))
        (stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        _restore(spark, before)


def known(spark: SparkSession, state: str) -> DataFrame:
    """(digest, first, copies) for every digest ever seen."""
    kept = spark.read.format("statestore").load(state)
    value = [f.name for f in kept.schema["value"].dataType.fields]
    return kept.select(F.col("key.digest").alias("digest"), F.col(f"value.{value[0]}").alias("first"),
                       F.col(f"value.{value[1]}").alias("copies"))


def located(docs: DataFrame, carry: list[str], digest: Column | None = None) -> DataFrame:
    """``carry`` columns plus digest, file, row and norm; ``docs`` is read from Parquet files.

    The locator is the file and the row's place in it. ``digest`` replaces SHA-256 (tests use a
    poor one to force collisions).
    """
    norm = normalised(F.col("text"))
    return docs.select(*carry, norm.alias("norm"), (sha256(norm) if digest is None else digest).alias("digest"),
                       F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def exact_groups(docs: DataFrame, digest: Column | None = None, state: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, file, row, keep_id, group_size, kept, first_row, text_sha256.

    ``first_row`` marks the one row of the group that stays when doc_ids repeat.
    """
    spark = docs.sparkSession
    base = os.path.join(checkpoint_dir(spark), f"exact-{uuid.uuid4().hex}")
    state = state or f"{base}/state"
    id_ = F.col("doc_id").cast("long").alias("doc_id")
    full = located(docs, [id_], digest)
    slim = ["digest", "doc_id", "file", "row"]
    full.select(*slim, sha256(F.col("norm")).alias("sha") if digest is not None else F.col("digest").alias("sha")
                ).write.parquet(f"{base}/arrivals")
    arrivals = spark.read.parquet(f"{base}/arrivals")
    remember(spark, f"{base}/arrivals", state)
    seen = cut_lineage(known(spark, state), "exact-known")
    # full texts of the rows whose digest the state holds more than once
    hits = seen.where("copies > 1").select("digest", "first")
    is_first = (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    texts = cut_lineage(full.select(*slim, "norm").join(hits, "digest")
                        .select("digest", "norm", is_first.alias("is_first")), "exact-hits")
    firsts = texts.where("is_first").select(F.col("digest").alias("_digest"), F.col("norm").alias("_norm"))
    differ = (texts.where("not is_first").join(firsts, F.col("digest") == F.col("_digest"))
              .where("norm <> _norm").select("digest"))
    # stored before distinct(), which would keep Spark from splitting a digest of many copies
    differ = cut_lineage(differ, "exact-collisions").distinct()
    same = seen.join(differ, "digest", "left_anti")
    plain = arrivals.join(same, "digest").select(*slim, "sha", "first", "copies")
    # exact way for digests that stand for several texts
    clash = full.join(differ, "digest", "left_semi").select(*slim, "norm", sha256(F.col("norm")).alias("sha"))
    by_text = clash.groupBy(F.col("digest").alias("_digest"), F.col("norm").alias("_norm")).agg(
        F.min(identifier()).alias("first"), F.count("*").alias("copies"))
    again = (clash.join(by_text, (F.col("digest") == F.col("_digest")) & (F.col("norm") == F.col("_norm")))
             .select(*slim, "sha", "first", "copies"))
    rows = plain.unionAll(again)
    return rows.select(
        "doc_id", "file", "row", F.col("first.doc_id").alias("keep_id"), F.col("copies").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("first.doc_id")).alias("kept"),
        ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))).alias("first_row"),
        F.col("sha").alias("text_sha256"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op4: every document with the one that stays for its text."""
    return exact_groups(read(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the first row of each text, with the columns of ``docs``."""
    gone = exact_groups(docs).where("not first_row").select("file", "row")
    there = docs.select(*docs.columns, F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.row_index").alias("_row"))
    return (there.join(gone, (F.col("_file") == F.col("file")) & (F.col("_row") == F.col("row")), "left_anti")
            .select(*docs.columns))


EXACT_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
           FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
