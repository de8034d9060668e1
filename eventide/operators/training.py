"""Training rows: token ids and epoch seconds per history entry (C05 with C01 / C04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions.time import epoch_us
from eventide.session import cut_lineage


def training_rows(samples: DataFrame, vocab: DataFrame) -> DataFrame:
    """samples (history, label, ...) -> action_ids ARRAY<INT>, times ARRAY<BIGINT>, label.

    Padding and unknown tokens map to the vocabulary size; padded times stay NULL. Histories are
    exploded and equi-joined with the vocabulary, whatever its size: Spark broadcasts it where its
    measured size allows. Rows that repeat are kept apart by a row number.
    """
    size = vocab.count()
    secs = F.floor(epoch_us(F.col("_e.OccurredTime")) / F.lit(1_000_000)).cast("bigint")
    keep = [c for c in samples.columns if c != "history"]
    rows = cut_lineage(samples.withColumn("_row", F.monotonically_increasing_id()), "rows")
    ex = rows.select("_row", F.posexplode("history").alias("_i", "_e"))
    v = vocab.select(F.col("token").alias("_tok"), "token_id")
    j = ex.join(v, F.col("_e.DefinitionId") == F.col("_tok"), "left")
    g = j.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(
        "_i", F.coalesce("token_id", F.lit(size)).cast("int").alias("_a"), secs.alias("_s")))).alias("_z"))
    out = rows.drop("history").join(g, "_row", "left")
    return out.select(*keep, F.coalesce(F.col("_z._a"), F.array().cast("array<int>")).alias("action_ids"),
                      F.coalesce(F.col("_z._s"), F.array().cast("array<bigint>")).alias("times"))
