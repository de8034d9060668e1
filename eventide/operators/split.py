"""Exact person-level train / validation split without a global sort.

Persons are ordered by (md5(seed:PersonId), PersonId); the first int(n * ratio) go to train.
The rank is computed as: a histogram over the first ``prefix_hex`` hex digits of the key
(at most 16**prefix_hex rows: a proven bound, so it is broadcast), a running total over that
small histogram, and a row_number inside each prefix. Global rank = persons in earlier prefixes
+ rank inside the prefix. Same result as a full sort, no single-partition window over persons.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.config import SPLIT_RATIO


def split_key(seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("PersonId").cast("string")))


def user_split(events: DataFrame, *, ratio: float = SPLIT_RATIO, seed: int = 42,
               prefix_hex: int = 4, by: Sequence[str] = ()) -> DataFrame:
    """PersonId -> split ('train' | 'validation') and the global rank.

    With ``by`` (such as AccountId, ModelId) the persons of every key are split for themselves, in the
    same jobs and as they would be alone.
    """
    persons = events.select(*by, "PersonId").distinct().withColumn("_key", split_key(seed))
    persons = persons.withColumn("_prefix", F.substring("_key", 1, prefix_hex))
    hist = persons.groupBy(*by, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    hist = hist.select(
        *by, "_prefix",
        F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_prefix").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*by)).alias("_total"),
    )
    inside = Window.partitionBy(*by, "_prefix").orderBy("_key", "PersonId")
    ranked = persons.withColumn("_r", F.row_number().over(inside))
    # one histogram is bounded; one per key is not
    joined = ranked.join(hist if by else F.broadcast(hist), [*by, "_prefix"])
    k = F.floor(F.col("_total") * F.lit(float(ratio)))
    rank = (F.col("_before") + F.col("_r")).cast("bigint")
    return joined.select(
        *by, "PersonId",
        rank.alias("split_rank"),
        F.when(rank <= k, F.lit("train")).otherwise(F.lit("validation")).alias("split"),
    )


def split_events(events: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the train persons and of the rest (validation)."""
    tagged = events.join(split.select("PersonId", "split"), "PersonId", "inner")
    train = tagged.where(F.col("split") == "train").drop("split")
    validation = tagged.where(F.col("split") == "validation").drop("split")
    return train, validation
