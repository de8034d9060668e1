"""Preprocessing jobs: test set (H05), train / validation sets (H06), whole run."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.config import DAY_US, Defaults
from eventide.functions.time import epoch_us, ts_lit
from eventide.session import checkpoint_dir, cut_lineage
from eventide.sinks.tables import input_state, rebalance, write_and_read, write_once
from eventide.operators.filters import time_cutoff
from eventide.operators.history import (histories_at, histories_for_samples, last_history_time,
                                        with_label)
from eventide.operators.sampling import person_summary, sample_points
from eventide.operators.split import user_split
from eventide.operators.stats import time_bounds_values, time_mean_std, vocabulary


@dataclass(frozen=True)
class PrepParams:
    horizon_days: int = 28
    history_size: int = 64
    split_ratio: float = 0.8
    seed: int = 42
    sample_buckets: int = 16
    chunk_days: float = 1.0
    label_from: str = "last_event"

    @classmethod
    def from_defaults(cls, d: Defaults, **kw) -> PrepParams:
        base = dict(horizon_days=d.horizon_days, history_size=d.history_size,
                    split_ratio=d.split_ratio, seed=d.seed, sample_buckets=d.sample_buckets,
                    chunk_days=d.time_chunk_days)
        base.update(kw)
        return cls(**base)


def test_set(events: DataFrame, p: PrepParams, max_time=None) -> DataFrame:
    """horizon = max - h; persons with an event in (horizon - h, horizon) (F03); H04.

    Each person's sample holds the last H events before the horizon, the first event at or
    after it, and the label (C03).
    """
    if max_time is None:
        _, max_time = time_bounds_values(events)
    horizon = max_time - timedelta(days=p.horizon_days)
    # F03 without a semi-join: "an event strictly inside (horizon - h, horizon)" is the same as
    # "the latest event before the horizon is later than horizon - h", and that event is the
    # last history entry of the per-person aggregate anyway.
    samples = histories_at(events, horizon, p.history_size).where(
        last_history_time() > ts_lit(horizon - timedelta(days=p.horizon_days)))
    return with_label(samples.withColumn("t0", ts_lit(horizon)), label_from=p.label_from)


def test_set_by(events: DataFrame, p: PrepParams, by: Sequence[str]) -> DataFrame:
    """H05 for every key of ``by`` in the same jobs, each at its own horizon."""
    persons = events.groupBy(*by, "PersonId").agg(F.min("OccurredTime").alias("_first"), F.max("OccurredTime").alias("_last"))
    persons = cut_lineage(persons, "persons")
    ends = persons.groupBy(*by).agg((F.max("_last") - F.expr(f"INTERVAL {int(p.horizon_days)} DAYS")).alias("t0"))
    samples = persons.join(ends, list(by)).where(F.col("_first") < F.col("t0")).select(*by, "PersonId", "t0")
    out = histories_for_samples(events, samples, p.history_size, chunk_days=p.chunk_days, by=by)
    recent = last_history_time() > F.col("t0") - F.expr(f"INTERVAL {int(p.horizon_days)} DAYS")
    return with_label(out.where(recent), label_from=p.label_from)


def prepared_samples(raw: DataFrame, p: PrepParams, group: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """P05 + J05/J06: sample (person, t0) over [data min, data max - h] and build histories.

    With ``group`` (a column such as the split) every group is sampled over its own range in
    the same jobs; a person must belong to one group. With ``by`` as well, this holds for every key of
    ``by`` by itself. The per-person summary is computed once
    and supplies both the time bounds and the sampling candidates; the sample points are a
    lineage cut.
    """
    g = [*by, group] if group else list(by)
    persons = cut_lineage(person_summary(raw, p.seed, p.sample_buckets, g), "persons")
    bounds = persons.groupBy(*g).agg(
        epoch_us(F.min("_first")).alias("_lo_us"),
        (epoch_us(F.max("_last")) - F.lit(p.horizon_days * DAY_US)).alias("_hi_us"))
    if not g:
        bounds = bounds.withColumn("_one", F.lit(1))
        persons = persons.withColumn("_one", F.lit(1))
    pts = sample_points(None, history_size=p.history_size, buckets=p.sample_buckets,
                        seed=p.seed, persons=persons,
                        group=g or "_one", bounds=bounds)
    pts = pts.drop("_one")
    log = raw.drop(group) if group else raw
    samples = histories_for_samples(log, pts, p.history_size, chunk_days=p.chunk_days, by=by)
    return with_label(samples, label_from=p.label_from)


def split_raw(events: DataFrame, p: PrepParams, max_time=None) -> DataFrame:
    """H06 first half: F01 at max - h, F02 at max - 2h, P01 split -> rows with a split column.

    F02 and the split share one person set: the persons with an event before max - 2h are
    split (P01), and a single inner join of the cut rows with that split table both keeps only
    those persons (F02) and tags their rows. A lineage cut: both splits and everything sampled
    from them read this table.
    """
    if max_time is None:
        _, max_time = time_bounds_values(events)
    cut = max_time - timedelta(days=p.horizon_days)
    before = time_cutoff(events, cut)
    persons = (time_cutoff(before, cut - timedelta(days=p.horizon_days))
               .select("PersonId").distinct())
    split = user_split(persons, ratio=p.split_ratio, seed=p.seed)
    tagged = before.join(split.select("PersonId", "split"), "PersonId", "inner")
    return cut_lineage(tagged, "split_raw")


def split_raw_by(events: DataFrame, p: PrepParams, by: Sequence[str]) -> DataFrame:
    """``split_raw`` for every key of ``by`` (such as AccountId, ModelId), each as it would be alone."""
    days = F.expr(f"INTERVAL {int(p.horizon_days)} DAYS")
    ends = cut_lineage(events.groupBy(*by).agg((F.max("OccurredTime") - days).alias("_cut")), "ends")
    before = events.join(ends, list(by)).where(F.col("OccurredTime") < F.col("_cut"))
    persons = before.where(F.col("OccurredTime") < F.col("_cut") - days).select(*by, "PersonId")
    split = user_split(persons, ratio=p.split_ratio, seed=p.seed, by=by)
    tagged = before.drop("_cut").join(split.select(*by, "PersonId", "split"), [*by, "PersonId"])
    return cut_lineage(tagged, "split_raw")


def train_validation_raw(events: DataFrame, p: PrepParams, max_time=None
                         ) -> tuple[DataFrame, DataFrame]:
    """The train rows and the validation rows of :func:`split_raw`."""
    tagged = split_raw(events, p, max_time)
    return (tagged.where(F.col("split") == "train").drop("split"),
            tagged.where(F.col("split") == "validation").drop("split"))


def train_validation_samples(events: DataFrame, p: PrepParams, by: Sequence[str] = ()) -> DataFrame:
    """H06 in one pass: train and validation samples with a ``split`` column.

    With ``by`` the samples of every key are those it would have alone, from the same jobs.

    Both sets go through the same sampling and history jobs keyed by split (each person is in
    exactly one split), instead of two separate runs of the whole chain.
    """
    if by:
        return prepared_samples(split_raw_by(events, p, by), p, group="split", by=by)
    return prepared_samples(split_raw(events, p), p, group="split")


def train_validation_sets(events: DataFrame, p: PrepParams, *, materialize=None
                          ) -> tuple[DataFrame, DataFrame]:
    """(train samples, validation samples). ``materialize(df, name)`` may write them."""
    both = train_validation_samples(events, p)
    if materialize is not None:
        both = materialize(both, "prepared_samples")
    return (both.where(F.col("split") == "train").drop("split"),
            both.where(F.col("split") == "validation").drop("split"))


#: raised when the layout or the meaning of the prepared sets changes
PREPARED_FORMAT = 1


def prepared_dir(spark: SparkSession) -> str:
    return os.path.join(checkpoint_dir(spark), "eventide-prepared")


def shared_train_validation(spark: SparkSession, input_path: str, load: Callable[[], DataFrame],
                            p: PrepParams) -> DataFrame:
    """H06 prepared once per input and parameters, in the shared folder, for all that read it.

    The table is partitioned by split. It is named by the input's present content and ``p``, so a
    changed input is prepared anew. ``drop_prepared`` removes all of them.
    """
    name = hashlib.sha256(f"{PREPARED_FORMAT} {input_state(spark, input_path)} {p!r}".encode()).hexdigest()[:32]
    return write_once(spark, os.path.join(prepared_dir(spark), f"samples-{name}"),
                      lambda: train_validation_samples(load(), p), "split")


def drop_prepared(spark: SparkSession) -> None:
    """Delete the prepared sets of this shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(prepared_dir(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def preprocess_dataset(spark: SparkSession, events: DataFrame, out_path: str, p: PrepParams,
                       *, vocab_from_training_only: bool = False) -> dict[str, str]:
    """Vocabulary, time statistics, test set, train / validation sets, written as tables.

    Stage tables double as lineage cuts (K01): each is written once and read back.
    """
    def mat(df: DataFrame, name: str) -> DataFrame:
        # AQE sizes the files (advisory partition size) instead of a fixed file count
        return write_and_read(spark, rebalance(df), f"{out_path}/{name}")

    vocab_src = events
    if vocab_from_training_only:
        _, mx = time_bounds_values(events)
        vocab_src = time_cutoff(events, mx - timedelta(days=p.horizon_days))
    mat(vocabulary(vocab_src), "vocab")
    mat(time_mean_std(events), "time_stats")
    mat(test_set(events, p), "test_prepared")
    train, validation = train_validation_sets(events, p, materialize=mat)
    mat(train, "train_prepared")
    mat(validation, "validation_prepared")
    return {k: f"{out_path}/{k}" for k in ("vocab", "time_stats", "test_prepared",
                                           "train_prepared", "validation_prepared")}
