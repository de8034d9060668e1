"""Which events a stored feed may already hold: Bloom filters beside the feed.

The feed is partitioned by account and day. Beside it lies a table of filters, one set per append,
account and day: 4 KB bitmaps (32,768 bits) of which each holds about ``PER_BITMAP`` events, chosen by
one hash of the event; ``HASHES`` further hashes choose bits inside it. A new event whose bits are not all
set in any set of its account and day is certainly new and is stored without a look at the feed.
Only the others, repeats and a few chance hits, are compared with the stored events, and of the
feed only the days of these are read. So one event of last year costs one filter and, if it is
a repeat, one old day.

Filters are made with Spark's bitmap functions (``bitmap_construct_agg``) and looked up by equi-joins
on (account, day, bitmap). They are written before the events they describe: a filter without
its events, left by a crash, makes events compared exactly that need not be; an event without its
filter never exists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.session import cut_lineage
from eventide.sinks.tables import path_exists

KEY = ["AccountId", "day"]
BITS = 32_768
PER_BITMAP = 2_000
HASHES = 4


def _name(cols: Sequence[str]) -> Column:
    """One text per event; NULL and text are told apart."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def _places(n_maps: Column, cols: Sequence[str]) -> tuple[Column, Column]:
    """(bitmap, bits inside it) of an event among ``n_maps`` bitmaps."""
    name = _name(cols)
    bits = F.array(*[F.pmod(F.xxhash64(name, F.lit(i)), F.lit(BITS)) for i in range(1, HASHES + 1)])
    return F.pmod(F.xxhash64(name, F.lit(0)), n_maps).cast("int"), bits


def filters(events: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(AccountId, day, n_maps, map, bits) of distinct events with a ``day``; ``bits`` is a 4 KB bitmap."""
    sizes = events.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / F.lit(PER_BITMAP)).cast("int").alias("n_maps"))
    same = F.col("AccountId").eqNullSafe(F.col("_a")) & F.col("day").eqNullSafe(F.col("_d"))
    rows = events.join(sizes.select(F.col("AccountId").alias("_a"), F.col("day").alias("_d"), "n_maps"), same)
    which, bits = _places(F.col("n_maps"), cols)
    each = rows.select(*KEY, "n_maps", which.alias("map"), F.explode(bits).alias("_bit")).distinct()
    return each.groupBy(*KEY, "n_maps", "map").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def _is_set(bitmap: str, bit: Column) -> Column:
    """The bit that ``bitmap_construct_agg`` sets for a position."""
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def maybe_stored(events: DataFrame, filter_table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``events`` with ``maybe``: False only for events that no filter has seen.

    The filters of the batch's own accounts and days are read, nothing else; the sets of an account and day
    differ in ``n_maps``, so an event asks one bitmap of each size.
    """
    own = events.select(*KEY).distinct()
    table = filter_table.join(own, KEY, "left_semi")
    # sets of one size are laid over each other: a bit is set if any append has set it
    merged = cut_lineage(table.groupBy(*KEY, "n_maps", "map").agg(F.bitmap_or_agg("bits").alias("bits")), "filters")
    sizes = merged.select(*KEY, F.col("n_maps").alias("_n")).distinct()
    asked = events.withColumn("_row", F.monotonically_increasing_id())
    asked = cut_lineage(asked, "asked")
    which, bits = _places(F.col("_n"), cols)
    probes = asked.join(sizes, KEY).select("_row", *KEY, F.col("_n").alias("n_maps"), which.alias("map"), bits.alias("_bits"))
    hit = probes.join(merged, [*KEY, "n_maps", "map"]).where(
        F.forall("_bits", lambda b: _is_set("bits", b))).select("_row").distinct().withColumn("maybe", F.lit(True))
    return asked.join(hit, "_row", "left").withColumn("maybe", F.coalesce("maybe", F.lit(False))).drop("_row")


def new_events(events: DataFrame, feed: str, filter_path: str, cols: Sequence[str]) -> DataFrame:
    """The distinct ``events`` (``cols`` and ``day``) that the stored feed does not hold."""
    spark = events.sparkSession
    if not path_exists(spark, feed) or not path_exists(spark, filter_path):
        if path_exists(spark, feed):
            raise FileNotFoundError(f"{feed} has no filters at {filter_path}")
        return events
    checked = cut_lineage(maybe_stored(events, spark.read.parquet(filter_path), cols), "checked")
    suspects = checked.where("maybe").drop("maybe")
    days = [r["day"] for r in suspects.select("day").distinct().collect()]  # dates, a few thousand at most
    if not days:
        return checked.drop("maybe")
    stored = spark.read.schema(events.schema).parquet(feed).where(F.col("day").isin(days)).select(
        *[F.col(c).alias(f"_{c}") for c in [*cols, "day"]])
    same = F.col("day") == F.col("_day")
    for c in cols:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return checked.where("not maybe").drop("maybe").unionByName(suspects.join(stored, same, "left_anti"))
