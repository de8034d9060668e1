"""Mixing sources to target weights by Efraimidis-Spirakis sampling (operator 5), JVM-side only.

Every source gets a target in words from its weight; a target stops at ``max_epochs`` times the
source's size and the excess goes to the other sources by weight. A source gives as many complete
epochs as fit, then a fraction: its documents in the order of exponential keys -ln(u) / quality,
summed until the rest of the target is reached. u comes from a hash of the doc_id and a seed, so
reruns agree.

Prefix sums never put a source into one task. The keys of a source are dealt to ranges of about
``ROWS_PER_RANGE`` rows through the distribution function of its keys, which is known from the
counts of its (quantised) quality weights; sums run inside a range, after the totals of the ranges
before it. Only tables of one row per source and per range go through a window by source.

The number of sources is the size of the mixing plan and is taken to fit in one task. A null source
is a source, the last one. Null text has size 0. Rows without an id or with equal ids have equal
keys and are ordered by size; equal rows are interchangeable. A document whose source has no words
takes 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventide.llm.common import n_words, read
from eventide.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix"
ROWS_PER_RANGE = 4096
#: document weights: labelled good, not labelled, labelled poor
QUALITY = (1.0, 0.5, 0.25)


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """u in (0, 1) from 48 bits of a hash of the id."""
    hexes = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(hexes, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): repeated labels count as good if any is; null quality as not labelled."""
    good, plain, poor = QUALITY
    best = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max("quality").alias("q"))
    return best.select("_id", F.when(F.col("q") > 0, good).when(F.col("q") <= 0, poor).otherwise(plain)
                       .alias("_weight"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> plus target.

    With r = max_epochs * size / weight, the sources stopped at their cap are those of smallest r.
    Going up r, the level (words per unit of weight) left for the rest is (total - caps before) /
    weights from here. It rises while r lies below it and falls after, so its maximum is the level
    of the sources that stay free.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", max_epochs * F.col("source_size").cast("double"))
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = (t.withColumn("total", F.sum("source_size").over(everything).cast("double"))
         .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after)))
    t = t.withColumn("level", F.max("level").over(everything))
    return t.select("source", "source_size",
                    F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``docs(doc_id, source, size, weight, ...)`` plus source_size, target, epochs, selected, taken.

    ``docs`` is read several times: pass a stored table. ``weight`` is positive. The document that
    crosses the rest of the target is taken if that brings the source nearer to it. Ties of keys go
    by doc_id (nulls first), then size.
    """
    own = docs.columns
    key = -F.log(uniform(F.col("doc_id"))) / F.col("weight")
    # weights on a grid of eighths of a doubling; its counts give the distribution of the keys
    grid = F.round(F.log2("weight") * 8).cast("int")
    keyed = docs.withColumn("_key", key)
    counts = docs.groupBy("source", grid.alias("g")).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    per_source = counts.groupBy("source").agg(
        F.sum("n").alias("n"), F.sum("s").alias("source_size"),
        F.sort_array(F.collect_list(F.struct(F.pow(F.lit(2.0), F.col("g") / 8).alias("w"), "n"))).alias("levels"))
    # the plan has one row per source: a stored table whose size Spark knows before it joins
    plan = cut_lineage(
        per_source.select("source", "n", "levels").withColumnRenamed("source", "_s")
        .join(targets(per_source.select("source", "source_size"), weights, max_epochs),
              F.col("_s").eqNullSafe(F.col("source"))).drop("source"), "mix-plan")
    below = F.aggregate("levels", F.lit(0.0),
                        lambda acc, x: acc + x["n"] * (1 - F.exp(-x["w"] * F.col("_key")))) / F.col("n")
    n_ranges = F.ceil(F.col("n") / rows_per_range)
    placed = (keyed.join(plan, F.col("source").eqNullSafe(F.col("_s")))
              .withColumn("_range", F.least(F.floor(below * n_ranges), n_ranges - 1)))
    sums = placed.groupBy("_s", "_range").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_s").alias("_s2"), F.col("_range").alias("_r2"),
                         F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    inside = (Window.partitionBy("_s", "_range").orderBy("_key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run = (placed.withColumn("_upto", F.sum("size").over(inside))
           .join(starts, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_range") == F.col("_r2"))))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    upto = F.col("_start") + F.col("_upto")
    return (run.withColumn("epochs", epochs.cast("long"))
            .withColumn("selected", (F.col("size") > 0) & (F.col("epochs") < max_epochs)
                        & (upto - F.col("size") / 2 <= rest))
            .withColumn("taken", F.col("size") * (F.col("epochs") + F.col("selected").cast("long")))
            .select(*own, "source_size", "target", "epochs", "selected", "taken"))


def sized(docs: DataFrame, labels: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` plus size and the quality weight of each document."""
    slim = docs.select(*carry, n_words(F.col("text")).alias("size"))
    return (slim.join(quality_weights(labels), F.col("doc_id").cast("long") == F.col("_id"), "left")
            .withColumn("weight", F.coalesce("_weight", F.lit(QUALITY[1]))).drop("_id", "_weight"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5: every document with its source's target and the words taken from it."""
    docs = cut_lineage(sized(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"),
                             ["doc_id", "source"]), "mix-sizes")
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it, with the columns of ``docs``."""
    rows = docs.select("doc_id", "source", "text", F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.row_index").alias("_row"))
    slim = cut_lineage(sized(rows, read(spark, sf_dir, "labels"), ["doc_id", "source", "_file", "_row"]),
                       "mix-sizes")
    times = mix(slim).select(F.col("_file").alias("_f"), F.col("_row").alias("_r"),
                             (F.col("epochs") + F.col("selected").cast("long")).alias("_times")).where("_times > 0")
    there = docs.select(*docs.columns, F.col("_metadata.file_path").alias("_file"),
                        F.col("_metadata.row_index").alias("_row"))
    return (there.join(times, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r")))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
           FROM documents),
l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
      FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c),
t AS (SELECT source, source_size,
             least(cap, max(lv) OVER () * weight) AS target FROM v),
k AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
             -ln((('0x' || substr(md5('mix:' || d.doc_id), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
               / CASE WHEN q > 0 THEN 1.0 WHEN q <= 0 THEN 0.25 ELSE 0.5 END::DOUBLE AS key
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN l ON d.doc_id = l.doc_id),
p AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size
                                ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, source, size, source_size, target,
       size * (epochs + CASE WHEN size > 0 AND epochs < 3 AND upto - size / 2.0 <= target - epochs * source_size
                             THEN 1 ELSE 0 END) AS taken
FROM p
"""
