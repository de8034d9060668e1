"""Quality metrics over scored rows (A09) and validation loss (A10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.session import cut_lineage


def classification_metrics(scored: DataFrame, *, score: str = "score", actual: str = "actual",
                           threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """[by,] auc, f1, precission, recall, accuracy (the message's field spelling), n.

    AUC is the rank-sum statistic with ties counted half, over the exact scores. Equal scores are
    summed first; the distinct scores are dealt to ranges, counted inside each range, and offset by
    the totals of the ranges below, so no task orders more than one range.
    """
    rows = scored.where(F.col(score).isNotNull()).select(
        *by, F.col(score).alias("_s"), F.col(actual).cast("int").alias("_y"))
    per_score = rows.groupBy(*by, "_s").agg(
        F.sum(F.col("_y")).alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    ranged = cut_lineage(per_score.repartitionByRange(*by, "_s").withColumn("_p", F.spark_partition_id()),
                         "scores")
    lower = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    start = ranged.groupBy(*by, "_p").agg(F.sum("_neg").alias("_n")).select(
        *by, "_p", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_start"))
    below = Window.partitionBy(*by, "_p").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    terms = (ranged.withColumn("_in", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
             .join(start, [*by, "_p"])
             .select(*by, "_s", "_pos", "_neg",
                     (F.col("_pos") * (F.col("_start") + F.col("_in") + 0.5 * F.col("_neg"))).alias("_t")))
    hi = F.col("_s") >= F.lit(threshold)
    m = terms.groupBy(*by).agg(
        (F.sum("_t") / F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0))).alias("auc"),
        F.sum(F.when(hi, F.col("_pos")).otherwise(0)).cast("double").alias("tp"),
        F.sum(F.when(hi, F.col("_neg")).otherwise(0)).cast("double").alias("fp"),
        F.sum(F.when(~hi, F.col("_pos")).otherwise(0)).cast("double").alias("fn"),
        F.sum(F.when(~hi, F.col("_neg")).otherwise(0)).cast("double").alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    prec = tp / F.nullif(tp + fp, F.lit(0.0))
    rec = tp / F.nullif(tp + fn, F.lit(0.0))
    return m.select(
        *by, "auc",
        (2 * prec * rec / F.nullif(prec + rec, F.lit(0.0))).alias("f1"),
        prec.alias("precission"),
        rec.alias("recall"),
        ((tp + tn) / F.nullif(tp + tn + fp + fn, F.lit(0.0))).alias("accuracy"),
        (tp + fp + fn + tn).cast("bigint").alias("n"),
    )


def mean_log_loss(samples_with_pdf: DataFrame) -> DataFrame:
    """A10: mean of -ln(pdf[label]) over labelled samples."""
    lab = samples_with_pdf.where(F.col("label").isNotNull())
    return lab.agg(
        F.avg(-F.log(F.element_at(F.col("pdf"), F.col("label") + 1))).alias("log_loss"),
        F.count(F.lit(1)).cast("bigint").alias("n"))
