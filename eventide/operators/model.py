"""Next-event-bucket model and churn scoring (M01a, M03, C12 applied), as Spark jobs.

M01a: the empirical pdf of the label per segment with Laplace smoothing - a group-by over the
labelled training samples. The segment is the type of the last history event; a global row
(segment ``*``) serves segments never seen in training.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.config import BUCKET_EDGES_DAYS
from eventide.functions.churn import churn_probability
from eventide.operators.history import days_since_last
from eventide.session import cut_lineage

GLOBAL_SEGMENT = "*"


def segment_of(history: str = "history") -> Column:
    return F.element_at(F.col(history), -1).getField("DefinitionId")


def bucket_pdf(samples: DataFrame, *, alpha: float = 1.0,
               n_classes: int = len(BUCKET_EDGES_DAYS) + 1, by: Sequence[str] = ()) -> DataFrame:
    """[by,] segment, n, pdf ARRAY<DOUBLE>(n_classes). Samples without a label are dropped (Q9).

    With ``by`` (AccountId, ModelId) every key has a model of its own, all counted in one job.
    """
    lab = samples.where(F.col("label").isNotNull()).select(
        *by, segment_of().alias("segment"), "label")
    both = lab.unionByName(lab.withColumn("segment", F.lit(GLOBAL_SEGMENT)))
    counts = both.groupBy(*by, "segment").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.when(F.col("label") == k, 1).otherwise(0)).alias(f"_c{k}")
          for k in range(n_classes)])
    denom = F.col("n") + F.lit(alpha * n_classes)
    return counts.select(
        *by, "segment", F.col("n").cast("bigint").alias("n"),
        F.array(*[(F.col(f"_c{k}") + F.lit(alpha)) / denom for k in range(n_classes)])
        .alias("pdf"))


def attach_pdf(df: DataFrame, pdf: DataFrame) -> DataFrame:
    """Segment pdf with a fallback to the model's global row.

    When the pdf table carries model keys (AccountId, ModelId - several saved models scored in
    one job) the join includes them. The pdf table has one row per (model, event type), and
    AQE turns the join into a broadcast at run time only when its measured size allows.
    """
    keys = [k for k in ("AccountId", "ModelId") if k in pdf.columns and k in df.columns]
    if not keys:
        pdf = cut_lineage(pdf, "pdf")  # read twice: its training chain runs once
    seg = pdf.select(*keys, F.col("segment").alias("_seg"), F.col("pdf").alias("_pdf_seg"))
    glob = pdf.where(F.col("segment") == GLOBAL_SEGMENT).select(
        *keys, F.col("segment").alias("_g"), F.col("pdf").alias("_pdf_all"))
    out = df.withColumn("_seg", segment_of()).join(seg, [*keys, "_seg"], "left")
    if keys:
        out = out.withColumn("_g", F.lit(GLOBAL_SEGMENT)).join(glob, [*keys, "_g"], "left")
    else:
        # exactly one global row (group-by key '*'): read it as a scalar, use it as a literal
        row = glob.first()  # of the stored table
        fallback = (F.array(*[F.lit(float(v)) for v in row["_pdf_all"]]) if row is not None
                    else F.lit(None).cast("array<double>"))
        out = out.withColumn("_pdf_all", fallback)
    return out.withColumn("pdf", F.coalesce("_pdf_seg", "_pdf_all")).drop(
        "_seg", "_g", "_pdf_seg", "_pdf_all")


def score_histories(hist: DataFrame, pdf: DataFrame, as_of: Column,
                    time_to_churn: float = BUCKET_EDGES_DAYS[-1]) -> DataFrame:
    """Days since the last event (C13) -> churn probability (C12) per row.

    Empty history -> NULL score (Q9); a person idle beyond the CDF tail scores 1.
    """
    scored = attach_pdf(hist, pdf).withColumn("days", days_since_last(as_of))
    return scored.withColumn(
        "score", F.when(F.col("history_len") > 0,
                        churn_probability(F.col("pdf"), F.col("days"), time_to_churn)))
