"""M01, order of events: a variable-order context tree over history suffixes.

A symbol is an event's type and the day bucket of the gap to the event before it (``f`` for the first
one of a history). The context of depth d is the last d symbols, newest first; the root is the empty
context. The tree is one table, keyed by context: label counts of the training samples that end so,
and a label distribution that mixes the orders:

    p(root) = (counts + 1) / (n + classes)
    p(c)    = (counts + strength * p(parent of c)) / (n + strength)

so a context seen often speaks for itself and a rare one mostly as its parent does. Contexts with
fewer than ``least`` samples are not stored; a stored context's parent has at least its samples and is
stored too, so the distribution of a sample is that of its longest stored context.

Scale: counts are pre-aggregated in the map tasks (depth + 1 rows per sample); levels are mixed with
one join per depth on the parent. Lookups resolve each distinct full context once, by equi-joins
on the context, and samples meet the resolved table by their full context; the root, which every sample has, is
a literal. With ``by`` (such as AccountId, ModelId) many trees live in one table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.config import BUCKET_EDGES_DAYS
from eventide.functions.labels import day_bucket
from eventide.functions.time import epoch_us
from eventide.session import cut_lineage

N_CLASSES = len(BUCKET_EDGES_DAYS) + 1
DEPTH, STRENGTH, LEAST = 3, 64.0, 4


def symbols(depth: int = DEPTH, history: str = "history") -> Column:
    """The newest ``depth`` symbols of a history (fewer where it is shorter), newest first.

    Padding entries are NULL; an event without a type is a symbol of its own.
    """
    events = F.filter(F.col(history), lambda e: e.isNotNull())
    newest = F.reverse(F.slice(events, F.greatest(F.size(events) - depth, F.lit(1)), depth + 1))

    def symbol(e: Column, i: Column) -> Column:
        older = F.try_element_at(newest, (i + 2).cast("int")).getField("OccurredTime")
        gap = day_bucket(epoch_us(e.getField("OccurredTime")) - epoch_us(older))
        return F.concat(F.coalesce(e.getField("DefinitionId"), F.lit("")), F.lit("~"),
                        F.when(older.isNull(), "f").otherwise(gap.cast("string")))

    return F.when(F.size(events) > 0, F.slice(F.transform(newest, symbol), 1, depth)).otherwise(
        F.array().cast("array<string>"))


def _contexts(full: str) -> Column:
    """Every depth of a full context: explodes to (depth, context)."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.size(full)), lambda d: F.struct(
        d.alias("depth"), F.slice(full, 1, d).alias("context")))).alias("_x")


def context_counts(samples: DataFrame, *, depth: int = DEPTH, by: Sequence[str] = ()) -> DataFrame:
    """(by, context, depth, n, counts): label counts of every context of the labelled samples."""
    seen = samples.where("label is not null").select(*by, symbols(depth).alias("_full"), "label")
    # equal full contexts are one row per label before they are spread over the depths
    seen = seen.groupBy(*by, "_full", "label").agg(F.count(F.lit(1)).alias("_n"))
    each = seen.select(*by, "label", "_n", _contexts("_full")).select(*by, "label", "_n", "_x.*")
    return each.groupBy(*by, "context", "depth").agg(
        F.sum("_n").alias("n"),
        F.array(*[F.sum(F.when(F.col("label") == k, F.col("_n")).otherwise(0)) for k in range(N_CLASSES)])
        .alias("counts"))


def context_tree(samples: DataFrame, *, depth: int = DEPTH, strength: float = STRENGTH, least: int = LEAST,
                 by: Sequence[str] = ()) -> DataFrame:
    """(by, context, depth, n, pdf): the stored contexts with mixed label distributions."""
    counts = cut_lineage(context_counts(samples, depth=depth, by=by).where(
        (F.col("depth") == 0) | (F.col("n") >= least)), "contexts")
    own = [*by, "context", "depth", "n"]
    level = counts.where("depth = 0").select(*own, F.transform(
        "counts", lambda c: (c + F.lit(1.0)) / (F.col("n") + F.lit(float(N_CLASSES)))).alias("pdf"))
    levels = [level]
    for d in range(1, depth + 1):
        above = level.select(*by, F.col("context").alias("_parent"), F.col("pdf").alias("_above"))
        here = counts.where(F.col("depth") == d).withColumn("_parent", F.slice("context", 1, d - 1))
        level = here.join(above, [*by, "_parent"]).select(*own, F.zip_with(
            "counts", "_above", lambda c, p: (c + F.lit(strength) * p) / (F.col("n") + F.lit(strength))).alias("pdf"))
        level = cut_lineage(level, f"contexts-{d}")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def attach_context_pdf(samples: DataFrame, tree: DataFrame, *, depth: int = DEPTH, by: Sequence[str] = ()) -> DataFrame:
    """``samples`` with ``pdf`` of the longest stored context and its ``order`` (depth).

    Keys of ``by`` that the tree does not know have no pdf.
    """
    rows = samples.withColumn("_full", symbols(depth))
    every = rows.select(*by, "_full").distinct()
    each = every.select(*by, "_full", _contexts("_full")).select(*by, "_full", "_x.*").where("depth > 0")
    deep = tree.where("depth > 0").select(*by, "context", "depth", "pdf")
    found = each.join(deep, [*by, "context", "depth"]).groupBy(*by, "_full").agg(
        F.max_by(F.struct("pdf", "depth"), "depth").alias("_best"))
    found = cut_lineage(found, "resolved")
    root = tree.where("depth = 0")
    out = rows.join(found, [*by, "_full"], "left")
    if by:
        # one row per model
        out = out.join(root.select(*by, F.col("pdf").alias("_root")), list(by), "left")
    else:
        row = root.first()
        one = F.array(*[F.lit(float(v)) for v in row["pdf"]]) if row else F.lit(None).cast("array<double>")
        out = out.withColumn("_root", one)
    return out.withColumn("pdf", F.coalesce("_best.pdf", "_root")).withColumn(
        "order", F.when(F.col("pdf").isNotNull(), F.coalesce("_best.depth", F.lit(0)))).drop("_full", "_best", "_root")
