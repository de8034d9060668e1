"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one aggregation and one join of the edge table with itself; a hub's edges are
pre-aggregated and its join is left to Spark's skew handling. Edges are written to the shared
checkpoint folder after each round, so a lost executor does not replay earlier rounds. The driver
sees one count and one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.session import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v")


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` hold u < v; every v is tied to its smallest neighbour, its other neighbours too."""
    low = edges.groupBy("v").agg(F.min("u").alias("m"))
    tied = edges.join(low, "v").where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return tied.unionAll(low.select(F.col("m").alias("u"), "v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the smallest node reachable.

    Self-loops, repeated and reversed edges are allowed; null ends are ignored; no edges give no
    rows.
    """
    e = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    e = cut_lineage(e.distinct(), "cc")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        e = cut_lineage(_small_star(_large_star(e).distinct()).distinct(), "cc")
    roots = e.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return roots.unionAll(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
