"""Bucket pdf -> CDF -> conditional churn probability (C10, C11, C12), as Column algebra."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide.config import BUCKET_EDGES_DAYS, CDF_TAIL_DAYS


def _knots(edges_days: Sequence[int], tail_days: int) -> list[float]:
    return [0.0, *[float(e) for e in edges_days], float(tail_days)]


def cdf(pdf: Column, x: Column, edges_days: Sequence[int] = BUCKET_EDGES_DAYS,
        tail_days: int = CDF_TAIL_DAYS) -> Column:
    """Piecewise-linear CDF through (0,0), (edge_i, p_0+..+p_i), (tail, sum p).

    Written as F(x) = sum_i p_i * clamp((x - x_i) / (x_{i+1} - x_i), 0, 1): the same line
    segments as the interpolation table, with each input referenced once per term (compact
    generated code). ``pdf`` is an array of len(edges)+1 doubles; outside [0, tail] -> NULL.
    """
    xs = _knots(edges_days, tail_days)
    total: Column | None = None
    for i in range(len(xs) - 1):
        frac = (x - F.lit(xs[i])) / F.lit(xs[i + 1] - xs[i])
        term = pdf.getItem(i) * F.least(F.greatest(frac, F.lit(0.0)), F.lit(1.0))
        total = term if total is None else total + term
    inside = (x >= F.lit(xs[0])) & (x <= F.lit(xs[-1]))
    return F.when(inside, total)


def cdf_after(pdf: Column, x: Column, days: Column, **kw) -> Column:
    """C11: CDF conditional on no event in the first ``days``: (F(x) - F(d)) / (1 - F(d))."""
    fd = cdf(pdf, days, **kw)
    return (cdf(pdf, x, **kw) - fd) / F.nullif(F.lit(1.0) - fd, F.lit(0.0))


def churn_probability(pdf: Column, days: Column, time_to_churn: float = BUCKET_EDGES_DAYS[-1],
                      **kw) -> Column:
    """S(max(ttc, d)) / S(d) with S = 1 - F.

    From ``time_to_churn`` days on this is S(d) / S(d) = 1, also beyond the CDF's tail, where a
    person is idle longer than the curve reaches. Negative days -> NULL.
    """
    ttc = F.lit(float(time_to_churn))
    left = (F.lit(1.0) - cdf(pdf, ttc, **kw)) / F.nullif(F.lit(1.0) - cdf(pdf, days, **kw), F.lit(0.0))
    return F.when(days >= ttc, F.when(pdf.isNotNull(), F.lit(1.0))).otherwise(left)
