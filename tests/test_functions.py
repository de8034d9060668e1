"""C02/C03 buckets, C06/C07 time features, C10-C12 churn curve, S08 parsing."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from eventide.config import DAY_US
from eventide.functions.churn import cdf, cdf_after, churn_probability
from eventide.functions.labels import day_bucket, next_event_label
from eventide.functions.time import parse_event_time, phase, time_features

PDF = [0.07, 0.13, 0.21, 0.09, 0.36, 0.14]
EDGES = (1, 3, 7, 14, 28)


def _around_edges():
    """(microseconds, bucket): one microsecond before, on and after every bucket edge."""
    for k, e in enumerate(EDGES):
        for us in (-1, 0, 1):
            yield e * DAY_US + us, k + (us >= 0)


def test_day_bucket_on_both_sides_of_every_edge(spark):
    rows = [(0, 0), *_around_edges(), (400 * DAY_US, 5)]
    df = spark.createDataFrame(rows, "us long, want int")
    assert [r.b for r in df.select(day_bucket(F.col("us")).alias("b")).collect()] == [w for _, w in rows]


def test_next_event_label_on_both_sides_of_every_edge(spark):
    t0 = datetime(2031, 2, 11, 16, 45)
    rows = [(t0, t0 + timedelta(microseconds=us), w) for us, w in _around_edges()] + [(t0, None, 5), (t0, t0, 0)]
    df = spark.createDataFrame(rows, "t0 timestamp_ntz, nxt timestamp_ntz, want int")
    got = [r.l for r in df.select(next_event_label(F.col("nxt"), F.col("t0")).alias("l")).collect()]
    assert got == [w for _, _, w in rows]


def test_phase_in_range(spark):
    df = spark.createDataFrame([(x,) for x in (1925000000, 1931234567, 1950000001)], "s long")
    for p, per in (("day", 86400), ("week", 604800), ("month", 2628000), ("year", 31536000)):
        for r in df.select(phase(F.col("s"), p).alias("v")).collect():
            assert 0 <= r.v < per


def test_normalisation_range(spark):
    df = spark.range(0, 86400).select(F.col("id").alias("s"))
    feats = dict(time_features(F.col("s"), F.lit(0.0), F.lit(1.0)))
    r = df.agg(F.min(feats["day_sin"]).alias("mn"), F.max(feats["day_sin"]).alias("mx"),
               F.min(feats["day_cos"]).alias("cmin")).first()
    assert round(r.mn, 6) == -1.0 and round(r.mx, 4) == 1.0
    assert r.cmin >= -1e-12  # half circle: cos never negative


def _pdf_df(spark, xs):
    return spark.createDataFrame([(PDF, float(x)) for x in xs], "pdf array<double>, x double")


def test_cdf_matches_interpolation_and_is_monotone(spark):
    xs = np.linspace(0, 1000, 401).tolist() + [1, 3, 7, 14, 28, 5.5]
    got = [r.c for r in _pdf_df(spark, xs).select(cdf(F.col("pdf"), F.col("x")).alias("c"))
           .orderBy("x").collect()]
    knots_x = [0, 1, 3, 7, 14, 28, 1000]
    knots_y = [0] + list(np.cumsum(PDF))
    want = np.interp(sorted(xs), knots_x, knots_y)
    assert np.max(np.abs(np.array(got) - want)) < 1e-12
    assert all(0 <= g <= 1 for g in got)
    assert all(b >= a - 1e-15 for a, b in zip(got, got[1:]))


def test_cdf_outside_range_is_null(spark):
    got = [r.c for r in _pdf_df(spark, [-1.0, 1000.5]).select(
        cdf(F.col("pdf"), F.col("x")).alias("c")).collect()]
    assert got == [None, None]


def test_conditional_cdf_after_days(spark):
    df = spark.createDataFrame([(PDF, float(x)) for x in range(5, 29)],
                               "pdf array<double>, x double")
    got = [r.c for r in df.select(cdf_after(F.col("pdf"), F.col("x"), F.lit(5.0)).alias("c"))
           .orderBy("x").collect()]
    assert all(0 <= g <= 1 + 1e-12 for g in got)
    assert all(b >= a - 1e-15 for a, b in zip(got, got[1:]))


def test_churn_in_unit_interval_and_monotone_in_days(spark):
    pdf = PDF
    df = spark.createDataFrame([(pdf, float(d)) for d in range(0, 29)], "pdf array<double>, d double")
    got = [r.c for r in df.select(churn_probability(F.col("pdf"), F.col("d")).alias("c"))
           .orderBy("d").collect()]
    assert all(0 <= g <= 1 + 1e-12 for g in got)
    assert all(b >= a - 1e-12 for a, b in zip(got, got[1:]))
    assert math.isclose(got[-1], 1.0)


def test_parse_event_time_both_shapes(spark):
    df = spark.createDataFrame([("2031-11-30 04:05:06.070809",), ("2031-11-30 04:05:06",)], "t string")
    got = [r.p for r in df.select(parse_event_time("t").alias("p")).collect()]
    assert got == [datetime(2031, 11, 30, 4, 5, 6, 70809), datetime(2031, 11, 30, 4, 5, 6)]


def test_churn_is_one_from_the_threshold_on_also_beyond_the_tail(spark):
    pdf = [0.05, 0.25, 0.15, 0.2, 0.3, 0.05]
    rows = [(pdf, d) for d in (28.0, 500.0, 1000.0, 1000.5, 4000.0)] + [(pdf, -1.0), (None, 4000.0)]
    df = spark.createDataFrame(rows, "pdf array<double>, d double")
    got = [r.c for r in df.select(churn_probability(F.col("pdf"), F.col("d")).alias("c")).collect()]
    assert got == [1.0] * 5 + [None, None]


def test_churn_matches_numpy_interpolation_for_random_pdfs(spark):
    rng = np.random.default_rng(7)
    pdfs = rng.dirichlet(np.ones(6) * 0.7, size=60)
    days = [0.0, 0.5, 1.0, 2.5, 6.9, 13.0, 20.0, 27.9, 28.0, 40.0, 365.0, 999.0]
    rows = [(i, [float(v) for v in p], d) for i, p in enumerate(pdfs) for d in days]
    df = spark.createDataFrame(rows, "i int, pdf array<double>, d double")
    got = {(r.i, r.d): r.c for r in df.select(
        "i", "d", churn_probability(F.col("pdf"), F.col("d")).alias("c")).collect()}
    knots = [0, 1, 3, 7, 14, 28, 1000]
    for i, p in enumerate(pdfs):
        ys = np.concatenate([[0.0], np.cumsum(p)])
        prev = -1.0
        for d in days:
            fd = np.interp(d, knots, ys)
            want = (1 - np.interp(max(28.0, d), knots, ys)) / (1 - fd) if 1 - fd > 1e-12 else None
            c = got[(i, d)]
            if want is None or c is None:
                continue
            assert abs(c - want) < 1e-9
            assert -1e-12 <= c <= 1 + 1e-12
            assert c >= prev - 1e-9  # non-decreasing in days since the last event
            prev = c
