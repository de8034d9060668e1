"""Registered queries for sampling, training sets, the model, scoring and message flows."""

from __future__ import annotations

import os
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.config import DAY_US
from eventide.functions.churn import cdf, cdf_after, churn_probability
from eventide.functions.time import ts_lit, ts_text
from eventide.operators import extract as X
from eventide.operators.history import histories_at
from eventide.operators.metrics import mean_log_loss
from eventide.operators.model import GLOBAL_SEGMENT, attach_pdf, bucket_pdf, score_histories
from eventide.operators.sampling import sample_points
from eventide.operators.stats import time_bounds_values, vocabulary
from eventide.operators.validate import parse_and_validate
from eventide.plans import sqlparts as S
from eventide.plans.catalog import (_SPLIT_SQL, EVP, MX, ORP, _hist_sql, _next_sql, _sample_view,
                                    register)
from eventide.plans.preprocess import shared_train_validation, test_set, train_validation_raw
from eventide.plans.requests import (download_status, latest_status, prediction_requests,
                                     ready_to_train, routed, training_requests,
                                     training_status_steps)
from eventide.plans.scoring import horizon_metrics, score_requests
from eventide.schema import EVENT_MESSAGE
from eventide.sources.tables import load_events
from eventide.streaming.tracker import TrackerParams, progress_batch, training_starts

N_CLASSES = 6
TRACK = TrackerParams(poll_s=60, idle_s=3600, abort_s=3600)


# ---- oracle generators --------------------------------------------------------------------

def _dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _sampling_ctes(raw: str, h: int, b: int, seed: int, hz_days: int) -> list[str]:
    """P03 + J05/J06 naive oracle over ``raw`` (event columns + group column g)."""
    u_t = S.hex8_uniform(f"'{seed}:' || CAST(bucket AS VARCHAR) || ':' || CAST(slot AS VARCHAR) || ':t'")
    u_p = S.hex8_uniform(f"'{seed}:' || CAST(bucket AS VARCHAR) || ':' || CAST(slot AS VARCHAR) || ':p'")
    rng = "floor((hi - lo) / 1000000.0)"
    return [
        f"""sp_p AS (SELECT g, PersonId, min(OccurredTime) AS first_ts, max(OccurredTime) AS last_ts,
             count(*) AS n, {S.hex8_int(f"'{seed}:b:' || CAST(PersonId AS VARCHAR)")} % {b} AS bucket
           FROM {raw} GROUP BY g, PersonId)""",
        f"""sp_bd AS (SELECT g, min(OccurredTime) AS lo_t, max(OccurredTime) AS hi_t FROM {raw} GROUP BY g)""",
        f"""sp_b AS (SELECT sp_p.g, bucket, CAST(floor(sum(n) / {h}) + 1 AS BIGINT) AS budget,
             greatest(epoch_us(min(first_ts)), epoch_us(min(lo_t))) AS lo,
             least(epoch_us(max(last_ts)) + {DAY_US}, epoch_us(min(hi_t) - INTERVAL {hz_days} DAY)) AS hi
           FROM sp_p JOIN sp_bd USING (g) GROUP BY sp_p.g, bucket)""",
        """sp_s0 AS (SELECT g, bucket, lo, hi, unnest(range(0, budget)) AS slot FROM sp_b)""",
        f"""sp_s AS (SELECT g, bucket, slot,
             CASE WHEN {rng} <= 0 THEN hi ELSE lo + CAST(floor({u_t} * {rng}) AS BIGINT) * 1000000 END AS t
           FROM sp_s0)""",
        """sp_pr AS (SELECT g, PersonId, bucket, epoch_us(first_ts) AS ft,
             row_number() OVER (PARTITION BY g, bucket ORDER BY epoch_us(first_ts), PersonId) - 1 AS rk
           FROM sp_p)""",
        """sp_c AS (SELECT s.*, (SELECT count(*) FROM sp_pr WHERE sp_pr.g = s.g AND sp_pr.bucket = s.bucket
             AND sp_pr.ft <= s.t) AS cnt FROM sp_s s)""",
        f"""sp_k AS (SELECT g, bucket, slot, t, CAST(floor({u_p} * cnt) AS BIGINT) AS rk FROM sp_c WHERE cnt > 0)""",
        """smp AS (SELECT sp_k.g, sp_pr.PersonId, make_timestamp(sp_k.t) AS t0,
             min(sp_k.bucket) AS bucket, min(sp_k.slot) AS slot
           FROM sp_k JOIN sp_pr ON sp_k.g = sp_pr.g AND sp_k.bucket = sp_pr.bucket AND sp_k.rk = sp_pr.rk
           GROUP BY sp_k.g, sp_pr.PersonId, sp_k.t)""",
    ]


def _sample_hist_ctes(raw: str, h: int) -> list[str]:
    """Histories / next event / label for the samples in ``smp`` (naive join + rank)."""
    return [
        f"""hh AS (SELECT smp.g, smp.PersonId, smp.t0, r.OccurredTime, r.DefinitionId,
             row_number() OVER (PARTITION BY smp.g, smp.PersonId, smp.t0 ORDER BY r.OccurredTime DESC,
               r.OccurredTimeTicks DESC, r.DefinitionId DESC, r.EventKey DESC) AS rn
           FROM smp JOIN {raw} r ON r.g = smp.g AND r.PersonId = smp.PersonId AND r.OccurredTime < smp.t0)""",
        f"""hs AS (SELECT g, PersonId, t0, count(*) AS len,
             repeat('-,', {h} - count(*)) || string_agg(DefinitionId, ',' ORDER BY rn DESC) AS types,
             max(OccurredTime) AS last_time, max(CASE WHEN rn = 1 THEN DefinitionId END) AS last_type
           FROM hh WHERE rn <= {h} GROUP BY g, PersonId, t0)""",
        f"""nx AS (SELECT g, PersonId, t0, next_type, next_time FROM (
             SELECT smp.g, smp.PersonId, smp.t0, r.DefinitionId AS next_type, r.OccurredTime AS next_time,
               row_number() OVER (PARTITION BY smp.g, smp.PersonId, smp.t0 ORDER BY r.OccurredTime,
                 r.OccurredTimeTicks, r.DefinitionId, r.EventKey) AS rn2
             FROM smp JOIN {raw} r ON r.g = smp.g AND r.PersonId = smp.PersonId AND r.OccurredTime >= smp.t0)
           WHERE rn2 = 1)""",
        f"""ts AS (SELECT smp.g, smp.PersonId, smp.t0, CAST(coalesce(hs.len, 0) AS INTEGER) AS history_len,
             coalesce(hs.types, repeat('-,', {h - 1}) || '-') AS history_types, hs.last_time, hs.last_type,
             nx.next_type, nx.next_time,
             CASE WHEN hs.len > 0 THEN {S.label('nx.next_time', 'hs.last_time')} END AS label
           FROM smp LEFT JOIN hs USING (g, PersonId, t0) LEFT JOIN nx USING (g, PersonId, t0))""",
    ]


def _train_ctes(src: str, p) -> list[str]:
    """Train / validation chain: F01 (max-h), F02 (max-2h), P01, P05, histories, labels."""
    h = p.horizon_days
    return [
        src,
        f"cut AS (SELECT * FROM ev WHERE OccurredTime < {MX} - INTERVAL {h} DAY)",
        f"""wh AS (SELECT * FROM cut WHERE PersonId IN (
             SELECT PersonId FROM cut WHERE OccurredTime < {MX} - INTERVAL {2 * h} DAY))""",
        _SPLIT_SQL.format(ratio=p.split_ratio, seed=p.seed, src="wh"),
        "raw AS (SELECT wh.*, split.split AS g FROM wh JOIN split USING (PersonId))",
        *_sampling_ctes("raw", p.history_size, p.sample_buckets, p.seed, h),
        *_sample_hist_ctes("raw", p.history_size),
    ]


def _orders_train_ctes() -> list[str]:
    return _train_ctes(S.EV_ORDERS, ORP)


def _pdf_ctes(src: str = "ts", where: str = "g = 'train'") -> list[str]:
    ps = ", ".join(
        f"({_dbl(f'sum(CASE WHEN label = {k} THEN 1 ELSE 0 END)')} + 1.0) / ({_dbl('count(*)')} + {N_CLASSES}.0) AS p{k}"
        for k in range(N_CLASSES))
    return [
        f"""pdf_l AS (SELECT last_type AS segment, label FROM {src} WHERE {where} AND label IS NOT NULL
             UNION ALL SELECT '{GLOBAL_SEGMENT}' AS segment, label FROM {src} WHERE {where} AND label IS NOT NULL)""",
        f"pdf AS (SELECT segment, CAST(count(*) AS BIGINT) AS n, {ps} FROM pdf_l GROUP BY segment)",
    ]


def _cdf_sql(p: str, x: str) -> str:
    xs = [0.0, 1.0, 3.0, 7.0, 14.0, 28.0, 1000.0]
    terms = [f"{p}p{i} * least(greatest(({x} - {xs[i]}) / {xs[i + 1] - xs[i]}, 0.0), 1.0)"
             for i in range(N_CLASSES)]
    return f"(CASE WHEN {x} >= 0.0 AND {x} <= 1000.0 THEN " + " + ".join(terms) + " END)"


def _churn_sql(p: str, d: str) -> str:
    return (f"(CASE WHEN {d} >= 28.0 THEN (CASE WHEN {p}p0 IS NOT NULL THEN 1.0::DOUBLE END) "
            f"ELSE (1.0 - {_cdf_sql(p, '28.0')}) / nullif(1.0 - {_cdf_sql(p, d)}, 0.0) END)")


def _pdf_pick(seg: str) -> tuple[str, str]:
    """(join clause, column prefix-free select) for a segment pdf with the global fallback."""
    cols = ", ".join(f"coalesce(ps.p{k}, pg.p{k}) AS p{k}" for k in range(N_CLASSES))
    join = (f"LEFT JOIN pdf ps ON ps.segment = {seg} "
            f"CROSS JOIN (SELECT * FROM pdf WHERE segment = '{GLOBAL_SEGMENT}') pg")
    return join, cols


# ---- Spark helpers ------------------------------------------------------------------------

def _samples(spark: SparkSession, sf: str, source: str) -> DataFrame:
    """The train and validation samples of a table, prepared once for all queries."""
    return shared_train_validation(spark, os.path.join(sf, f"{source}.parquet"),
                                   lambda: load_events(spark, sf, source), ORP if source == "orders" else EVP)


def _sets(spark: SparkSession, sf: str, source: str) -> tuple[DataFrame, DataFrame]:
    both = _samples(spark, sf, source)
    return tuple(both.where(F.col("split") == s).drop("split") for s in ("train", "validation"))


def _orders_train_sets(spark: SparkSession, sf: str):
    return load_events(spark, sf, "orders"), *_sets(spark, sf, "orders")


def _orders_pdf(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ev, train, val = _orders_train_sets(spark, sf)
    return ev, bucket_pdf(train), val


def _pdf_cols(df: DataFrame) -> list:
    return [F.round(F.col("pdf").getItem(k), 6).alias(f"p{k}") for k in range(N_CLASSES)]


# ---- P02 / P03 / A06 ----------------------------------------------------------------------


@register("sample_points", S.with_ctes(
    S.EV_EVENTS, "rawe AS (SELECT ev.*, 'all' AS g FROM ev)",
    *_sampling_ctes("rawe", EVP.history_size, EVP.sample_buckets, EVP.seed, EVP.horizon_days))
    + f"\nSELECT PersonId, {S.ts('t0')} AS t0, bucket, slot FROM smp")
def q_sample_points(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_events(spark, sf, "events")
    lo, hi = time_bounds_values(ev)
    pts = sample_points(ev, min_time=lo, max_time=hi - timedelta(days=EVP.horizon_days),
                        history_size=EVP.history_size, buckets=EVP.sample_buckets, seed=EVP.seed)
    return pts.select("PersonId", ts_text("t0").alias("t0"), "bucket", "slot")


# ---- H06 / J05 / J06 / U01 / A07 ----------------------------------------------------------


@register("train_samples", S.with_ctes(*_orders_train_ctes()) + f"""
SELECT g AS split, PersonId, {S.ts('t0')} AS t0, history_len, history_types,
       {S.ts('last_time')} AS last_time, next_type, {S.ts('next_time')} AS next_time, label FROM ts""")
def q_train_samples(spark: SparkSession, sf: str) -> DataFrame:
    both = _samples(spark, sf, "orders")
    return _sample_view(both, "split", ts_text("t0").alias("t0"))


@register("train_samples_events", S.with_ctes(*_train_ctes(S.EV_EVENTS, EVP)) + f"""
SELECT g AS split, PersonId, {S.ts('t0')} AS t0, history_len, history_types,
       {S.ts('last_time')} AS last_time, next_type, {S.ts('next_time')} AS next_time, label FROM ts""")
def q_train_samples_events(spark: SparkSession, sf: str) -> DataFrame:
    """H06 on `events` (7-day horizon, H = 8): microsecond times, many samples per person."""
    both = _samples(spark, sf, "events")
    return _sample_view(both, "split", ts_text("t0").alias("t0"))


@register("dataset_sizes", S.with_ctes(*_orders_train_ctes()) + """
SELECT g AS split, CAST(count(DISTINCT (PersonId, t0)) AS BIGINT) AS n_samples,
       CAST(count(DISTINCT PersonId) AS BIGINT) AS n_persons FROM ts GROUP BY g""")
def q_dataset_sizes(spark: SparkSession, sf: str) -> DataFrame:
    both = _samples(spark, sf, "orders")
    return both.groupBy("split").agg(
        F.count_distinct("PersonId", "t0").cast("bigint").alias("n_samples"),
        F.count_distinct("PersonId").cast("bigint").alias("n_persons"))


# ---- C05 / C01 ----------------------------------------------------------------------------

_EV_H = f"({MX} - INTERVAL 7 DAY)"


@register("train_rows", S.with_ctes(
    S.EV_EVENTS,
    "voc AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM "
    "(SELECT DISTINCT DefinitionId AS token FROM ev WHERE DefinitionId IS NOT NULL))",
    f"""act AS (SELECT * FROM ev WHERE PersonId IN (SELECT PersonId FROM ev WHERE
        OccurredTime < {_EV_H} AND OccurredTime > {_EV_H} - INTERVAL 7 DAY))""",
    f"""hr AS (SELECT a.PersonId, a.OccurredTime, coalesce(voc.token_id, (SELECT count(*) FROM voc)) AS tid,
        row_number() OVER (PARTITION BY a.PersonId ORDER BY {S.ORDER_DESC.replace('OccurredTime', 'a.OccurredTime').replace('DefinitionId', 'a.DefinitionId').replace('EventKey', 'a.EventKey').replace('a.OccurredTimeTicks', 'a.OccurredTimeTicks')}) AS rn
        FROM act a LEFT JOIN voc ON a.DefinitionId = voc.token WHERE a.OccurredTime < {_EV_H})""",
    f"""h AS (SELECT PersonId, count(*) AS len,
        repeat(CAST((SELECT count(*) FROM voc) AS VARCHAR) || ',', 8 - count(*))
          || string_agg(CAST(tid AS VARCHAR), ',' ORDER BY rn DESC) AS action_ids,
        repeat('-,', 8 - count(*))
          || string_agg(CAST(CAST(floor(epoch_us(OccurredTime) / 1000000.0) AS BIGINT) AS VARCHAR), ',' ORDER BY rn DESC) AS times,
        max(OccurredTime) AS last_time
        FROM hr WHERE rn <= 8 GROUP BY PersonId)""",
    f"n AS ({_next_sql('act', _EV_H)})") + f"""
SELECT h.PersonId, h.action_ids, h.times, {S.label('n.next_time', 'h.last_time')} AS label
FROM h LEFT JOIN n USING (PersonId)""")
def q_train_rows(spark: SparkSession, sf: str) -> DataFrame:
    from eventide.operators.training import training_rows

    ev = load_events(spark, sf, "events")
    rows = training_rows(test_set(ev, EVP), vocabulary(ev))
    return rows.select(
        "PersonId", F.array_join(F.col("action_ids").cast("array<string>"), ",").alias("action_ids"),
        F.array_join(F.col("times").cast("array<string>"), ",", "-").alias("times"), "label")


# ---- M01a / C10-C12 -----------------------------------------------------------------------


@register("bucket_pdf", S.with_ctes(*_orders_train_ctes(), *_pdf_ctes()) + "\nSELECT segment, n, "
          + ", ".join(f"round(p{k}, 6) AS p{k}" for k in range(N_CLASSES)) + " FROM pdf")
def q_bucket_pdf(spark: SparkSession, sf: str) -> DataFrame:
    _, pdf, _ = _orders_pdf(spark, sf)
    return pdf.select("segment", "n", *_pdf_cols(pdf))


@register("churn_curve", S.with_ctes(*_orders_train_ctes(), *_pdf_ctes()) + f"""
SELECT segment, CAST(d AS INTEGER) AS d, round({_cdf_sql('', _dbl('d'))}, 6) AS cdf,
       round(({_cdf_sql('', '28.0')} - {_cdf_sql('', _dbl('d'))})
             / nullif(1.0 - {_cdf_sql('', _dbl('d'))}, 0.0), 6) AS cond_cdf_28,
       round({_churn_sql('', _dbl('d'))}, 6) AS churn
FROM pdf, range(0, 29) t(d)""")
def q_churn_curve(spark: SparkSession, sf: str) -> DataFrame:
    _, pdf, _ = _orders_pdf(spark, sf)
    grid = pdf.select("segment", "pdf", F.explode(F.sequence(F.lit(0), F.lit(28))).alias("d"))
    x = F.col("d").cast("double")
    return grid.select("segment", F.col("d").cast("int").alias("d"),
                       F.round(cdf(F.col("pdf"), x), 6).alias("cdf"),
                       F.round(cdf_after(F.col("pdf"), F.lit(28.0), x), 6).alias("cond_cdf_28"),
                       F.round(churn_probability(F.col("pdf"), x), 6).alias("churn"))


# ---- M03 / H08 / C13 ----------------------------------------------------------------------


def _days_sql(as_of: str, last: str) -> str:
    return f"({_dbl(f'epoch_us({as_of}) - epoch_us({last})')} / {_dbl('86400000000')})"


_J, _P = _pdf_pick("hq.last_type")


@register("churn_scores", S.with_ctes(
    *_orders_train_ctes(), *_pdf_ctes(),
    """ext AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY PersonId ORDER BY
        OccurredTimeTicks DESC, OccurredTime DESC, DefinitionId DESC, EventKey DESC) AS rn0 FROM ev)
        WHERE rn0 <= 32)""",
    f"hq AS ({_hist_sql('ext', MX, 64)})",
    f"""sc AS (SELECT pp.PersonId, coalesce(hq.history_len, 0) AS history_len, hq.last_time, {_P}
        FROM (SELECT DISTINCT PersonId FROM ext) pp LEFT JOIN hq USING (PersonId) {_J})""") + f"""
SELECT PersonId, CAST(history_len AS INTEGER) AS history_len,
       round({_days_sql(MX, 'last_time')}, 6) AS days,
       round(CASE WHEN history_len > 0 THEN {_churn_sql('', _days_sql(MX, 'last_time'))} END, 6) AS score
FROM sc""")
def q_churn_scores(spark: SparkSession, sf: str) -> DataFrame:
    ev, pdf, _ = _orders_pdf(spark, sf)
    _, mx = time_bounds_values(ev)
    hist = histories_at(X.latest_per_person(ev, 32), mx, 64, include_empty=True)
    scored = score_histories(hist, pdf, ts_lit(mx))
    return scored.select("PersonId", "history_len", F.round("days", 6).alias("days"),
                         F.round("score", 6).alias("score"))


@register("churn_scores_events", S.with_ctes(
    *_train_ctes(S.EV_EVENTS, EVP), *_pdf_ctes(),
    """ext AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY PersonId ORDER BY
        OccurredTimeTicks DESC, OccurredTime DESC, DefinitionId DESC, EventKey DESC) AS rn0 FROM ev)
        WHERE rn0 <= 32)""",
    f"hq AS ({_hist_sql('ext', MX, 8)})",
    f"""sc AS (SELECT pp.PersonId, coalesce(hq.history_len, 0) AS history_len, hq.last_time, {_P}
        FROM (SELECT DISTINCT PersonId FROM ext) pp LEFT JOIN hq USING (PersonId) {_J})""") + f"""
SELECT PersonId, CAST(history_len AS INTEGER) AS history_len,
       round({_days_sql(MX, 'last_time')}, 6) AS days,
       round(CASE WHEN history_len > 0 THEN {_churn_sql('', _days_sql(MX, 'last_time'))} END, 6) AS score
FROM sc""")
def q_churn_scores_events(spark: SparkSession, sf: str) -> DataFrame:
    """M03 on `events`: fractional days since the last event, scores inside (0, 1)."""
    ev = load_events(spark, sf, "events")
    train, _ = _sets(spark, sf, "events")
    pdf = bucket_pdf(train)
    _, mx = time_bounds_values(ev)
    hist = histories_at(X.latest_per_person(ev, 32), mx, EVP.history_size, include_empty=True)
    scored = score_histories(hist, pdf, ts_lit(mx))
    return scored.select("PersonId", "history_len", F.round("days", 6).alias("days"),
                         F.round("score", 6).alias("score"))


# ---- A09 / A10 ----------------------------------------------------------------------------

_OR_HZ = f"({MX} - INTERVAL 28 DAY)"
_JT, _PT = _pdf_pick("h.last_type")


@register("score_metrics", S.with_ctes(
    *_orders_train_ctes(), *_pdf_ctes(),
    f"""act AS (SELECT * FROM ev WHERE PersonId IN (SELECT PersonId FROM ev WHERE
        OccurredTime < {_OR_HZ} AND OccurredTime > {_OR_HZ} - INTERVAL 28 DAY))""",
    f"h AS ({_hist_sql('act', _OR_HZ, 64)})", f"n AS ({_next_sql('act', _OR_HZ)})",
    f"""tsb AS (SELECT h.PersonId, h.last_time, n.next_time, {_PT}
        FROM h LEFT JOIN n USING (PersonId) {_JT})""",
    f"""tsc AS (SELECT PersonId, {_churn_sql('', _days_sql(_OR_HZ, 'last_time'))} AS score,
        CASE WHEN next_time IS NULL OR epoch_us(next_time) - epoch_us({_OR_HZ}) >= {28 * DAY_US}
             THEN 1 ELSE 0 END AS actual FROM tsb)""",
    "r AS (SELECT score AS s, actual AS y FROM tsc WHERE score IS NOT NULL)",
    """cf AS (SELECT sum(CASE WHEN s >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp,
        sum(CASE WHEN s >= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS fp,
        sum(CASE WHEN s < 0.5 AND y = 1 THEN 1 ELSE 0 END) AS fn,
        sum(CASE WHEN s < 0.5 AND y = 0 THEN 1 ELSE 0 END) AS tn FROM r)""",
    "ps AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM r GROUP BY s)",
    """pt AS (SELECT pos, neg, pos * (coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) + 0.5 * neg) AS t FROM ps)""",
    "au AS (SELECT sum(t) / (sum(pos) * sum(neg)) AS auc FROM pt)",
    f"""m AS (SELECT auc, {_dbl('tp')} AS tp, {_dbl('fp')} AS fp, {_dbl('fn')} AS fn, {_dbl('tn')} AS tn FROM cf, au)""")
    + """
SELECT round(auc, 6) AS auc,
       round(2 * (tp / nullif(tp + fp, 0.0)) * (tp / nullif(tp + fn, 0.0))
             / nullif((tp / nullif(tp + fp, 0.0)) + (tp / nullif(tp + fn, 0.0)), 0.0), 6) AS f1,
       round(tp / nullif(tp + fp, 0.0), 6) AS precission, round(tp / nullif(tp + fn, 0.0), 6) AS recall,
       round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, CAST(tp + fp + fn + tn AS BIGINT) AS n FROM m""")
def q_score_metrics(spark: SparkSession, sf: str) -> DataFrame:
    ev, pdf, _ = _orders_pdf(spark, sf)
    m = horizon_metrics(ev, pdf, ORP)
    return m.select(*[F.round(c, 6).alias(c) for c in
                      ("auc", "f1", "precission", "recall", "accuracy")], "n")


_JV, _PV = _pdf_pick("ts.last_type")


@register("log_loss", S.with_ctes(*_orders_train_ctes(), *_pdf_ctes()) + f"""
SELECT round(avg(-ln(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3
                                WHEN 4 THEN p4 ELSE p5 END)), 6) AS log_loss,
       CAST(count(*) AS BIGINT) AS n
FROM (SELECT ts.label, {_PV} FROM ts {_JV} WHERE ts.g = 'validation' AND ts.label IS NOT NULL)""")
def q_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    _, pdf, val = _orders_pdf(spark, sf)
    ll = mean_log_loss(attach_pdf(val, pdf))
    return ll.select(F.round("log_loss", 6).alias("log_loss"), "n")


# ---- V01 / C15 ----------------------------------------------------------------------------

_EV_MSG = [f.name for f in EVENT_MESSAGE.fields]


def _event_feed(spark: SparkSession, sf: str) -> DataFrame:
    from eventide.functions.messages import to_message

    ev = load_events(spark, sf, "events")
    return ev.select(to_message(EVENT_MESSAGE).alias("value"))


@register("valid_events", S.with_ctes(S.EV_EVENTS) + f"""
SELECT AccountId, ApplicationId, ModelId, DefinitionId,
       {S.ts("date_trunc('second', OccurredTime)")} AS OccurredTime, OccurredTimeTicks, PersonId FROM ev
WHERE AccountId >= 0 AND PersonId >= 0 AND OccurredTimeTicks >= 0 AND ModelId IS NOT NULL
  AND DefinitionId IS NOT NULL AND length(DefinitionId) >= 1 AND OccurredTime IS NOT NULL""")
def q_valid_events(spark: SparkSession, sf: str) -> DataFrame:
    v = parse_and_validate(_event_feed(spark, sf), EVENT_MESSAGE).where("valid")
    return v.select(*[ts_text(c).alias(c) if c == "OccurredTime" else c for c in _EV_MSG])


# faults put into some rows of every kind, by the row's own key; every row stays in the feed
_FAULTS = {"AccountId": (7, "-1 - AccountId"), "ModelId": (13, "NULL"), "DefinitionId": (11, "''"),
           "PersonId": (17, "NULL"), "OccurredTimeTicks": (19, "-OccurredTimeTicks")}
_BROKEN = "br AS (SELECT ApplicationId, OccurredTime, EventKey, " + ", ".join(
    f"CASE WHEN EventKey % {k} = 0 THEN {v} ELSE {c} END AS {c}" for c, (k, v) in _FAULTS.items()) + " FROM ev)"


@register("quarantined_events", S.with_ctes(S.EV_EVENTS, _BROKEN) + """
SELECT PersonId, reasons FROM (SELECT PersonId, concat_ws(',',
    CASE WHEN AccountId IS NULL THEN 'AccountId:missing' END,
    CASE WHEN ModelId IS NULL THEN 'ModelId:missing' END,
    CASE WHEN PersonId IS NULL THEN 'PersonId:missing' END,
    CASE WHEN DefinitionId IS NULL THEN 'DefinitionId:missing' END,
    CASE WHEN OccurredTime IS NULL THEN 'OccurredTime:missing' END,
    CASE WHEN OccurredTimeTicks IS NULL THEN 'OccurredTimeTicks:missing' END,
    CASE WHEN AccountId < 0 THEN 'AccountId:negative' END,
    CASE WHEN PersonId < 0 THEN 'PersonId:negative' END,
    CASE WHEN OccurredTimeTicks < 0 THEN 'OccurredTimeTicks:negative' END,
    CASE WHEN length(DefinitionId) < 1 THEN 'DefinitionId:empty' END) AS reasons FROM br)
WHERE reasons <> ''""")
def q_quarantined_events(spark: SparkSession, sf: str) -> DataFrame:
    """V01 over a feed with faulty rows derived from the events."""
    from eventide.functions.messages import to_message

    ev = load_events(spark, sf, "events")
    broken = ev.withColumns({c: F.expr(f"CASE WHEN EventKey % {k} = 0 THEN {v} ELSE {c} END")
                             for c, (k, v) in _FAULTS.items()})
    v = parse_and_validate(broken.select(to_message(EVENT_MESSAGE).alias("value")), EVENT_MESSAGE).where("NOT valid")
    return v.select("PersonId", F.array_join("reasons", ",").alias("reasons"))


# ---- J07 / E01 / E02 / E03 / F08 / E08 ----------------------------------------------------

_REG_ORDERS = [
    S.EV_ORDERS.replace("ev AS (", "evo AS ("),
    "cuto AS (SELECT * FROM evo WHERE OccurredTime < (SELECT max(OccurredTime) FROM evo) - INTERVAL 28 DAY)",
    """who AS (SELECT * FROM cuto WHERE PersonId IN (SELECT PersonId FROM cuto
        WHERE OccurredTime < (SELECT max(OccurredTime) FROM evo) - INTERVAL 56 DAY))""",
    _SPLIT_SQL.format(ratio=0.8, seed=42, src="who"),
    # models of accounts 0-2 only: requests of the others find none
    "reg AS (SELECT DISTINCT AccountId, ModelId FROM who JOIN split USING (PersonId) WHERE split = 'train' AND AccountId < 3)",
]


@register("route_requests", S.with_ctes(S.EV_EVENTS, *_REG_ORDERS) + """
SELECT q.AccountId, q.ApplicationId, q.ModelId, 'churn' AS task_type,
       CASE WHEN reg.AccountId IS NULL THEN 'train' ELSE 'predict' END AS route
FROM (SELECT DISTINCT AccountId, ModelId, ApplicationId FROM ev) q
LEFT JOIN reg ON q.AccountId = reg.AccountId AND q.ModelId = reg.ModelId""")
def q_route_requests(spark: SparkSession, sf: str) -> DataFrame:
    reqs = prediction_requests(X.registered_models(load_events(spark, sf, "events")))
    train_raw, _ = train_validation_raw(load_events(spark, sf, "orders"), ORP)
    registry = train_raw.select("AccountId", "ModelId").where("AccountId < 3").distinct()
    return routed(reqs, registry)


_TRACK_CTES = [
    S.EV_EVENTS,
    """req AS (SELECT AccountId, epoch_us((SELECT min(OccurredTime) FROM ev)) AS t0,
        CAST(count(*) AS BIGINT) AS lim FROM ev GROUP BY AccountId)""",
    f"""pl AS (SELECT e.AccountId, CAST(ceil((epoch_us(e.OccurredTime) - r.t0) / {_dbl(TRACK.poll_s * 1_000_000)}) AS BIGINT) AS poll,
        count(*) AS n FROM ev e JOIN req r USING (AccountId) WHERE epoch_us(e.OccurredTime) >= r.t0 GROUP BY 1, 2)""",
    """c1 AS (SELECT pl.*, r.lim, r.t0,
        sum(n) OVER (PARTITION BY pl.AccountId ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt,
        lag(poll) OVER (PARTITION BY pl.AccountId ORDER BY poll) AS prev_poll,
        min(poll) OVER (PARTITION BY pl.AccountId) AS first_poll
        FROM pl JOIN req r USING (AccountId))""",
    f"""c2 AS (SELECT *, CASE WHEN coalesce(lag(cnt) OVER (PARTITION BY AccountId ORDER BY poll) >= lim, false)
        OR coalesce((poll - prev_poll) * {TRACK.poll_s} > {TRACK.idle_s}, false) THEN 1 ELSE 0 END AS stop FROM c1)""",
    """c3 AS (SELECT *, max(stop) OVER (PARTITION BY AccountId ORDER BY poll ROWS BETWEEN UNBOUNDED PRECEDING
        AND CURRENT ROW) AS stopped FROM c2)""",
    f"""prog AS (SELECT AccountId, poll, make_timestamp(t0 + poll * {TRACK.poll_s * 1_000_000}) AS poll_time,
        CAST(cnt AS BIGINT) AS no_of_records, lim AS total_no_of_records,
        poll = max(poll) OVER (PARTITION BY AccountId) AS is_last
        FROM c3 WHERE stopped = 0 AND NOT (first_poll * {TRACK.poll_s} > {TRACK.abort_s}))""",
]


def _track_requests(ev: DataFrame) -> DataFrame:
    start, _ = time_bounds_values(ev)  # the feed's start: one scalar, used as a literal
    per = ev.groupBy("AccountId").agg(F.count(F.lit(1)).alias("total_no_of_records"))
    return per.withColumn("requested_at", ts_lit(start))


def _progress(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    ev = load_events(spark, sf, "events")
    arrivals = ev.select("AccountId", F.col("OccurredTime").alias("arrival_time"))
    return ev, progress_batch(arrivals, _track_requests(ev), TRACK)


@register("ingest_progress", S.with_ctes(*_TRACK_CTES) + f"""
SELECT AccountId, poll, {S.ts('poll_time')} AS poll_time, no_of_records, total_no_of_records, is_last FROM prog""")
def q_ingest_progress(spark: SparkSession, sf: str) -> DataFrame:
    _, prog = _progress(spark, sf)
    return prog.select("AccountId", "poll", ts_text("poll_time").alias("poll_time"),
                       "no_of_records", "total_no_of_records", "is_last")


def _half_way(ev: DataFrame) -> DataFrame:
    """Two requests per account: at the feed's start, and half way, when rows are there already."""
    lo, hi = time_bounds_values(ev)
    half = lo + timedelta(seconds=int((hi - lo).total_seconds() // 2))
    per = ev.groupBy("AccountId").agg(F.count(F.lit(1)).alias("total_no_of_records"))
    return per.select("AccountId", "total_no_of_records",
                      F.explode(F.array(ts_lit(lo), ts_lit(half))).alias("requested_at"))


@register("request_progress", S.with_ctes(
    S.EV_EVENTS,
    """rq AS (SELECT AccountId, CAST(count(*) AS BIGINT) AS lim,
        unnest([epoch_us((SELECT min(OccurredTime) FROM ev)),
                epoch_us((SELECT min(OccurredTime) FROM ev)) + 1000000 * CAST(floor(
                    (epoch_us((SELECT max(OccurredTime) FROM ev)) - epoch_us((SELECT min(OccurredTime) FROM ev)))
                    / 2000000.0) AS BIGINT)]) AS t0 FROM ev GROUP BY AccountId)""",
    f"""pl AS (SELECT r.AccountId, r.t0, r.lim, greatest(0, CAST(ceil((epoch_us(e.OccurredTime) - r.t0)
        / {_dbl(TRACK.poll_s * 1_000_000)}) AS BIGINT)) AS poll, count(*) AS n
        FROM rq r JOIN ev e USING (AccountId) GROUP BY ALL)""",
    """c1 AS (SELECT *, sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt,
        lag(poll) OVER w AS prev_poll, min(poll) OVER (PARTITION BY AccountId, t0) AS first_poll
        FROM pl WINDOW w AS (PARTITION BY AccountId, t0 ORDER BY poll))""",
    f"""c2 AS (SELECT *, CASE WHEN coalesce(lag(cnt) OVER w >= lim, false)
        OR coalesce((poll - prev_poll) * {TRACK.poll_s} > {TRACK.idle_s}, false) THEN 1 ELSE 0 END AS stop
        FROM c1 WINDOW w AS (PARTITION BY AccountId, t0 ORDER BY poll))""",
    """c3 AS (SELECT *, max(stop) OVER (PARTITION BY AccountId, t0 ORDER BY poll
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped FROM c2)""") + f"""
SELECT AccountId, {S.ts('make_timestamp(t0)')} AS requested_at, poll, CAST(cnt AS BIGINT) AS no_of_records,
       lim AS total_no_of_records, poll = max(poll) OVER (PARTITION BY AccountId, t0) AS is_last
FROM c3 WHERE stopped = 0 AND NOT (first_poll * {TRACK.poll_s} > {TRACK.abort_s})""")
def q_request_progress(spark: SparkSession, sf: str) -> DataFrame:
    """E01 with several requests per account, the later one meeting rows that are there already."""
    ev = load_events(spark, sf, "events")
    prog = progress_batch(ev.select("AccountId", F.col("OccurredTime").alias("arrival_time")), _half_way(ev), TRACK)
    return prog.select("AccountId", ts_text("requested_at").alias("requested_at"), "poll", "no_of_records",
                       "total_no_of_records", "is_last")


@register("latest_status", S.with_ctes(*_TRACK_CTES) + """
SELECT AccountId, max(poll) AS poll, arg_max(no_of_records, poll) AS no_of_records,
       arg_max(total_no_of_records, poll) AS total_no_of_records FROM prog GROUP BY AccountId""")
def q_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    _, prog = _progress(spark, sf)
    st = prog.select("AccountId", "poll", "no_of_records", "total_no_of_records")
    return latest_status(st, "poll", keys=("AccountId",))


@register("training_starts", S.with_ctes(*_TRACK_CTES) + """
SELECT q.AccountId, q.ApplicationId, q.ModelId, 'churn' AS task_type, p.no_of_records
FROM (SELECT DISTINCT AccountId, ModelId, ApplicationId FROM ev) q
JOIN (SELECT AccountId, no_of_records FROM prog WHERE is_last) p USING (AccountId)""")
def q_training_starts(spark: SparkSession, sf: str) -> DataFrame:
    """Every training request whose ingestion finished, with the final row count."""
    ev, prog = _progress(spark, sf)
    return training_starts(prog, training_requests(X.registered_models(ev)))


_MODEL_STATUS_SQL = """
SELECT q.AccountId, q.ApplicationId, q.ModelId, CAST(s.step AS INTEGER) AS current_step,
       CAST(s.pct AS DOUBLE) AS current_step_percentage, CAST(3 AS INTEGER) AS total_no_of_steps
FROM (SELECT DISTINCT AccountId, ModelId, ApplicationId FROM ev) q
CROSS JOIN (VALUES (0, 0.0), (0, 1.0), (1, 0.0), (1, 1.0), (2, 0.0), (2, 1.0)) s(step, pct)
WHERE q.AccountId IN (SELECT AccountId FROM prog WHERE is_last)"""


@register("model_status", S.with_ctes(*_TRACK_CTES) + _MODEL_STATUS_SQL)
def q_model_status(spark: SparkSession, sf: str) -> DataFrame:
    """E03 + F08 + E04: every status message of the training pipeline of each started model."""
    ev, prog = _progress(spark, sf)
    starts = training_starts(prog, training_requests(X.registered_models(ev)))
    download = download_status(starts)
    return download.unionByName(training_status_steps(ready_to_train(download)))


@register("latest_model_status", S.with_ctes(*_TRACK_CTES, f"st AS ({_MODEL_STATUS_SQL})") + """
SELECT AccountId, ApplicationId, ModelId, current_step, current_step_percentage, total_no_of_steps
FROM (SELECT *, row_number() OVER (PARTITION BY AccountId, ApplicationId, ModelId
                                   ORDER BY current_step DESC, current_step_percentage DESC) AS rn
      FROM st) WHERE rn = 1""")
def q_latest_model_status(spark: SparkSession, sf: str) -> DataFrame:
    """E08 over the model-status messages: the furthest step reached per model."""
    st = q_model_status(spark, sf)
    order = F.struct("current_step", "current_step_percentage")
    return latest_status(st, order, keys=("AccountId", "ApplicationId", "ModelId"))


@register("ready_to_train", S.with_ctes(*_TRACK_CTES) + """
SELECT q.AccountId, q.ApplicationId, q.ModelId, CAST(0 AS INTEGER) AS current_step,
       1.0::DOUBLE AS current_step_percentage, CAST(3 AS INTEGER) AS total_no_of_steps
FROM (SELECT DISTINCT AccountId, ModelId, ApplicationId FROM ev) q
WHERE q.AccountId IN (SELECT AccountId FROM prog WHERE is_last)""")
def q_ready_to_train(spark: SparkSession, sf: str) -> DataFrame:
    ev, prog = _progress(spark, sf)
    starts = training_starts(prog, training_requests(X.registered_models(ev)))
    return ready_to_train(download_status(starts))


# ---- F10 / K07 ----------------------------------------------------------------------------

_JR, _PR = _pdf_pick("hq.last_type")


@register("prediction_messages", S.with_ctes(
    *_orders_train_ctes(), *_pdf_ctes(),
    "req AS (SELECT DISTINCT AccountId, ModelId, ApplicationId FROM ev)",
    """ext0 AS (SELECT r.AccountId AS rA, r.ApplicationId AS rP, r.ModelId AS rM, e.PersonId, e.OccurredTime,
        e.OccurredTimeTicks, e.DefinitionId, e.EventKey
        FROM ev e JOIN req r ON e.AccountId = r.AccountId
        AND (r.ApplicationId IS NULL OR r.ApplicationId = '' OR e.ApplicationId = r.ApplicationId))""",
    """ext AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rA, rP, rM, PersonId ORDER BY
        OccurredTimeTicks DESC, OccurredTime DESC, DefinitionId DESC, EventKey DESC) AS rn0 FROM ext0) WHERE rn0 <= 32)""",
    f"""hq AS (SELECT rA, rP, rM, PersonId, count(*) AS len, max(OccurredTime) AS last_time,
        max(CASE WHEN rn = 1 THEN DefinitionId END) AS last_type
        FROM (SELECT *, row_number() OVER (PARTITION BY rA, rP, rM, PersonId ORDER BY {S.ORDER_DESC}) AS rn
              FROM ext WHERE OccurredTime < {MX}) WHERE rn <= 64 GROUP BY rA, rP, rM, PersonId)""",
    f"""sc AS (SELECT hq.*, {_PR} FROM hq {_JR})""") + f"""
SELECT rA AS AccountId, rP AS ApplicationId, rM AS ModelId, PersonId, {S.ts(MX)} AS prediction_time,
       'churn' AS task_type, round(score, 6) AS score
FROM (SELECT *, {_churn_sql('', _days_sql(MX, 'last_time'))} AS score FROM sc) WHERE score IS NOT NULL""")
def q_prediction_messages(spark: SparkSession, sf: str) -> DataFrame:
    from eventide.plans.requests import prediction_messages

    ev, pdf, _ = _orders_pdf(spark, sf)
    _, mx = time_bounds_values(ev)
    reqs = prediction_requests(X.registered_models(ev))
    scores = score_requests(ev, reqs, pdf, mx)
    good, _ = prediction_messages(scores, ts_lit(mx))
    return good.select("AccountId", "ApplicationId", "ModelId", "PersonId",
                       ts_text("prediction_time").alias("prediction_time"), "task_type",
                       F.round("score", 6).alias("score"))


# ---- M01b / M02: MLlib classifier (rows-only check: a fitted model has no SQL twin) --------


@register("classifier_checks", S.with_ctes(S.EV_ORDERS, f"""act AS (SELECT DISTINCT PersonId FROM ev WHERE
    OccurredTime < {_OR_HZ} AND OccurredTime > {_OR_HZ} - INTERVAL 28 DAY)""") + """
SELECT count(*)::BIGINT AS persons, count(*)::BIGINT AS pdf_sums_one, count(*)::BIGINT AS in_unit,
       count(*)::BIGINT AS rises_with_days FROM act""")
def q_classifier_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold for a fitted classifier: one row per active person, each pdf a distribution,
    each score a probability that does not fall as a person stays away longer."""
    from eventide.operators.mllib_model import fit_classifier, predict_pdf
    from eventide.operators.stats import time_mean_std

    ev, train, _ = _orders_train_sets(spark, sf)
    st = time_mean_std(ev).first()
    model = fit_classifier(train, st["mean"], st["std"], max_iter=20)
    p = predict_pdf(model, test_set(ev, ORP), st["mean"], st["std"])
    total = F.aggregate("pdf", F.lit(0.0), lambda a, x: a + x)
    score, later = (churn_probability(F.col("pdf"), F.col("days_d") + F.lit(d)) for d in (0.0, 5.0))

    def n(c):
        return F.sum(c.cast("bigint"))

    return p.select("PersonId", total.alias("t"), score.alias("a"), later.alias("b")).agg(
        F.countDistinct("PersonId").alias("persons"), n(F.abs(F.col("t") - 1) < 1e-9).alias("pdf_sums_one"),
        n(F.col("a").between(-1e-9, 1 + 1e-9)).alias("in_unit"), n(F.col("b") >= F.col("a") - 1e-9).alias("rises_with_days"))


@register("classifier_scores", None)
def q_classifier_scores(spark: SparkSession, sf: str) -> DataFrame:
    from eventide.operators.mllib_model import churn_from_classifier, fit_classifier
    from eventide.operators.stats import time_mean_std

    ev, train, _ = _orders_train_sets(spark, sf)
    st = time_mean_std(ev).first()
    model = fit_classifier(train, st["mean"], st["std"], max_iter=20)
    scored = churn_from_classifier(model, test_set(ev, ORP), st["mean"], st["std"])
    return scored.select("PersonId", F.col("prediction").cast("int").alias("predicted_bucket"),
                         F.round("score", 6).alias("score"))
