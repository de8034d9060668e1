"""The registered queries: one Spark builder and one DuckDB oracle per operator group.

Parameters per driver table (see SURVEY §7.1): ``events`` covers 30 days, so it takes a 7-day
horizon and H = 8; ``orders`` covers 6.5 years and takes the native 28-day horizon and H = 64.
Every query reads whole tables. Outputs are compared as text for times (microseconds),
joined text for arrays and doubles rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions import time as tf
from eventide.functions.messages import message_key, to_message
from eventide.functions.time import ts_lit, ts_text
from eventide.operators import extract as X
from eventide.operators.filters import persons_active_in_window, persons_with_history, time_cutoff
from eventide.operators.history import (histories_at, last_history_time, next_event_at,
                                        with_label)
from eventide.operators.split import user_split
from eventide.operators.stats import time_bounds_values, time_mean_std, vocabulary
from eventide.plans import sqlparts as S
from eventide.plans.preprocess import PrepParams, test_set
from eventide.schema import TRAINING_REQUEST
from eventide.sources.tables import account_events, load_events

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}

EVP = PrepParams(horizon_days=7, history_size=8, sample_buckets=4)
ORP = PrepParams(horizon_days=28, history_size=64, sample_buckets=16)
EXTRACT_ACCOUNT, EXTRACT_APP = 2, "app1"
LATEST_N = 32


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _types(arr: str = "history") -> Column:
    return F.array_join(F.transform(F.col(arr), lambda x: F.coalesce(
        x.getField("DefinitionId"), F.lit("-"))), ",")


def _keys(arr: str = "history") -> Column:
    return F.array_join(F.transform(F.col(arr), lambda x: F.coalesce(
        x.getField("EventKey").cast("string"), F.lit("-"))), ",")


def _sample_view(df: DataFrame, *extra: str | Column) -> DataFrame:
    return df.select(
        *extra, "PersonId", F.col("history_len"), _types().alias("history_types"),
        ts_text(last_history_time()).alias("last_time"),
        F.col("next_event.DefinitionId").alias("next_type"),
        ts_text(F.col("next_event.OccurredTime")).alias("next_time"),
        "label")


def _event_view(df: DataFrame) -> DataFrame:
    return df.select("AccountId", "ApplicationId", "ModelId", "DefinitionId",
                     ts_text("OccurredTime").alias("OccurredTime"), "OccurredTimeTicks",
                     "PersonId", "EventKey")


# ---- oracle building blocks -------------------------------------------------------------

def _hist_sql(src: str, t0: str, h: int, extra_where: str = "") -> str:
    """CTE body: per person last h events before t0 (types with '-' padding), last time."""
    return f"""SELECT PersonId, CAST(count(*) AS INTEGER) AS history_len,
        repeat('-,', {h} - count(*)) || string_agg(DefinitionId, ',' ORDER BY rn DESC)
            AS history_types,
        repeat('-,', {h} - count(*)) || string_agg(CAST(EventKey AS VARCHAR), ',' ORDER BY rn DESC)
            AS history_keys,
        max(OccurredTime) AS last_time,
        max(CASE WHEN rn = 1 THEN DefinitionId END) AS last_type
      FROM (SELECT *, row_number() OVER (PARTITION BY PersonId ORDER BY {S.ORDER_DESC}) AS rn
            FROM {src} WHERE OccurredTime < {t0} {extra_where})
      WHERE rn <= {h} GROUP BY PersonId"""


def _next_sql(src: str, t0: str) -> str:
    return f"""SELECT PersonId, DefinitionId AS next_type, OccurredTime AS next_time,
        EventKey AS next_key
      FROM (SELECT *, row_number() OVER (PARTITION BY PersonId ORDER BY {S.ORDER_ASC}) AS rn
            FROM {src} WHERE OccurredTime >= {t0}) WHERE rn = 1"""


def _sample_select(h: str, n: str, label_ref: str = "h.last_time", extra: str = "") -> str:
    return f"""SELECT {extra} h.PersonId, h.history_len, h.history_types,
        {S.ts('h.last_time')} AS last_time, {n}.next_type, {S.ts(f'{n}.next_time')} AS next_time,
        {S.label(f'{n}.next_time', label_ref)} AS label"""


MX = "(SELECT max(OccurredTime) FROM ev)"

# ---- S01 + A08 -------------------------------------------------------------------------------


@register("account_extract", S.with_ctes(S.EV_EVENTS) + f"""
SELECT DISTINCT AccountId, ApplicationId, ModelId, DefinitionId, {S.ts('OccurredTime')} AS OccurredTime,
       OccurredTimeTicks, PersonId, EventKey
FROM (SELECT * FROM ev UNION ALL SELECT * FROM ev)
WHERE AccountId = {EXTRACT_ACCOUNT} AND ApplicationId = '{EXTRACT_APP}'""")
def q_account_extract(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_events(spark, sf, "events")
    with_copies = ev.unionByName(ev)  # every row twice: the extract must remove exact copies
    return _event_view(X.dedupe_events(account_events(with_copies, EXTRACT_ACCOUNT, EXTRACT_APP)))


# ---- W01 -------------------------------------------------------------------------------------


@register("latest_n_per_person", S.with_ctes(S.EV_EVENTS) + f"""
SELECT PersonId, EventKey, DefinitionId, {S.ts('OccurredTime')} AS OccurredTime
FROM (SELECT *, row_number() OVER (PARTITION BY PersonId ORDER BY OccurredTimeTicks DESC,
        OccurredTime DESC, DefinitionId DESC, EventKey DESC) AS rn FROM ev)
WHERE rn <= {LATEST_N}""")
def q_latest_n(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_events(spark, sf, "events")
    return X.latest_per_person(ev, LATEST_N).select(
        "PersonId", "EventKey", "DefinitionId", ts_text("OccurredTime").alias("OccurredTime"))


# ---- W02 / W03 -------------------------------------------------------------------------------


@register("canonical_events", S.with_ctes(S.EV_EVENTS) + f"""
SELECT PersonId, CAST(row_number() OVER (PARTITION BY PersonId ORDER BY {S.ORDER_ASC}) AS INTEGER) AS seq,
       EventKey, DefinitionId, {S.ts('OccurredTime')} AS OccurredTime, AccountId
FROM (SELECT DISTINCT * FROM (SELECT * FROM ev UNION ALL SELECT * FROM ev))""")
def q_canonical(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_events(spark, sf, "events")
    canon = X.canonical_events(ev.unionByName(ev))
    return X.with_event_seq(canon).select(
        "PersonId", "seq", "EventKey", "DefinitionId",
        ts_text("OccurredTime").alias("OccurredTime"), "AccountId")


# ---- S05 / A05 -------------------------------------------------------------------------------


@register("registered_models", S.with_ctes(S.EV_EVENTS) + """
SELECT DISTINCT AccountId, ModelId, ApplicationId FROM ev""")
def q_registered_models(spark: SparkSession, sf: str) -> DataFrame:
    return X.registered_models(load_events(spark, sf, "events"))


@register("account_counts", S.with_ctes(S.EV_EVENTS) + """
SELECT AccountId, CAST(count(*) AS BIGINT) AS n_rows FROM ev GROUP BY AccountId""")
def q_account_counts(spark: SparkSession, sf: str) -> DataFrame:
    return X.account_counts(load_events(spark, sf, "events"))


# ---- F01 / F02 / F03 (orders, native 28-day horizon) ------------------------------------------


@register("time_cutoff", S.with_ctes(S.EV_ORDERS) + f"""
SELECT PersonId, EventKey, {S.ts('OccurredTime')} AS OccurredTime FROM ev
WHERE OccurredTime < {MX} - INTERVAL 28 DAY""")
def q_time_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_events(spark, sf, "orders")
    _, mx = time_bounds_values(ev)
    return time_cutoff(ev, mx - timedelta(days=28)).select(
        "PersonId", "EventKey", ts_text("OccurredTime").alias("OccurredTime"))


@register("persons_with_history", S.with_ctes(S.EV_ORDERS, f"""cut AS (
  SELECT * FROM ev WHERE OccurredTime < {MX} - INTERVAL 28 DAY)""") + f"""
SELECT PersonId, EventKey FROM cut
WHERE PersonId IN (SELECT PersonId FROM cut WHERE OccurredTime < {MX} - INTERVAL 56 DAY)""")
def q_persons_with_history(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_events(spark, sf, "orders")
    _, mx = time_bounds_values(ev)
    cut = time_cutoff(ev, mx - timedelta(days=28))
    return persons_with_history(cut, mx - timedelta(days=56)).select("PersonId", "EventKey")


@register("persons_active_in_window", S.with_ctes(S.EV_ORDERS) + f"""
SELECT PersonId, EventKey FROM ev
WHERE PersonId IN (SELECT PersonId FROM ev WHERE OccurredTime < {MX} - INTERVAL 28 DAY
                   AND OccurredTime > {MX} - INTERVAL 56 DAY)""")
def q_persons_active(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_events(spark, sf, "orders")
    _, mx = time_bounds_values(ev)
    return persons_active_in_window(ev, mx - timedelta(days=28), 28).select(
        "PersonId", "EventKey")


# ---- A03 / A04 / J08 -------------------------------------------------------------------------


@register("vocab", S.with_ctes(S.EV_EVENTS) + """
SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS INTEGER) AS token_id
FROM (SELECT DISTINCT DefinitionId AS token FROM ev WHERE DefinitionId IS NOT NULL)""")
def q_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary(load_events(spark, sf, "events"))


@register("time_stats", S.with_ctes(S.EV_EVENTS) + """
SELECT CAST(trunc(avg(OccurredTimeTicks) / 1000000.0) AS BIGINT) AS mean,
       CAST(trunc(stddev_samp(OccurredTimeTicks) / 1000000.0) AS BIGINT) AS std FROM ev""")
def q_time_stats(spark: SparkSession, sf: str) -> DataFrame:
    return time_mean_std(load_events(spark, sf, "events"))


# the vocabulary of the token-id query is learnt on the rows before the 7-day horizon of
# `orders`-style training; ids of unseen or null tokens are the vocabulary size
@register("token_ids", S.with_ctes(S.EV_ORDERS, f"""voc AS (
  SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id
  FROM (SELECT DISTINCT DefinitionId AS token FROM ev
        WHERE DefinitionId IS NOT NULL AND OccurredTime < {MX} - INTERVAL 28 DAY))""") + """
SELECT ev.EventKey, ev.PersonId, ev.DefinitionId,
       CAST(coalesce(voc.token_id, (SELECT count(*) FROM voc)) AS INTEGER) AS token_id
FROM ev LEFT JOIN voc ON ev.DefinitionId = voc.token""")
def q_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    from eventide.functions.tokens import token_ids

    ev = load_events(spark, sf, "orders")
    _, mx = time_bounds_values(ev)
    voc = vocabulary(time_cutoff(ev, mx - timedelta(days=28)))
    return token_ids(ev, voc).select("EventKey", "PersonId", "DefinitionId", "token_id")


# ---- P01 / J04 -------------------------------------------------------------------------------

_SPLIT_SQL = """split AS (
  SELECT PersonId, rk AS split_rank,
         CASE WHEN rk <= floor(n * {ratio}::DOUBLE) THEN 'train' ELSE 'validation' END AS split
  FROM (SELECT PersonId, row_number() OVER (ORDER BY md5('{seed}:' || CAST(PersonId AS VARCHAR)),
                                                     PersonId) AS rk,
               count(*) OVER () AS n
        FROM (SELECT DISTINCT PersonId FROM {src})))"""


@register("user_split", S.with_ctes(S.EV_EVENTS, _SPLIT_SQL.format(ratio=0.8, seed=42, src="ev"))
          + "SELECT PersonId, CAST(split_rank AS BIGINT) AS split_rank, split FROM split")
def q_user_split(spark: SparkSession, sf: str) -> DataFrame:
    return user_split(load_events(spark, sf, "events"), ratio=0.8, seed=42)


@register("split_events", S.with_ctes(S.EV_EVENTS, _SPLIT_SQL.format(ratio=0.8, seed=42, src="ev"))
          + "SELECT ev.PersonId, ev.EventKey, split.split FROM ev JOIN split USING (PersonId)")
def q_split_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_events(spark, sf, "events")
    sp = user_split(ev, ratio=0.8, seed=42)
    return ev.join(sp, "PersonId").select("PersonId", "EventKey", "split")


# ---- H01 / H02 / H03 / H04 / H05 -------------------------------------------------------------

_EV_H = f"({MX} - INTERVAL 7 DAY)"


@register("history_at_horizon", S.with_ctes(S.EV_EVENTS, f"h AS ({_hist_sql('ev', _EV_H, 8)})")
          + "SELECT PersonId, history_len, history_types, history_keys FROM h")
def q_history_at_horizon(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_events(spark, sf, "events")
    _, mx = time_bounds_values(ev)
    hist = histories_at(ev, mx - timedelta(days=7), 8)
    return hist.select("PersonId", "history_len", _types().alias("history_types"),
                       _keys().alias("history_keys"))


@register("next_event_at_horizon", S.with_ctes(S.EV_EVENTS, f"n AS ({_next_sql('ev', _EV_H)})")
          + f"""SELECT p.PersonId, n.next_type, {S.ts('n.next_time')} AS next_time, n.next_key
FROM (SELECT DISTINCT PersonId FROM ev) p LEFT JOIN n USING (PersonId)""")
def q_next_event_at_horizon(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_events(spark, sf, "events")
    _, mx = time_bounds_values(ev)
    nx = next_event_at(ev, mx - timedelta(days=7))
    return nx.select("PersonId", F.col("next_event.DefinitionId").alias("next_type"),
                     ts_text(F.col("next_event.OccurredTime")).alias("next_time"),
                     F.col("next_event.EventKey").alias("next_key"))


def _test_set_sql(src_cte: str, days: int, h: int) -> str:
    hz = f"({MX} - INTERVAL {days} DAY)"
    act = (f"act AS (SELECT * FROM ev WHERE PersonId IN (SELECT PersonId FROM ev WHERE "
           f"OccurredTime < {hz} AND OccurredTime > {hz} - INTERVAL {days} DAY))")
    return S.with_ctes(src_cte, act, f"h AS ({_hist_sql('act', hz, h)})",
                       f"n AS ({_next_sql('act', hz)})") + "\n" + _sample_select("h", "n") + \
        "\nFROM h LEFT JOIN n USING (PersonId)"


@register("test_samples", _test_set_sql(S.EV_EVENTS, 7, 8))
def q_test_samples(spark: SparkSession, sf: str) -> DataFrame:
    return _sample_view(test_set(load_events(spark, sf, "events"), EVP))


@register("preprocess_test", _test_set_sql(S.EV_ORDERS, 28, 64))
def q_preprocess_test(spark: SparkSession, sf: str) -> DataFrame:
    return _sample_view(test_set(load_events(spark, sf, "orders"), ORP))


# ---- C02 / C03 -------------------------------------------------------------------------------

_OR_H56 = f"({MX} - INTERVAL 56 DAY)"


@register("label_distribution", S.with_ctes(
    S.EV_ORDERS, f"h AS ({_hist_sql('ev', _OR_H56, 64)})", f"n AS ({_next_sql('ev', _OR_H56)})")
    + f"""SELECT 't0' AS label_from, {S.label('n.next_time', _OR_H56)} AS label, CAST(count(*) AS BIGINT) AS n
FROM h LEFT JOIN n USING (PersonId) GROUP BY 1, 2
UNION ALL
SELECT 'last_event' AS label_from, {S.label('n.next_time', 'h.last_time')} AS label, CAST(count(*) AS BIGINT) AS n
FROM h LEFT JOIN n USING (PersonId) GROUP BY 1, 2""")
def q_label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """C02 / C03 at one t0 (max - 56 d): labels measured from t0 and from the last event (Q1)."""
    ev = load_events(spark, sf, "orders")
    _, mx = time_bounds_values(ev)
    t0 = mx - timedelta(days=56)
    s = histories_at(ev, t0, 64).withColumn("t0", ts_lit(t0))
    out = None
    for ref in ("t0", "last_event"):
        d = with_label(s, label_from=ref).groupBy("label").agg(
            F.count(F.lit(1)).cast("bigint").alias("n")).select(
            F.lit(ref).alias("label_from"), "label", "n")
        out = d if out is None else out.unionByName(d)
    return out


# ---- C06-C09 ---------------------------------------------------------------------------------

_PERIODS = {"day": 86400.0, "week": 604800.0, "month": 2628000.0, "year": 31536000.0}


def _feat_sql() -> str:
    cols = []
    for name, p in _PERIODS.items():
        ang = f"((((epoch_s % {p}) + {p}) % {p}) - {p / 2}) / ({p} / pi())"
        cols.append(f"round(sin({ang}), 6) AS {name}_sin")
        cols.append(f"round(cos({ang}), 6) AS {name}_cos")
    cols.append("round((epoch_s - st.mean) / st.std, 6) AS z")
    return ", ".join(cols)


@register("time_features", S.with_ctes(
    S.EV_EVENTS,
    """st AS (SELECT CAST(trunc(avg(OccurredTimeTicks) / 1000000.0) AS BIGINT) AS mean,
       CAST(trunc(stddev_samp(OccurredTimeTicks) / 1000000.0) AS BIGINT) AS std FROM ev)""",
    "e AS (SELECT EventKey, CAST(floor(OccurredTimeTicks / 1000000.0) AS DOUBLE) AS epoch_s FROM ev)")
    + f"\nSELECT EventKey, {_feat_sql()} FROM e, st")
def q_time_features(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_events(spark, sf, "events")
    st = time_mean_std(ev).first()  # two scalars (A04), used as literals
    j = ev.select("EventKey", tf.epoch_seconds("OccurredTime").alias("_s"))
    feats = tf.time_features(F.col("_s"), F.lit(float(st["mean"])), F.lit(float(st["std"])))
    return j.select("EventKey", *[F.round(c, 6).alias(n) for n, c in feats])


# ---- S08 -------------------------------------------------------------------------------------


@register("parsed_times", S.with_ctes(S.EV_EVENTS) + f"""
SELECT EventKey, {S.ts('OccurredTime')} AS parsed,
       CASE WHEN OccurredTimeTicks % 1000000 = 0 THEN strftime(OccurredTime, '%Y-%m-%d %H:%M:%S')
            ELSE {S.ts('OccurredTime')} END AS text FROM ev""")
def q_parsed_times(spark: SparkSession, sf: str) -> DataFrame:
    ev = load_events(spark, sf, "events")
    text = F.when(F.col("OccurredTimeTicks") % 1_000_000 == 0,
                  F.date_format("OccurredTime", "yyyy-MM-dd HH:mm:ss")).otherwise(
        ts_text("OccurredTime"))
    t = ev.select("EventKey", text.alias("text"))
    return t.select("EventKey", ts_text(tf.parse_event_time("text")).alias("parsed"), "text")


# ---- messages: K08 / C15 / E06 / E07 ---------------------------------------------------------


def _json_sql() -> str:
    app = "CASE WHEN ApplicationId IS NULL THEN 'null' ELSE '\"' || ApplicationId || '\"' END"
    return ("'{\"AccountId\":' || CAST(AccountId AS VARCHAR) || ',\"ApplicationId\":' || " + app
            + " || ',\"ModelId\":\"' || ModelId || '\",\"task_type\":\"churn\",'"
            + " || '\"total_no_of_records\":0}'")


@register("message_json", S.with_ctes(S.EV_EVENTS) + f"""
SELECT 'AccountId=''' || CAST(AccountId AS VARCHAR) || ''', ModelId=''' || ModelId || '''' AS key,
       {_json_sql()} AS value
FROM (SELECT DISTINCT AccountId, ModelId, ApplicationId FROM ev)""")
def q_message_json(spark: SparkSession, sf: str) -> DataFrame:
    from eventide.plans.requests import training_requests

    req = training_requests(X.registered_models(load_events(spark, sf, "events")))
    return req.select(message_key(req).alias("key"), to_message(TRAINING_REQUEST).alias("value"))


@register("training_requests", S.with_ctes(S.EV_EVENTS) + """
SELECT AccountId, ApplicationId, ModelId, 'churn' AS task_type, CAST(0 AS BIGINT) AS total_no_of_records
FROM (SELECT DISTINCT AccountId, ModelId, ApplicationId FROM ev)""")
def q_training_requests(spark: SparkSession, sf: str) -> DataFrame:
    from eventide.plans.requests import training_requests

    return training_requests(X.registered_models(load_events(spark, sf, "events")))


@register("prediction_requests", S.with_ctes(S.EV_EVENTS) + """
SELECT AccountId, ApplicationId, ModelId, 'churn' AS task_type
FROM (SELECT DISTINCT AccountId, ModelId, ApplicationId FROM ev)""")
def q_prediction_requests(spark: SparkSession, sf: str) -> DataFrame:
    from eventide.plans.requests import prediction_requests

    return prediction_requests(X.registered_models(load_events(spark, sf, "events")))


def queries() -> dict[str, QueryFn]:
    from eventide.plans import catalog_learn, catalog_model  # noqa: F401  (registers the model / flow queries)

    return dict(QUERIES)


def oracles() -> dict[str, str]:
    from eventide.plans import catalog_learn, catalog_model  # noqa: F401

    return dict(ORACLES)
