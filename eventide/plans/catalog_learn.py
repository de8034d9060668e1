"""Registered queries of the models that learn from the order and the kinds of events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.config import DAY_US
from eventide.functions.time import epoch_us, ts_text
from eventide.operators import context_tree as CT
from eventide.operators import embedding as EM
from eventide.operators import newton as N
from eventide.operators.filters import time_cutoff
from eventide.operators.metrics import mean_log_loss
from eventide.operators.model import attach_pdf, bucket_pdf
from eventide.operators.positions import chunked_running_sum
from eventide.operators.stats import time_bounds_values
from eventide.plans import sqlparts as S
from eventide.plans.catalog import EVP, LATEST_N, register
from eventide.plans.catalog_model import _dbl, _pdf_cols, _pdf_ctes, _pdf_pick, _sets, _train_ctes
from eventide.schema import EVENT_MESSAGE
from eventide.session import cut_lineage, stage_path
from eventide.sinks.latest import advance, read_latest
from eventide.sinks.seen import filters, new_events
from eventide.sinks.vocabulary import grow, read_vocabulary
from eventide.sources.tables import load_events

N_CLASSES = CT.N_CLASSES


# ---- M01: context tree ----------------------------------------------------------------------

def _context_ctes() -> list[str]:
    gap = S.day_bucket("(epoch_us(h.OccurredTime) - epoch_us(o.OccurredTime))")
    own = "x.g = t.g AND x.PersonId = t.PersonId AND x.t0 = t.t0"
    counts = ", ".join(f"{_dbl(f'sum(CASE WHEN label = {k} THEN 1 ELSE 0 END)')} AS c{k}" for k in range(N_CLASSES))
    root = ", ".join(f"(c{k} + 1.0) / ({_dbl('n')} + {N_CLASSES}.0) AS p{k}" for k in range(N_CLASSES))
    mixed = ", ".join(f"(c.c{k} + {CT.STRENGTH} * a.p{k}) / ({_dbl('c.n')} + {CT.STRENGTH}) AS p{k}"
                      for k in range(N_CLASSES))
    ps = ", ".join(f"p{k}" for k in range(N_CLASSES))
    return [
        f"""sym AS (SELECT h.g, h.PersonId, h.t0, h.rn, h.DefinitionId || '~' ||
              CASE WHEN o.rn IS NULL THEN 'f' ELSE CAST({gap} AS VARCHAR) END AS s
            FROM hh h LEFT JOIN hh o ON o.g = h.g AND o.PersonId = h.PersonId AND o.t0 = h.t0
              AND o.rn = h.rn + 1 AND o.rn <= {EVP.history_size} WHERE h.rn <= {CT.DEPTH})""",
        f"""ctx AS (SELECT t.g, t.PersonId, t.t0, t.label, d.d,
              coalesce(string_agg(x.s, '>' ORDER BY x.rn), '') AS context
            FROM ts t JOIN (SELECT unnest(range(0, {CT.DEPTH + 1})) AS d) d ON d.d <= t.history_len
            LEFT JOIN sym x ON {own} AND x.rn <= d.d WHERE t.label IS NOT NULL
            GROUP BY t.g, t.PersonId, t.t0, t.label, d.d)""",
        f"""cnt AS (SELECT context, d, count(*) AS n, {counts} FROM ctx WHERE g = 'train' GROUP BY context, d
            HAVING d = 0 OR count(*) >= {CT.LEAST})""",
        f"l0 AS (SELECT context, d, n, {root} FROM cnt WHERE d = 0)",
        *[f"""l{d} AS (SELECT c.context, c.d, c.n, {mixed} FROM cnt c JOIN l{d - 1} a
              ON a.context = array_to_string(list_slice(string_split(c.context, '>'), 1, {d - 1}), '>')
            WHERE c.d = {d})""" for d in range(1, CT.DEPTH + 1)],
        "tree AS (" + " UNION ALL ".join(f"SELECT context, d, n, {ps} FROM l{d}" for d in range(CT.DEPTH + 1)) + ")",
        f"""val AS (SELECT PersonId, t0, label, {ps}, tree.d AS depth, row_number() OVER (PARTITION BY PersonId, t0
              ORDER BY tree.d DESC) AS best FROM ctx JOIN tree USING (context) WHERE g = 'validation' AND ctx.d = tree.d)""",
    ]


_TREE = [*_train_ctes(S.EV_EVENTS, EVP), *_context_ctes()]


def _context_log_loss_sql() -> str:
    join, cols = _pdf_pick("ts.last_type")
    pick = "CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 WHEN 4 THEN p4 ELSE p5 END"
    return S.with_ctes(*_TREE, *_pdf_ctes()) + f"""
SELECT a.log_loss, a.n, b.last_type_log_loss, a.log_loss < b.last_type_log_loss AS better FROM
  (SELECT round(avg(-ln({pick})), 6) AS log_loss, CAST(count(*) AS BIGINT) AS n FROM val WHERE best = 1) a,
  (SELECT round(avg(-ln({pick})), 6) AS last_type_log_loss FROM
    (SELECT ts.label, {cols} FROM ts {join} WHERE ts.g = 'validation' AND ts.label IS NOT NULL)) b"""


@register("context_tree", S.with_ctes(*_TREE) + "\nSELECT context, CAST(d AS INTEGER) AS depth, CAST(n AS BIGINT) AS n, "
          + ", ".join(f"round(p{k}, 6) AS p{k}" for k in range(N_CLASSES)) + " FROM tree")
def q_context_tree(spark: SparkSession, sf: str) -> DataFrame:
    """All stored contexts of the training samples with their mixed distributions."""
    train, _ = _sets(spark, sf, "events")
    tree = CT.context_tree(train)
    return tree.select(F.array_join("context", ">").alias("context"), "depth", "n", *_pdf_cols(tree))


@register("context_orders", S.with_ctes(*_TREE) + """
SELECT CAST(depth AS INTEGER) AS depth, CAST(count(*) AS BIGINT) AS n_samples FROM val WHERE best = 1 GROUP BY depth""")
def q_context_orders(spark: SparkSession, sf: str) -> DataFrame:
    """How many validation samples find their longest stored context at each depth."""
    train, val = _sets(spark, sf, "events")
    found = CT.attach_context_pdf(val.where("label is not null"), CT.context_tree(train))
    return found.groupBy(F.col("order").cast("int").alias("depth")).agg(F.count(F.lit(1)).alias("n_samples"))


@register("context_log_loss", _context_log_loss_sql())
def q_context_log_loss(spark: SparkSession, sf: str) -> DataFrame:
    """A10 of the context tree beside that of the last type alone, on the validation samples."""
    train, val = _sets(spark, sf, "events")
    labelled = val.where("label is not null")
    deep = mean_log_loss(CT.attach_context_pdf(labelled, CT.context_tree(train)))
    flat = mean_log_loss(attach_pdf(labelled, bucket_pdf(train)))
    both = deep.withColumn("k", F.lit(0)).unionByName(flat.withColumn("k", F.lit(1)))
    a, b = (F.round(F.max(F.when(F.col("k") == k, F.col("log_loss"))), 6) for k in (0, 1))
    return both.agg(a.alias("log_loss"), F.max(F.when(F.col("k") == 0, F.col("n"))).alias("n"),
                    b.alias("last_type_log_loss")).withColumn("better", F.expr("log_loss < last_type_log_loss"))


# ---- M02: all models in one fit ---------------------------------------------------------------

def _model_of(person: str = "PersonId") -> list:
    """The models of the test tables follow from the person (see ``sources.tables``)."""
    return [F.pmod(F.col(person), F.lit(5)).cast("bigint").alias("AccountId"),
            F.concat(F.lit("churn-"), F.pmod(F.col(person), F.lit(2)).cast("string")).alias("ModelId")]


@register("model_regressions", S.with_ctes(*_train_ctes(S.EV_EVENTS, EVP)) + """
SELECT CAST(PersonId % 5 AS BIGINT) AS AccountId, 'churn-' || CAST(PersonId % 2 AS VARCHAR) AS ModelId,
       CAST(count(*) AS BIGINT) AS n, true AS converged, true AS at_minimum, """ + ", ".join(
    f"round({_dbl(f'sum(CASE WHEN label = {k} THEN 1 ELSE 0 END)')}, 4) AS expected{k}" for k in range(N_CLASSES)) + """
FROM ts WHERE g = 'train' AND label IS NOT NULL GROUP BY 1, 2""")
def q_model_regressions(spark: SparkSession, sf: str) -> DataFrame:
    """One regression per (AccountId, ModelId), all fitted at once.

    At the minimum the free intercepts make each model expect as many samples of every bucket as its
    training samples hold, which is what the SQL counts.
    """
    train, _ = _sets(spark, sf, "events")
    by = ["AccountId", "ModelId"]
    rows = train.where("label is not null").select(*_model_of(), "label", *N.history_features())
    models = cut_lineage(N.fit_all(N.sufficient(rows, by, N.FEATURES), by), "regressions")
    expected = N.predict_all(rows, models, by, N.FEATURES).groupBy(*by).agg(
        *[F.round(F.sum(F.col("pdf").getItem(k)), 4).alias(f"expected{k}") for k in range(N_CLASSES)])
    return models.select(*by, "n", "converged", (F.col("gradient_max") < 1e-6).alias("at_minimum")).join(expected, by)


# ---- M01: event-type vectors ------------------------------------------------------------------

def _positions(spark: SparkSession, sf: str) -> DataFrame:
    """(PersonId, pos, DefinitionId) of the events log; a type here is an event's type and application."""
    kind = F.concat("DefinitionId", F.lit("/"), F.coalesce("ApplicationId", F.lit("")))
    ev = load_events(spark, sf, "events").select(
        "PersonId", epoch_us("OccurredTime").alias("_t"), "OccurredTimeTicks", "DefinitionId", "EventKey",
        kind.alias("_kind"), F.lit(1).alias("_one"))
    order = [F.col(c) for c in ("_t", "OccurredTimeTicks", "DefinitionId", "EventKey")]
    return cut_lineage(chunked_running_sum(ev, ["PersonId"], "_t", order, "_one", DAY_US, out="pos").select(
        "PersonId", "pos", F.col("_kind").alias("DefinitionId")), "positions")


_PAIRS = [
    S.EV_EVENTS,
    f"""ps AS (SELECT PersonId, DefinitionId || '/' || coalesce(ApplicationId, '') AS k,
          row_number() OVER (PARTITION BY PersonId ORDER BY {S.ORDER_ASC}) AS pos FROM ev)""",
    f"""one AS (SELECT a.k AS "row", b.k AS col, count(*) AS n FROM ps a JOIN ps b ON a.PersonId = b.PersonId
          AND b.pos > a.pos AND b.pos <= a.pos + {EM.WINDOW} GROUP BY 1, 2)""",
    'cc AS (SELECT "row", col, sum(n) AS n FROM (SELECT * FROM one UNION ALL SELECT col, "row", n FROM one) GROUP BY 1, 2)',
    'marg AS (SELECT "row" AS k, sum(n) AS n FROM cc GROUP BY 1)',
    f"""pm AS (SELECT cc."row", cc.col, cc.n, ln({_dbl('cc.n')} * (SELECT sum(n) FROM cc) / ({_dbl('a.n')} * {_dbl('b.n')})) + 1.0 AS value
          FROM cc JOIN marg a ON a.k = cc."row" JOIN marg b ON b.k = cc.col)""",
]


@register("type_cooccurrence", S.with_ctes(*_PAIRS) + '\nSELECT "row", col, CAST(n AS BIGINT) AS n FROM cc')
def q_type_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    """How often two event types stand near each other in a person's log."""
    return EM.cooccurrence(_positions(spark, sf))


@register("type_vectors", S.with_ctes(*_PAIRS) + """
SELECT "row", col, round(value, 5) AS value, round(value, 5) AS from_vectors FROM pm WHERE value > 0""")
def q_type_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The table of shifted PMI, and what the vectors of as many dimensions as there are types give
    back for it."""
    table = cut_lineage(EM.ppmi(EM.cooccurrence(_positions(spark, sf))), "pmi")
    q, values = EM.factorised(table, rank=24, extra=0, rounds=1)
    got = EM.approximated(table, q, values)
    return got.select("row", "col", F.round("value", 5).alias("value"), F.round("approximate", 5).alias("from_vectors"))


# ---- S09 / A08: what a batch adds to a stored feed ----------------------------------------------

_FEED = [f.name for f in EVENT_MESSAGE.fields]


@register("feed_new_events", S.with_ctes(S.EV_EVENTS) + f"""
SELECT {", ".join(f for f in _FEED if f != "OccurredTime")}, {S.ts('OccurredTime')} AS OccurredTime FROM
  (SELECT {", ".join(_FEED)} FROM ev EXCEPT SELECT {", ".join(_FEED)} FROM ev WHERE EventKey % 3 > 0)""")
def q_feed_new_events(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the events are stored with their filters; all come again as one batch."""
    ev = load_events(spark, sf, "events").select("EventKey", *_FEED, F.to_date("OccurredTime").alias("day"))
    stored = cut_lineage(ev.where("EventKey % 3 > 0").drop("EventKey").dropDuplicates(), "stored")
    feed = stage_path(spark, "feed")
    filters(stored, _FEED).write.partitionBy("day").parquet(f"{feed}/filters")
    stored.repartition("day").write.partitionBy("AccountId", "day").parquet(f"{feed}/events")
    batch = cut_lineage(ev.drop("EventKey").dropDuplicates(), "batch")
    new = new_events(batch, f"{feed}/events", f"{feed}/filters", _FEED)
    return new.select(*[f for f in _FEED if f != "OccurredTime"], ts_text("OccurredTime").alias("OccurredTime"))


# ---- W01 / A03 by increments --------------------------------------------------------------------

@register("latest_by_increments", S.with_ctes(S.EV_EVENTS) + f"""
SELECT PersonId, EventKey, DefinitionId, {S.ts('OccurredTime')} AS OccurredTime
FROM (SELECT *, row_number() OVER (PARTITION BY PersonId ORDER BY OccurredTimeTicks DESC,
        OccurredTime DESC, DefinitionId DESC, EventKey DESC) AS rn FROM ev)
WHERE rn <= {LATEST_N}""")
def q_latest_by_increments(spark: SparkSession, sf: str) -> DataFrame:
    """W01 from three increments of the log, in an order of arrival in which two thirds are late."""
    ev = cut_lineage(load_events(spark, sf, "events").withColumn(
        "arrival", F.pmod("EventKey", F.lit(3)) * F.lit(10**12) + F.col("EventKey")), "log")
    path = f"{stage_path(spark, 'latest')}/rows"
    for k in (1, 2, 3):
        advance(ev.where(F.col("arrival") < F.lit(k * 10**12)), path, LATEST_N, mark="arrival")
    return read_latest(spark, path).select(
        "PersonId", "EventKey", "DefinitionId", ts_text("OccurredTime").alias("OccurredTime"))


@register("stable_vocabulary", S.with_ctes(
    S.EV_EVENTS, f"""ty AS (SELECT DefinitionId || '/' || coalesce(ApplicationId, '') AS token, min(CASE
          WHEN OccurredTime < (SELECT min(OccurredTime) FROM ev) + INTERVAL 1 HOUR THEN 0
          WHEN OccurredTime < (SELECT min(OccurredTime) FROM ev) + INTERVAL 3 HOUR THEN 1 ELSE 2 END) AS step
        FROM ev GROUP BY 1)""") + """
SELECT token, CAST(row_number() OVER (ORDER BY step, token) - 1 AS INTEGER) AS token_id FROM ty""")
def q_stable_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """A03 by three growing inputs: the first hour, the first three hours, all; ids stay."""
    kind = F.concat("DefinitionId", F.lit("/"), F.coalesce("ApplicationId", F.lit("")))
    ev = load_events(spark, sf, "events").select("OccurredTime", kind.alias("DefinitionId"))
    start, _ = time_bounds_values(ev)
    path = stage_path(spark, "vocabulary")
    for hours in (1, 3, None):
        grow(ev if hours is None else time_cutoff(ev, start + timedelta(hours=hours)), path)
    return read_vocabulary(spark, path)
