"""Quality rules with adaptive thresholds (operator 2).

Five measures of a text (word length, symbols, repeated lines, repeated 8-word windows, words
equal to the one before) are compared with fences that follow the data instead of fixed cutoffs.
Each (lang, source) group gets a quantile sketch per measure: counts in logarithmic buckets of
relative width ``GAMMA - 1``. Such sketches merge by adding counts, so the sketch of a language or
of the whole corpus is the sum of its groups' sketches, and partial counts combine before any
shuffle. A measure fails above ``q75 + SPREADS * spread`` (the word length also below the mirrored
fence), where ``spread`` is the group's ``q75 - q25``. A measure that is the same, mostly 0, in half
of a group's texts has no spread of its own; there ``LEAST_SPREAD`` stands in for it, so that a group
of spotless texts does not reject the first blemish. No fence has a fixed place. Groups of fewer than
``min_docs`` texts take the fences of their language, small languages those of the corpus.

Null text reads as empty; null lang and null source are groups of their own; repeated rows are
judged like any other; an empty table gives no rows. Documents are never compared by ``doc_id``,
so null or repeated ids are harmless. Columns of the input pass through and win over clashing names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from eventide.llm import textbytes as tb
from eventide.llm.common import read
from eventide.session import cut_lineage

FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_echoes"]
WINDOW = 8
GAMMA = 1.02
SPREADS = 4.0
MIN_DOCS = 100
MIN_WORDS = 20
#: measure -> spread (per mille; of the word length, characters x 1000) where a group has less
LEAST_SPREAD = {
    "word_length": 100.0,
    "symbols": 25.0,
    "dup_lines": 100.0,
    "repeats": 60.0,
    "echoes": 5.0,
}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _dup_lines(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def slice_features(s: tb.Slice) -> np.ndarray:
    """One row of FEATURES per document of the slice."""
    w = tb.words(s)
    out = np.zeros((s.n_docs, len(FEATURES)), np.int64)
    out[:, 0] = np.diff(w.first)
    lead = (s.data & 0xC0) != 0x80
    out[:, 1] = _per_doc(lead & ~tb._SPACE[s.data], s.bounds)
    out[:, 2] = _per_doc(_SYMBOL[s.data], s.bounds)
    for i in range(s.n_docs):
        out[i, 3:5] = _dup_lines(s.text(i))
    runs = tb.windows(w.hash, WINDOW)
    own = np.flatnonzero(w.doc[:len(runs)] == w.doc[WINDOW - 1:]) if len(runs) else []
    if len(own):
        # the document is part of the key, so equal windows of two documents stay apart
        key = tb.mix(runs[own] ^ tb.mix(w.doc[own].astype(np.uint64) + np.uint64(1)))
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        at = own[times[which] > 1]
        cover = np.zeros(len(w.hash) + 1, np.int64)
        cover[at] += 1
        cover[at + WINDOW] -= 1
        out[:, 5] = _per_doc(np.cumsum(cover[:-1]) > 0, w.first)
    if len(w.hash):
        echo = np.zeros(len(w.hash), bool)
        echo[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
        out[:, 6] = _per_doc(echo, w.first)
    return out


def with_features(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all but the text by default) plus FEATURES, one row per row."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    sent = keep if text in keep else [*keep, text]
    schema = StructType([docs.schema[c] for c in keep] + [StructField(f, LongType()) for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [slice_features(s) for s in tb.slices(b.column(sent.index(text)))]
            got = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], *(pa.array(np.ascontiguousarray(c)) for c in got.T)],
                names=[*keep, *FEATURES])

    return docs.select(*sent).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Integer measures (per mille), floored; 0 where the denominator is 0."""
    def per_mille(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.floor(1000 * F.col(a) / F.col(b))).otherwise(F.lit(0)).cast("long")

    return {
        "word_length": per_mille("word_chars", "n_words"),
        "symbols": per_mille("n_symbols", "n_words"),
        "dup_lines": per_mille("n_dup_lines", "n_lines"),
        "repeats": per_mille("n_repeat_words", "n_words"),
        "echoes": per_mille("n_echoes", "n_words"),
    }


def sketch(feats: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable sketches; bucket 0 holds the value 0."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("v"))
                               for k, v in measures().items()])).alias("m")
    bucket = F.when(F.col("m.v") <= 0, 0).otherwise(
        F.ceil(F.log(F.col("m.v").cast("double")) / F.log(F.lit(GAMMA))) + 1)
    return (feats.where(F.col("n_words") >= MIN_WORDS).select("lang", "source", each)
            .groupBy("lang", "source", F.col("m.measure").alias("measure"),
                     bucket.cast("int").alias("bucket"))
            .agg(F.count("*").alias("n")))


def quantiles(sk: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches up to ``keys``; (keys, measure, n, q25, q75) with q the bucket's upper edge."""
    merged = sk.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by = [*keys, "measure"]
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy(*by))
    edge = F.when(F.col("bucket") == 0, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 1))
    at = merged.select(*by, "bucket", upto.alias("upto"), total.alias("total"), edge.alias("edge"))

    def q(p: float) -> Column:
        return F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("edge")))

    return at.groupBy(*by).agg(F.max("total").alias("n"), q(0.25).alias("q25"), q(0.75).alias("q75"))


def fences(sk: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (lang, source): ``lo_<measure>`` and ``hi_<measure>``."""
    groups = sk.groupBy("lang", "source", "measure").agg(F.sum("n").alias("own"))
    out = groups
    for level, keys in (("g", ["lang", "source"]), ("l", ["lang"]), ("c", [])):
        q = quantiles(sk, keys).select(
            *[F.col(k).alias(f"_{k}") for k in keys], F.col("measure").alias("_measure"),
            *[F.col(c).alias(f"{level}_{c}") for c in ("n", "q25", "q75")])
        on = F.col("measure") == F.col("_measure")
        for k in keys:
            on &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(q, on).drop("_measure", *[f"_{k}" for k in keys])

    def pick(c: str) -> Column:
        return (F.when(F.col("g_n") >= min_docs, F.col(f"g_{c}"))
                .when(F.col("l_n") >= min_docs, F.col(f"l_{c}")).otherwise(F.col(f"c_{c}")))

    least = F.create_map(*[F.lit(x) for kv in LEAST_SPREAD.items() for x in kv])
    width = SPREADS * F.greatest(F.col("q75") - F.col("q25"), least[F.col("measure")])
    rows = (out.select("lang", "source", "measure", pick("q25").alias("q25"), pick("q75").alias("q75"))
            .select("lang", "source", "measure", (F.col("q25") - width).alias("lo"), (F.col("q75") + width).alias("hi")))
    return rows.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{e}_{m}")
          for m in LEAST_SPREAD for e in ("lo", "hi")])


def judged(feats: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``feats`` plus base_failed, kept and reason; ``feats`` is read twice, so pass a stored table."""
    own = feats.columns
    limits = fences(sketch(feats), min_docs)
    lim = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                        *[c for c in limits.columns if c not in ("lang", "source")])
    j = feats.join(lim, F.col("lang").eqNullSafe(F.col("_lang"))
                   & F.col("source").eqNullSafe(F.col("_source")), "left")
    reason = F.when(base_failed(), "base")
    for m, v in measures().items():
        reason = reason.when((v < F.col(f"lo_{m}")) | (v > F.col(f"hi_{m}")), m)
    return (j.withColumn("reason", reason).withColumn("base_failed", base_failed())
            .withColumn("kept", F.col("reason").isNull())
            .select(*own, "base_failed", "kept", "reason"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2: every document with its base features and verdict."""
    docs = read(spark, sf_dir, "documents")
    feats = cut_lineage(with_features(docs, keep=["doc_id", "lang", "source"]), "op2-features")
    return judged(feats).select("doc_id", *FEATURES, "base_failed", "kept", "reason", "lang", "source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that pass, with their own columns.

    The features are computed twice, once for the sketches and once beside the text, so the text
    meets the small table of fences only and is not shuffled for its verdict.
    """
    keep = ["lang", "source"]
    feats = cut_lineage(with_features(docs, keep=keep), "quality-features")
    limits = cut_lineage(fences(sketch(feats)), "quality-fences")
    full = with_features(docs, keep=docs.columns)
    lim = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"),
                        *[c for c in limits.columns if c not in ("lang", "source")])
    j = full.join(lim, F.col("lang").eqNullSafe(F.col("_lang"))
                  & F.col("source").eqNullSafe(F.col("_source")), "left")
    bad = base_failed()
    for m, v in measures().items():
        bad |= F.coalesce((v < F.col(f"lo_{m}")) | (v > F.col(f"hi_{m}")), F.lit(False))
    return j.where(~bad).select(*docs.columns)


def _level_sql(name: str, keys: tuple[str, ...]) -> str:
    by = "".join(f"{k}, " for k in keys)
    return f"""{name} AS (SELECT {by}measure, max(total) AS n, min(edge) FILTER (upto >= 0.25 * total) AS q25,
       min(edge) FILTER (upto >= 0.75 * total) AS q75 FROM (
  SELECT *, CASE WHEN bucket = 0 THEN 0.0 ELSE pow({GAMMA}::DOUBLE, bucket - 1) END AS edge,
         sum(m) OVER (PARTITION BY {by}measure ORDER BY bucket) AS upto, sum(m) OVER (PARTITION BY {by}measure) AS total
  FROM (SELECT {by}measure, bucket, sum(n) AS m FROM sk GROUP BY {by}measure, bucket)) GROUP BY {by}measure)"""


def _verdict_sql() -> str:
    arms = " ".join(f"WHEN {m} < lo_{m} OR {m} > hi_{m} THEN '{m}'" for m in LEAST_SPREAD)
    return f"CASE WHEN base_failed THEN 'base' {arms} END"


_MEASURE_SQL = {"word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
                "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
                "echoes": ("n_echoes", "n_words")}

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
win AS (SELECT rid, i, w, lag(w) OVER p AS prev, CASE WHEN lead(i, 7) OVER p IS NOT NULL THEN list(w) OVER (
      PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) END AS g
      FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
hit AS (SELECT *, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY rid, g) > 1 THEN 1 ELSE 0 END AS h FROM win),
cov AS (SELECT *, max(h) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS r FROM hit),
wa AS (SELECT rid, count(*) AS n_words, sum(length(w)) AS word_chars, sum(r) AS n_repeat_words,
       count(*) FILTER (w = prev) AS n_echoes FROM cov GROUP BY rid),
la AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
       FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      coalesce(n_echoes, 0)::BIGINT AS n_echoes FROM d LEFT JOIN wa USING (rid) LEFT JOIN la USING (rid)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed, {", ".join(
    f"CASE WHEN {b} > 0 THEN 1000 * {a} // {b} ELSE 0 END AS {k}" for k, (a, b) in _MEASURE_SQL.items())} FROM f),
u AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {k} AS v FROM m WHERE n_words >= {MIN_WORDS}" for k in LEAST_SPREAD)}),
sk AS (SELECT lang, source, measure, CASE WHEN v <= 0 THEN 0 ELSE ceil(ln(v) / ln({GAMMA}::DOUBLE)) + 1 END AS bucket,
       count(*) AS n FROM u GROUP BY ALL),
{_level_sql("g", ("lang", "source"))},
{_level_sql("l", ("lang",))},
{_level_sql("c", ())},
q AS (SELECT g.lang, g.source, g.measure,
      CASE WHEN g.n >= {MIN_DOCS} THEN g.q25 WHEN l.n >= {MIN_DOCS} THEN l.q25 ELSE c.q25 END AS q25,
      CASE WHEN g.n >= {MIN_DOCS} THEN g.q75 WHEN l.n >= {MIN_DOCS} THEN l.q75 ELSE c.q75 END AS q75
      FROM g JOIN l ON l.lang IS NOT DISTINCT FROM g.lang AND l.measure = g.measure JOIN c ON c.measure = g.measure),
fe AS (SELECT lang, source, {", ".join(
    f"max(q25 - {SPREADS} * greatest(q75 - q25, {w})) FILTER (measure = '{k}') AS lo_{k}, "
    f"max(q75 + {SPREADS} * greatest(q75 - q25, {w})) FILTER (measure = '{k}') AS hi_{k}" for k, w in LEAST_SPREAD.items())}
    FROM q GROUP BY lang, source),
v AS (SELECT m.*, {_verdict_sql()} AS reason FROM m LEFT JOIN fe
      ON fe.lang IS NOT DISTINCT FROM m.lang AND fe.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, {", ".join(FEATURES)}, base_failed, reason IS NULL AS kept, reason, lang, source FROM v
"""
