"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 9).

Counts of hashed 1- to 3-grams per language are added up over all learning documents: each task
adds its own batches first, so a shuffle carries one bucket vector per task and language. The
log-probability matrix (``BUCKETS`` x languages, float32) is broadcast; it is bounded by
``MAX_LANGS`` languages, and more are an error rather than a silent cut. A batch is scored as a
sparse count matrix times the dense matrix.

Texts are lower-cased whole texts; digits read as one class and runs of white space as one space.
Null text, or one without a letter (Unicode category L), is ``und`` with score 0. Null lang or null
doc_id is not learned from (a null doc_id is not held out). Repeated rows count as often as they
occur. With no learning document every text is ``und``. An empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import read
from eventide.session import cut_lineage

BITS = 14
BUCKETS = 1 << BITS
ORDERS = 3
MAX_LANGS = 500
SMOOTH = 0.5
UNKNOWN = "und"
#: documents are scored together up to so many characters, longer ones in pieces of that size
PIECE = 1 << 18

_LETTER = regex.compile(r"\p{L}")
_ODD = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((c >= 48) & (c <= 57), np.uint32(48), c)
    space = (c == 32) | ((c >= 9) & (c <= 13))
    first = ~space
    first[1:] |= ~space[:-1]
    c = np.where(space, np.uint32(32), c)
    return c[first | (np.arange(len(c)) == 0)]


def _buckets(codes: np.ndarray) -> np.ndarray:
    """Bucket of each 1-, 2- and 3-gram of one text."""
    out = []
    h = np.zeros(len(codes), np.uint32)
    for n in range(ORDERS):
        h = h[:len(codes) - n] if n else h
        if len(codes) <= n:
            break
        h = (h ^ codes[n:]) * _ODD[n]
        h = h ^ (h >> np.uint32(15))
        out.append((h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _pieces(text: str) -> Iterator[str]:
    """The whole text in pieces; only the few n-grams across a cut are not counted."""
    yield from (text[i:i + PIECE] for i in range(0, len(text), PIECE))


def gram_counts(text: str) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for p in _pieces(text):
        total += np.bincount(_buckets(_codes(p)), minlength=BUCKETS)
    return total


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, counts) over ``docs(lang, text)``: one vector of BUCKETS counts per language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = text.as_py()
                if lang not in total:
                    if len(total) >= MAX_LANGS:
                        raise ValueError(f"more than {MAX_LANGS} languages to learn")
                    total[lang] = np.zeros(BUCKETS, np.int64)
                total[lang] += gram_counts(t)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()),
             pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["lang", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, total = None, None
        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(x.as_buffer(), np.int64)
                if total is not None and name == lang:
                    total = total + v
                    continue
                if total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tobytes()], pa.binary())],
                                                     names=["lang", "counts"])
                lang, total = name, v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tobytes()], pa.binary())],
                                             names=["lang", "counts"])

    schema = "lang string, counts binary"
    parts = docs.select("lang", "text").mapInArrow(run, schema)
    # two steps, so that a language of all tasks is not added up in one task alone
    salted = parts.repartition(F.col("lang"), F.pmod(F.hash("counts"), F.lit(64))).sortWithinPartitions("lang")
    return salted.mapInArrow(add, schema).repartition("lang").sortWithinPartitions("lang").mapInArrow(add, schema)


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log matrix) learned from ``docs(lang, text)``; bounded by MAX_LANGS vectors.

    All languages start equal (no prior from their share of documents): a text is judged by its
    characters alone.
    """
    learned = docs.where("lang is not null and text is not null")
    rows = cut_lineage(language_counts(learned), "lang-counts")
    if rows.count() > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    got = sorted((r["lang"], np.frombuffer(r["counts"], np.int64)) for r in rows.toLocalIterator())
    langs = [x for x, _ in got]
    counts = np.array([c for _, c in got], np.float64).reshape(len(got), BUCKETS) + SMOOTH
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], carry: list[str]) -> DataFrame:
    """``carry`` columns of ``docs`` plus lang_pred and score (the posterior of lang_pred)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(*carry).schema.add("lang_pred", "string").add("score", "double")

    def judge(texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, logs = shared.value
        pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not langs:
            return pred, score
        for i, t in enumerate(texts):
            if t is None or not _LETTER.search(t):
                continue
            n = gram_counts(t)
            at = np.flatnonzero(n)
            s = n[at].astype(np.float64) @ logs[at]
            k = int(np.argmax(s))
            pred[i], score[i] = langs[k], float(1 / np.exp(s - s[k]).sum())
        return pred, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = judge([t.as_py() for t in b.column(len(carry))])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(carry)], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=[*carry, "lang_pred", "score"])

    return docs.select(*carry, "text").mapInArrow(run, schema)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op9: the language of every document, learned from those not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    marked = docs.select("doc_id", "lang", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(marked.where("not held_out and doc_id is not null"))
    return predict(marked, model, ["doc_id", "held_out"])
