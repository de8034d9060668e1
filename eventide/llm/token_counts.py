"""Token counts by way of a digest cache (operator 13).

A cache table holds ``(tokenizer, digest, n_tokens)``: the digest of a tokenizer version (file,
library and its version, mode) and of a normalised content. Content is normalised as far as no count
can depend on it: null reads as the empty text, and nothing else changes.

1. Digests of all rows, distinct, are joined to the stored counts of this tokenizer version; what is
   left are the misses, a stored table.
2. One text per missing digest is encoded: copies fold in the map tasks before the shuffle. Few
   misses (``FEW``, counted) are broadcast, so that only their texts move; otherwise all distinct
   texts meet the misses by digest.
3. The new counts are appended to the cache, and every row joins its count by digest.

Appending is one Spark write: a job that fails leaves nothing, one that is repeated finds its counts
stored. Two jobs that append the same digest at a time store it twice, with the same count; readers
take one. A digest shared by a third of all rows is one row of the cache; the join back moves ids and
digests only, and Spark splits a hot digest (skew join).

Long texts: where the file allows it (``vocabulary_files``) a text's count is the sum over its
segments, and a task keeps the counts of up to ``KNOWN`` short segments; other tokenizers take each
text whole. Null and
empty texts have 0 bytes and what the library gives the empty text. Rows and ids may repeat, each is
counted; the input's columns come back, those named like a result replaced. An empty table gives no
rows and appends none.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import read
from eventide.llm.vocabulary_files import TokenizerFile
from eventide.session import checkpoint_dir, cut_lineage
from eventide.sinks.tables import path_exists

CACHE = "tokenizer string, digest binary, n_tokens long"
LIMIT = 1024
#: misses up to so many rows (32 bytes each) are broadcast
FEW = 1 << 16
#: characters of texts read, and of new distinct segments encoded, at once
BATCH_CHARS = 500_000
SLICE_CHARS = 50_000
#: counts of short segments that a task keeps; beyond, it starts anew
KNOWN, SHORT = 300_000, 64


def content(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(content(text), 256))


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version, one row per digest."""
    if not path_exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    table = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return table.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def encoded(texts: DataFrame, file: TokenizerFile) -> DataFrame:
    """(digest, n_tokens) of rows (digest, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = shared.value.open()

        known: dict[str, int] = {}

        def counts(held: list[str]) -> np.ndarray:
            if len(known) > KNOWN:
                known.clear()
            parts = [tool.parts(t) for t in held]
            new = list({s for p in parts for s in p if s not in known})
            own, i = {}, 0
            while i < len(new):
                j, size = i, 0
                while j < len(new) and (j == i or size + len(new[j]) <= SLICE_CHARS):
                    size += len(new[j])
                    j += 1
                for s, n in zip(new[i:j], tool.counts(new[i:j]).tolist()):
                    (known if len(s) <= SHORT else own)[s] = n
                i = j
            return np.array([sum(known[s] if s in known else own[s] for s in p) for p in parts], np.int64)

        for b in batches:
            held, chars, a = [], 0, 0
            for r, t in enumerate(b.column(1)):
                held.append(t.as_py())
                chars += len(held[-1])
                if chars >= BATCH_CHARS or r == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(a, len(held)), pa.array(counts(held), pa.int64())],
                        names=["digest", "n_tokens"])
                    held, chars, a = [], 0, r + 1

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def add_misses(docs: DataFrame, file: TokenizerFile, cache: str) -> int:
    """Steps 1 to 3 up to the append; returns how many contents were encoded."""
    spark = docs.sparkSession
    known = stored(spark, cache, file.digest).select("digest")
    missing = cut_lineage(docs.select(digest().alias("digest")).distinct().join(known, "digest", "left_anti"),
                          "count-misses")
    n = missing.count()
    if n == 0:
        return 0
    texts = docs.select(digest().alias("digest"), content().alias("text"))
    if n <= FEW:
        texts = texts.join(F.broadcast(missing), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
    else:
        texts = texts.groupBy("digest").agg(F.first("text").alias("text")).join(missing, "digest", "left_semi")
    new = encoded(texts, file).select(F.lit(file.digest).alias("tokenizer"), "digest", "n_tokens")
    new.write.mode("append").partitionBy("tokenizer").parquet(cache)
    return n


def counted(docs: DataFrame, file: TokenizerFile, cache: str, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` without ``text``, with n_bytes, n_tokens, over_limit. Fills the cache."""
    add_misses(docs, file, cache)
    keep = [c for c in docs.columns if c not in ("text", "n_bytes", "n_tokens", "over_limit")]
    rows = docs.select(F.struct(*keep).alias("row"), digest().alias("digest"),
                       F.octet_length(content()).cast("long").alias("n_bytes"))
    out = rows.join(stored(docs.sparkSession, cache, file.digest), "digest")
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))


def token_counts(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """Query op13: every document's tokens. Without a cache named, a new one is filled."""
    import public_tokenizers

    cache = cache or os.path.join(checkpoint_dir(spark), f"token-counts-{uuid.uuid4().hex}")
    file = TokenizerFile.read(public_tokenizers.path("byte_bpe_50k.json"))
    return counted(read(spark, sf_dir, "documents").select("doc_id", "text"), file, cache)
