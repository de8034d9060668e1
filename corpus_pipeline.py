"""The corpus pipeline: quality rules, exact dedup, near dedup, source mix, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from eventide.llm import bpe_codec, exact_dedup, minhash_dedup, quality_rules, source_mix
from eventide.session import checkpoint_dir

STAGES = [
    ("quality rules", quality_rules.stage),
    ("exact dedup", exact_dedup.stage),
    ("near dedup", minhash_dedup.stage),
    ("source mix", source_mix.stage),
    ("bpe encoding", bpe_codec.stage),
]

#: the pair checks of the near-duplicate stage and the merges of BPE have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each stored in the shared folder before the next."""
    base = os.path.join(checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
    return docs
