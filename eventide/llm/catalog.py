"""Registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventide.llm.bpe_codec import bpe_codec
from eventide.llm.conversation_repair import conversation_repair
from eventide.llm.exact_dedup import EXACT_SQL, exact_dedup
from eventide.llm.host_reputation import REPUTATION_SQL, host_reputation
from eventide.llm.language_id import language_id
from eventide.llm.minhash_dedup import minhash_dedup
from eventide.llm.packing import packing
from eventide.llm.pseudo_likelihood import pseudo_likelihood
from eventide.llm.quality_rules import QUALITY_SQL, quality_rules
from eventide.llm.quotation_linking import QUOTATION_SQL, quotation_linking
from eventide.llm.source_mix import MIX_SQL, source_mix
from eventide.llm.token_alignment import token_alignment
from eventide.llm.token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": minhash_dedup,
    "op2_quality_rules": quality_rules,
    "op3_quotation_linking": quotation_linking,
    "op4_exact_dedup": exact_dedup,
    "op5_source_mix": source_mix,
    "op6_pseudo_likelihood": pseudo_likelihood,
    "op7_host_reputation": host_reputation,
    "op8_packing": packing,
    "op9_language_id": language_id,
    "op10_bpe_codec": bpe_codec,
    "op11_token_alignment": token_alignment,
    "op12_conversation_repair": conversation_repair,
    "op13_token_counts": token_counts,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": QUALITY_SQL,
    "op3_quotation_linking": QUOTATION_SQL,
    "op4_exact_dedup": EXACT_SQL,
    "op5_source_mix": MIX_SQL,
    "op7_host_reputation": REPUTATION_SQL,
}
