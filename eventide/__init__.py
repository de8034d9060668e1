"""eventide: event-history and churn analytics as Spark DataFrame / SQL / Streaming jobs.

Layout
------
sources/    readers: driver tables -> canonical event frame, account extract, message feeds
functions/  Column expressions: time features, day buckets, CDF / churn, token ids, message JSON
operators/  DataFrame operators: dedupe, latest-n, cutoffs, vocab, stats, split, sampling, histories
plans/      multi-operator jobs: preprocessing (test / train / validation), scoring, request routing
streaming/  Structured Streaming: validated feed, ingestion tracker, message handlers (foreachBatch)
sinks/      parquet stage tables, run layout, message publishing
"""

from eventide.config import Defaults

__all__ = ["Defaults"]
__version__ = "0.1.0"
