"""Defaults that carry meaning (all overridable by parameters)."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the reference's for matching results:
# label bucket edges in days, label horizon in days, history length, prediction extract
# rows per person, train share, CDF tail in days, tracker poll / idle / abort seconds.
BUCKET_EDGES_DAYS = (1, 3, 7, 14, 28)
HORIZON_DAYS = 28
HISTORY_SIZE = 64
PREDICT_EXTRACT_ROWS = 32
SPLIT_RATIO = 0.8
CDF_TAIL_DAYS = 1000
TRACKER_POLL_S = 5
TRACKER_IDLE_S = 60
TRACKER_ABORT_S = 120
EXTRACT_CHUNK_ROWS = 1_000_000
TASK_TYPES = ("churn", "propensity_to_buy")
SUPPORTED_TASK_TYPE = "churn"

DAY_US = 86_400 * 1_000_000
SECOND_US = 1_000_000


@dataclass(frozen=True)
class Defaults:
    bucket_edges_days: tuple[int, ...] = BUCKET_EDGES_DAYS
    horizon_days: int = HORIZON_DAYS
    history_size: int = HISTORY_SIZE
    predict_extract_rows: int = PREDICT_EXTRACT_ROWS
    split_ratio: float = SPLIT_RATIO
    cdf_tail_days: int = CDF_TAIL_DAYS
    seed: int = 42
    sample_buckets: int = 16
    time_chunk_days: float = 1.0
    task_types: tuple[str, ...] = field(default=TASK_TYPES)

    @property
    def n_classes(self) -> int:
        return len(self.bucket_edges_days) + 1
