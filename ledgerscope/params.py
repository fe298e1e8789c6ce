"""Tunable thresholds as one frozen value object.

Fixed values that must equal the reference application's defaults:
  structuring threshold 10000.0, lower bound 9000.0, minimum count 5, window 5 days;
  risk bands: Low <= 30, Medium <= 70, High <= 90, else Critical;
  anomaly score threshold 0.6, contamination 0.05; default look-back 90 days;
  large single amount 50000.0; aggregation score min(95, 40 + 4 * count).
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    structuring_threshold: float = 10000.0
    structuring_lower_bound: float = 9000.0
    structuring_min_count: int = 5
    structuring_window_days: int = 5
    risk_low_max: float = 30.0
    risk_medium_max: float = 70.0
    risk_high_max: float = 90.0
    ml_score_threshold: float = 0.6
    ml_contamination: float = 0.05
    # Below this many customers a model hit is marked as not enough_customers (it stays in the result).
    ml_min_customers: int = 5
    default_lookback_days: int = 90
    large_amount: float = 50000.0
    rolling_short_days: int = 7
    rolling_long_days: int = 30
    velocity_missing_hours: float = 9999.0
    zscore_epsilon: float = 1e-6
    forest_trees: int = 100
    forest_sample: int = 256
    forest_seed: int = 42
    layering_score: float = 85.0
    # Length of the time slices that split one key's rows over many tasks for
    # rolling windows (None: the window length itself, i.e. one context copy per row; one day with "prefix").
    time_slice_days: float | None = None
    # "slices": overlapping time slices (one exchange, one context copy per row);
    # "prefix": prefix differences over fine slices (narrow points, a join back; for keys with very many rows
    # inside one frame length). The caller chooses; both give the same values, whatever the size of the input.
    rolling_strategy: str = "slices"

    def replace(self, **kw) -> "Params":
        return dataclasses.replace(self, **kw)


DEFAULT_PARAMS = Params()

# Risk patterns that force at least a Medium level (fixed values).
FORCED_MEDIUM_PATTERNS = ("structuring", "smurfing", "layering")
