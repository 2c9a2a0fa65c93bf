"""Rule parameters.

A rule takes a plain dict of parameters; ``rule_config`` returns the defaults
with the caller's overrides merged in, one level deep.
"""

from __future__ import annotations

from copy import deepcopy
from typing import Any

# Thresholds and weights that decide which rows are flagged and
# what a flag costs.
RULE_DEFAULTS: dict[str, dict[str, Any]] = {
    "completeness": {"enabled": True, "penalty_weight": 4, "null_pct_threshold": 20.0, "period_max_distinct": 60},
    "duplicate": {"enabled": True, "penalty_weight": 3},
    "validity": {
        "enabled": True,
        "penalty_weight": 10,
        "nonnegative_ratio_threshold": 0.90,
        "min_sample_size_for_ratio": 5,
    },
    "outlier": {
        "enabled": True,
        "penalty_weight": 6,
        "method": "zscore",
        "group_by": None,
        "min_group_size": 3,
        "iqr_multiplier": 1.5,
        "zscore_threshold": 3.5,
    },
    "consistency": {
        "enabled": True,
        "penalty_weight": 5,
        "fuzzy_match_threshold": 60,
        "max_unique_ratio": 0.5,
        "min_value_count": 2,
        "max_common_candidates": None,  # a number leaves rarer candidates out
        "min_sample_size_for_ratio_filter": 10,
    },
    "schema_drift": {"enabled": True, "penalty_weight": 15},
}
DEFAULT_PENALTY_WEIGHT = 5
STARTING_SCORE = 100
ALERT_SCORE_THRESHOLD = 70
ALERT_ISSUE_LIMIT = 10
RUN_LIST_LIMIT = 200
PREVIEW_LIMIT = 50
NUMERIC_COERCION_RATIO = 0.9
PERIOD_MAX_DISTINCT = 60
ENTITY_MIN_DISTINCT = 10

# Figures by group are broadcast up to this many, results are the same beyond.
BROADCAST_MAX_ROWS = 200_000


def rule_config(overrides: dict[str, dict[str, Any]] | None = None) -> dict[str, dict[str, Any]]:
    """The default parameters with ``overrides`` merged in per rule."""
    merged = deepcopy(RULE_DEFAULTS)
    for rule, params in (overrides or {}).items():
        merged.setdefault(rule, {}).update(params)
    return merged
