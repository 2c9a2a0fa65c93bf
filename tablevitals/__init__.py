"""Health checks for tables and file streams, as PySpark DataFrame jobs."""

from tablevitals.config import rule_config
from tablevitals.operators.batch import Batch
from tablevitals.plans.pipeline import run_all_rules, run_batch

__all__ = ["Batch", "rule_config", "run_all_rules", "run_batch"]
