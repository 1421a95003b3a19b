"""Dataset auditing and holdout splitting, declared as configuration and run by Spark."""

__version__ = "0.1.0"

from tidemark.operators.audit import audit
from tidemark.operators.split import SplitResult, split
from tidemark.plans.config import AuditConfig, SplitConfig
from tidemark.plans.findings import AuditReport, Finding

__all__ = ["AuditConfig", "AuditReport", "Finding", "SplitConfig", "SplitResult", "audit", "split"]
