"""Site auditing as Spark jobs: fetch records in, page facts, issues, scores and reports out."""

from crawlsight.config import AuditOptions, Scoring

__all__ = ["AuditOptions", "Scoring"]
