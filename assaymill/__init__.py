"""Prediction audits, record reconciliation and event intake as Spark jobs."""

from assaymill.config import AuditConfig, DEFAULTS

__all__ = ["AuditConfig", "DEFAULTS"]
