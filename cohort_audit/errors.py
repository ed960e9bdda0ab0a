"""Errors of the audit."""

from __future__ import annotations


class AuditError(Exception):
    """Base of all errors here."""


class InsufficientSampleError(AuditError):
    def __init__(self, group: str, n: int, least: int):
        self.group, self.n, self.least = group, n, least
        super().__init__(f"group {group!r} has {n} rows; at least {least} are needed")


class ConfigurationError(AuditError):
    def __init__(self, message: str, field: str | None = None):
        self.field = field
        super().__init__(message)


class DataValidationError(AuditError):
    def __init__(self, message: str, column: str | None = None):
        self.column = column
        super().__init__(message)


class MetricComputationError(AuditError):
    def __init__(self, metric: str, reason: str):
        self.metric, self.reason = metric, reason
        super().__init__(f"{metric}: {reason}")


class ColumnNotFoundError(AuditError):
    def __init__(self, column: str, available: list[str]):
        self.column, self.available = column, available
        super().__init__(f"column {column!r} not found; there are {', '.join(available)}")


class ReferenceGroupError(AuditError):
    def __init__(self, reference: str, available: list[str]):
        self.reference, self.available = reference, available
        super().__init__(f"reference group {reference!r} not found; there are {', '.join(map(str, available))}")


class BootstrapError(AuditError):
    def __init__(self, metric: str, n_failed: int, n_total: int):
        self.metric, self.n_failed, self.n_total = metric, n_failed, n_total
        super().__init__(f"{metric}: {n_failed} of {n_total} replicates failed")
