"""Errors of the library; all derive from AnalyticsError."""

from __future__ import annotations


class AnalyticsError(Exception):
    """Base of all errors raised on purpose."""


class UnsupportedFileType(AnalyticsError):
    def __init__(self, path, supported):
        super().__init__(f"{path}: no reader for this suffix; known are {', '.join(supported)}")
        self.path, self.supported = str(path), list(supported)


class NoTrendData(AnalyticsError):
    def __init__(self, candidates=()):
        super().__init__("a trend needs a date column with two distinct dates and a numeric column; dates tried: " + (", ".join(candidates) or "none"))
        self.candidates = list(candidates)


class NoCustomerIdentifier(AnalyticsError):
    def __init__(self):
        super().__init__("no column identifies customers")


class EmptyDataset(AnalyticsError):
    def __init__(self):
        super().__init__("the dataset has no rows")


class UpdateMatchedNothing(AnalyticsError):
    def __init__(self, where):
        super().__init__(f"update: no row matches {where}")


class DeleteMatchedNothing(AnalyticsError):
    def __init__(self, where):
        super().__init__(f"delete: no row matches {where}")


class DestructiveStatement(AnalyticsError):
    def __init__(self, kind):
        super().__init__(f"refused: {kind} is not a query")
        self.kind = kind


class NoBackup(AnalyticsError):
    def __init__(self):
        super().__init__("there is no earlier state to go back to")
