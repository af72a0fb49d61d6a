"""Errors raised while a plan is built or when a result is published."""

from __future__ import annotations


class CovsparkError(Exception):
    """Base of every error raised here."""


class DatasetNotFoundError(CovsparkError, LookupError):
    pass


class DatasetNotReadyError(CovsparkError):
    pass


class QueryError(CovsparkError, ValueError):
    pass


class UnsupportedCoverageError(CovsparkError):
    pass


class ContractError(CovsparkError, ValueError):
    """Rows break the declared contract of a dataset."""

    def __init__(self, message: str, sample: list | None = None):
        super().__init__(message if not sample else f"{message}; first rows: {sample}")
        self.sample = sample or []


class CoverageError(CovsparkError):
    """A query asked for dates that are not covered.

    ``gaps`` is the DataFrame of all of them (key, gap_start, gap_end); ``missing`` and the
    message name the first few.
    """

    def __init__(self, dataset: str, missing: dict[str, list[tuple]], total: int, gaps=None):
        self.dataset = dataset
        self.missing = missing
        self.total = total
        self.gaps = gaps
        named = [f"{key}[{start}:{end})" for key, spans in missing.items() for start, end in spans]
        more = f" and {total - len(named)} more" if total > len(named) else ""
        super().__init__(f"{dataset}: {total} missing interval(s): {', '.join(named)}{more}")


class PublishConflictError(CovsparkError):
    """Another writer published since the base revision was read."""


class OperandError(CovsparkError, ValueError):
    pass
