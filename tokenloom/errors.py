"""Errors of the engine, from the text of a query to its run."""

from __future__ import annotations


class EngineError(Exception):
    """Anything that this engine raises on purpose."""


class QuerySyntaxError(EngineError):
    """The text isn't a pattern. at: the character where reading stopped."""

    def __init__(self, message: str, at: int | None = None):
        super().__init__(message if at is None else f"{message} at character {at}")
        self.at = at


class UnsupportedPattern(EngineError):
    """A well-formed pattern that has no meaning here, such as a traversal inside a repetition."""


class CompileError(EngineError):
    """A pattern that is too large to run, or holds a part that can't be compiled."""


class InvalidQuery(EngineError):
    """A search request that can't be answered: bad pattern, limit or cursor."""


class SearchTimeout(EngineError):
    """The search ran longer than it may."""


class BackendError(EngineError):
    """Spark failed while it ran a search."""


class SchemaMismatch(EngineError):
    """A table is there, but not with the columns that the engine writes."""


class InvalidDocument(EngineError):
    """An annotated document breaks the rules of the input format, and the policy is to fail."""


class ConfigError(EngineError):
    """A setting that the run needs is missing."""
