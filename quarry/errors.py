"""Errors of the engine; `status` is what the HTTP surface answers with."""

from __future__ import annotations

import json


class QueryError(ValueError):
    status = 400

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message)
        self.position = position


class SyntaxFailure(QueryError):
    """The text is not a statement of the dialect; `position` is the 1-based byte column."""

    @classmethod
    def at(cls, position: int, message: str, got: str | None = None) -> SyntaxFailure:
        tail = "" if got is None else f", got {json.dumps(got, ensure_ascii=False)}"
        return cls(f"parse error at column {position}: {message}{tail}", position)


class Unsupported(QueryError):
    """A feature that the dialect names only to reject."""

    @classmethod
    def word(cls, word: str) -> Unsupported:
        return cls(f"{word.upper()} not supported in v1")


class BindFailure(QueryError):
    """Names, types or grouping do not fit the table."""


class NotFound(QueryError):
    status = 404


class CatalogFailure(QueryError):
    status = 500


class TimedOut(QueryError):
    status = 504


def quoted(name: str) -> str:
    return json.dumps(name, ensure_ascii=False)
