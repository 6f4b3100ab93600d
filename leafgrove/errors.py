"""Errors that callers may tell apart; each says what failed, and keeps the cause."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager


class EngineError(Exception):
    """Any failure of the engine."""


class SourceError(EngineError):
    """An input can't be read or is not what it says."""


class ConflictError(EngineError):
    """A run or artifact exists with another identity."""


class NotFoundError(EngineError):
    """A run, artifact or document is not there."""


class RequestError(EngineError):
    """A request or plan is not valid."""


class ModelError(EngineError):
    """A language model failed for good."""


@contextmanager
def translated(what: str) -> Iterator[None]:
    """Other errors inside become the engine's own, with their cause."""
    try:
        yield
    except EngineError:
        raise
    except FileNotFoundError as e:
        raise NotFoundError(f"{what}: {e}") from e
    except (UnicodeError, OSError) as e:
        raise SourceError(f"{what}: {e}") from e
    except ValueError as e:
        raise (ConflictError if "another identity" in str(e) else RequestError)(f"{what}: {e}") from e
