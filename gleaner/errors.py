"""Kinds of failure, and how several attempts are judged together."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import TypeVar

T = TypeVar("T")


class EngineError(Exception):
    """Every failure of the engine's own; ``trace`` are the actions that led to it."""

    def __init__(self, message: str, trace: list[dict] | None = None) -> None:
        super().__init__(message)
        self.trace = trace or []

    def __str__(self) -> str:
        steps = [f"{a['op']} {a.get('uri') or ''}".strip() for a in self.trace]
        return super().__str__() + ("" if not steps else "; after: " + " > ".join(steps))


class ActionFailed(EngineError):
    """An action of a trace."""


class FetchFailed(EngineError):
    """All attempts at a trace."""


class DumpFailed(EngineError):
    """An error page or audit row could not be kept."""


class ReadFailed(EngineError):
    """A file system, reading."""


class WriteFailed(EngineError):
    """A file system, writing."""


class SessionFailed(EngineError):
    """A browser or interpreter that a trace needs."""


def _attempts(runs: Iterable[Callable[[], T]]) -> tuple[list[T], list[Exception]]:
    good: list[T] = []
    bad: list[Exception] = []
    for run in runs:
        try:
            good.append(run())
        except Exception as e:  # judged by the caller
            bad.append(e)
    return good, bad


def all_must(message: str, runs: Iterable[Callable[[], T]]) -> list[T]:
    """Every result, or all failures in one group."""
    good, bad = _attempts(runs)
    if bad:
        raise ExceptionGroup(message, bad)
    return good


def one_must(message: str, runs: Iterable[Callable[[], T]]) -> list[T]:
    """What succeeded; a group of all failures if nothing did."""
    good, bad = _attempts(runs)
    if not good:
        raise ExceptionGroup(message, bad or [ValueError("nothing to try")])
    return good


def first_success(message: str, runs: Iterable[Callable[[], T]]) -> T:
    """The first success; what comes after it is not tried."""
    bad: list[Exception] = []
    for run in runs:
        try:
            return run()
        except Exception as e:  # told if all fail
            bad.append(e)
    raise ExceptionGroup(message, bad or [ValueError("nothing to try")])


def as_lines(error: BaseException, level: int = 0) -> list[str]:
    """A tree of failures as indented lines."""
    out = ["  " * level + f"{type(error).__name__}: {error.args[0] if error.args else ''}"]
    parts = error.exceptions if isinstance(error, BaseExceptionGroup) else [e for e in (error.__cause__,) if e]
    for e in parts:
        out += as_lines(e, level + 1)
    return out
