"""Validation of the parameters a caller passes to the analytics."""

from __future__ import annotations

# The choices the analytics know.
METRICS = ("favorite_count", "retweet_count")
DIVISIONS = ("month", "biweek", "week", "day")
LEXICONS = ("bing", "afinn", "loughran", "nrc")
STOP_MODES = ("token", "substring")
TREND_METHODS = ("mean", "linear", "local")


def at_least(name: str, value: int, low: int) -> int:
    """Return ``value`` when it is an int of at least ``low``."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{name} must be an int, got {type(value).__name__}")
    if value < low:
        raise ValueError(f"{name} must be at least {low}, got {value}")
    return value


def one_of(name: str, value: str, choices: tuple[str, ...]) -> str:
    """Return ``value`` when it is one of ``choices``."""
    if value not in choices:
        raise ValueError(f"{name} must be one of {', '.join(choices)}, got {value!r}")
    return value


def percentile(name: str, value: float) -> float:
    """Return ``value`` when it lies in (0, 100]."""
    if not 0 < value <= 100:
        raise ValueError(f"{name} must be above 0 and at most 100, got {value}")
    return float(value)
