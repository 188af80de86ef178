"""Refresh cadences and column names that speak of time."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

_CADENCE = re.compile(r"P(?!$)(?:(\d+)W)?(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?")
TIME_WORDS = frozenset("date time year month day hour datetime timestamp ym ymd dt yyyymm".split())


def parse_cadence(text: str) -> timedelta:
    """An ISO 8601 duration of weeks, days and a time; months and years have no length and are refused."""
    m = _CADENCE.fullmatch(text.strip())
    if not m or not any(m.groups()):
        raise ValueError(f"not a cadence: {text!r}")
    weeks, days, hours, minutes, seconds = (int(g or 0) for g in m.groups())
    found = timedelta(weeks=weeks, days=days, hours=hours, minutes=minutes, seconds=seconds)
    if not found:
        raise ValueError("a cadence is longer than nothing")
    return found


def is_stale(cadence: str | None, last_success: datetime | None, now: datetime) -> bool | None:
    """Whether the last success is longer ago than the cadence; None if either is unknown."""
    return None if cadence is None or last_success is None else now - last_success > parse_cadence(cadence)


def speaks_of_time(column: str) -> bool:
    """Whether a word of the name (split at case changes, digits and signs) is one of time."""
    words = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", column)
    return any(w.lower() in TIME_WORDS for w in words)
