"""Calendar helpers for month windows."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DAYS_PER_MONTH


def _parse(d: str) -> dt.date:
    return dt.date.fromisoformat(d)


def months_between(end: str, start: str) -> float:
    """Length of a period in average months."""
    return (_parse(end) - _parse(start)).days / DAYS_PER_MONTH


def month_count(start: str, end: str, inclusive_tail: bool = True) -> int:
    """Number of month windows: 0..round(difference) inclusive (reference default)."""
    n = int(math.floor(months_between(end, start) + 0.5))
    return n + 1 if inclusive_tail else max(n, 0)


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970-01-01 UTC of a timestamp without zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def half_open(ts: Column, start: str, end: str) -> Column:
    """start <= ts < end (the platform's filterDate)."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def month_offset(ts: Column, start: str) -> Column:
    """k with add_months(start,k) <= ts < add_months(start,k+1), computed per row.

    Exact closed form, so month windows need no range join: the calendar difference
    k0 is either right or one too high (when ts falls before start's day-of-month).
    """
    s = F.lit(start).cast("date")
    k0 = (F.year(ts) - F.year(s)) * 12 + (F.month(ts) - F.month(s))
    return k0 - F.when(ts < F.add_months(s, k0).cast("timestamp_ntz"), 1).otherwise(0)


def month_start(start: str, k: Column) -> Column:
    return F.add_months(F.lit(start).cast("date"), k)


def compact_date(d: str) -> str:
    """'2024-01-01' -> '20240101' (export naming)."""
    return d.replace("-", "")
