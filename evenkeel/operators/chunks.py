"""Date chunks: closed windows of so many days."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def _day(value) -> date:
    return value if type(value) is date else date.fromisoformat(str(value)[:10])


def date_chunks(start, end, days: int | None) -> list[tuple[str, str]]:
    """Closed (first, last) days that cover start to end; the last window is clipped.  None: one window."""
    if days is None:
        return [(str(start), str(end))]
    if days <= 0:
        raise ValueError("chunk_size_days must be positive")
    a, b = _day(start), _day(end)
    if a > b:
        raise ValueError("the start date is after the end date")
    return [(x.isoformat(), min(x + timedelta(days - 1), b).isoformat()) for x in (a + timedelta(k) for k in range(0, (b - a).days + 1, days))]


def chunk_id(day: Column, start, days: int) -> Column:
    """Number of the window that a date falls in: all chunks are told apart in one job."""
    return F.floor(F.datediff(day, F.lit(_day(start).isoformat()).cast("date")) / days).cast("int")


def param_chunks(params: dict | None, days: int | None) -> list[dict]:
    """Parameter sets with start_date and end_date cut into windows; params as they are where they lack either."""
    params = dict(params or {})
    if not days or params.get("start_date") is None or params.get("end_date") is None:
        return [params]
    return [params | {"start_date": a, "end_date": b} for a, b in date_chunks(params["start_date"], params["end_date"], days)]


def paired_chunks(source: dict | None, target: dict | None, days: int | None) -> list[tuple[dict, dict]]:
    """Windows of both sides side by side; only if both have both dates.  Unequal numbers raise ValueError."""
    both = all((p or {}).get(k) is not None for p in (source, target) for k in ("start_date", "end_date"))
    if not days or not both:
        return [(dict(source or {}), dict(target or {}))]
    a, b = param_chunks(source, days), param_chunks(target, days)
    if len(a) != len(b):
        raise ValueError("the date ranges of source and target give different numbers of chunks")
    return list(zip(a, b, strict=True))
