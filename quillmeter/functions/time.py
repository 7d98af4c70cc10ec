"""Ranges, bucket widths and bucket centres."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta, tzinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths in seconds that buckets snap to, and those that bars of the timeline snap to. Fixed values.
WIDTHS = (60, 300, 900, 1800, 3600, 21600, 43200, 86400)
BAR_WIDTHS = (60, 120, 300, 600, 900, 1800, 3600, 7200, 14400, 21600, 43200, 86400, 604800, 2592000)
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_UNIT = {"h": 1, "d": 24, "w": 168, "m": 720}
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def span_of(text: str, now: datetime) -> timedelta:
    """Nd, Nh or all (since the epoch); anything else is a ValueError."""
    if text == "all":
        return now - EPOCH
    if not (m := re.fullmatch(r"(\d+)([dh])", text)):
        raise ValueError(f"bad range: {text!r}")
    return timedelta(hours=int(m[1]) * _UNIT[m[2]])


def adaptive_width(span: timedelta) -> int:
    """The widest bucket that still gives a hundred of them, the narrowest if none does."""
    seconds = max(1, int(span.total_seconds()))
    return max([w for w in WIDTHS if seconds >= 100 * w], default=WIDTHS[0])


def bar_width(span: timedelta, bars: int = 120) -> int:
    """The narrowest bar that needs at most so many of them."""
    least = max(60, span.total_seconds() / bars)
    return next((w for w in BAR_WIDTHS if w >= least), BAR_WIDTHS[-1])


def period(text: str) -> timedelta:
    """N with h, d, w or m (30 days)."""
    if not (m := re.fullmatch(r"\s*(\d+)\s*([hdwm])\s*", text.lower())):
        raise ValueError(f"bad period: {text!r}")
    return timedelta(hours=int(m[1]) * _UNIT[m[2]])


def moment(text: str, zone: tzinfo = UTC) -> datetime:
    """YYYY-MM-DD or YYYY-MM-DD HH:MM in a zone."""
    if not re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}( \d{1,2}:\d{2})?", text.strip()):
        raise ValueError(f"bad date: {text!r}")
    day, _, clock = text.strip().partition(" ")
    hour, minute = map(int, clock.split(":")) if clock else (0, 0)
    return datetime(*map(int, day.split("-")), hour, minute, tzinfo=zone)


def date_range(start: str | None, end: str | None, length: str | None, now: datetime, everything: bool = False, zone: tzinfo = UTC) -> tuple[datetime | None, datetime | None, str]:
    """(from, to, label) of two of start, end and length; alone, a start runs to now and a length ends now; without any, the
    last 24 hours or everything."""
    given = bool(start), bool(end), bool(length)
    if given == (True, True, True):
        raise ValueError("give two of start, end and period at most")
    if given == (False, True, False):
        raise ValueError("an end needs a start or a period")
    if start:
        a = moment(start, zone)
        if end:
            return a, moment(end, zone), f"{start}_to_{end}"
        return (a, a + period(length), f"{start}+{length}") if length else (a, now, f"{start}_to_now")
    if end:
        b = moment(end, zone)
        return b - period(length), b, f"{length}_to_{end}"
    if length:
        return now - period(length), now, length
    return (None, None, "all") if everything else (now - timedelta(hours=24), now, "24h")


def bucket_index(ts: Column, width: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(width * 1_000_000))


def bucket_center(ts: Column, width: int) -> Column:
    """The middle of the bucket that a time falls in; buckets are aligned to the epoch."""
    return F.timestamp_micros((bucket_index(ts, width) * F.lit(width * 1_000_000) + F.lit(width * 500_000)).cast("long"))


def instant(text: Column) -> Column:
    """A timestamp of an ISO text, null for other shapes and impossible dates."""
    return F.when(text.rlike(_ISO), F.try_to_timestamp(F.regexp_replace(text, ",", ".")))


def truncated_since(since: datetime, bucket_s: int) -> datetime:
    """Rolled-up hours are kept from the hour that a range begins in."""
    return since.replace(minute=0, second=0, microsecond=0) if bucket_s >= 3600 else since
