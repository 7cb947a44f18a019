"""Sampling schedules and trading sessions."""

from __future__ import annotations

import hashlib
import random
from datetime import date, datetime, time
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
#: Session, last time of entry, and days that are left out.
OPEN, CLOSE, LAST_ENTRY, EARLY_CLOSE = time(10), time(16), time(15, 30), time(13)
SKIPPED = (date(2025, 11, 28), date(2025, 12, 24))


def nanoseconds(day: date, at: time) -> int:
    return int(datetime.combine(day, at, ZoneInfo(NEW_YORK)).timestamp()) * 1_000_000_000


def entry_times(day: date, samples: int, seed: int = 4718) -> list[int]:
    """Entry times of a day: half the samples, rounded up, uniform in the session, the same for every number of workers."""
    if day in SKIPPED:
        return []
    start, end, n = nanoseconds(day, OPEN), nanoseconds(day, LAST_ENTRY), max(1, (samples + 1) // 2)
    text = f"{seed}|{day.isoformat()}|{start}|{end}|{samples}"
    draw = random.Random(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))
    return sorted(int(draw.uniform(start, end)) for _ in range(n))


def local_day(ts_ns: Column) -> Column:
    """The exchange's day of a time in nanoseconds since the epoch (UTC)."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.floor(ts_ns / 1000)), NEW_YORK))


def in_session(ts_ns: Column) -> Column:
    """Whether a time in nanoseconds since the epoch (UTC) is within the session."""
    local = F.from_utc_timestamp(F.timestamp_micros(F.floor(ts_ns / 1000)), NEW_YORK)
    minute = F.hour(local) * 60 + F.minute(local)
    open_at, close_at = OPEN.hour * 60, CLOSE.hour * 60
    skipped = F.to_date(local).isin(*SKIPPED)
    return (minute >= open_at) & (minute < close_at) & ~skipped


def session_end(day: date) -> int:
    """When a day's regular session ends, in nanoseconds: earlier on the days before holidays."""
    return nanoseconds(day, EARLY_CLOSE if day in SKIPPED else CLOSE)


def next_session_end(ts_ns: Column) -> Column:
    """The end of the session that a time (UTC nanoseconds) is in or before; after it, the same clock time a day later."""
    moment = F.timestamp_micros(F.floor(ts_ns / 1000))
    day = F.to_date(F.from_utc_timestamp(moment, NEW_YORK))

    def at(of: Column) -> Column:
        hour = F.when(day.isin(*SKIPPED), EARLY_CLOSE.hour).otherwise(CLOSE.hour)
        local = F.date_add(of, 0).cast("timestamp") + F.make_dt_interval(F.lit(0), hour)
        return F.unix_micros(F.to_utc_timestamp(local, NEW_YORK)) * 1000

    end = at(day)
    return F.when(end > ts_ns, end).otherwise(at(F.date_add(day, 1)))


def in_chunk_times(times: list[int], start: int | None, end: int | None) -> list[int]:
    """The times of a schedule that are in a half-open chunk."""
    return [t for t in times if (start is None or t >= start) and (end is None or t < end)]
