"""Instants, dates and gaps as Column expressions. Instants are epoch milliseconds; 0 means that none is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000

#: Microseconds that stand for DuckDB's ``infinity`` and ``-infinity`` in files.
INFINITE = (2**63 - 1, 1 - 2**63)


def nearest_ms(ts: Column) -> Column:
    """Epoch milliseconds nearest to a timestamp, halves away from 0, as DuckDB's ``epoch_ms`` (``unix_millis`` rounds down); null for infinities."""
    us = F.unix_micros(ts.cast("timestamp"))
    finite = F.when(~us.isin(*INFINITE), us)
    return F.unix_millis(F.timestamp_micros(finite + F.when(us < 0, 499).otherwise(500)))


def instant(ms: Column, offset_minutes: int = 0, weekday: bool = False) -> Column:
    """``YYYY-MM-DD HH:MM ZONE``, seconds cut off, in a fixed offset from UTC; null for 0 or null."""
    sign = "+" if offset_minutes >= 0 else "-"
    zone = "UTC" if not offset_minutes else f"UTC{sign}{abs(offset_minutes) // 60:02d}:{abs(offset_minutes) % 60:02d}"
    local = F.timestamp_millis(ms + offset_minutes * 60_000)
    text = F.concat(F.date_format(local, "yyyy-MM-dd HH:mm"), F.lit(f" {zone}"))
    if weekday:
        day = F.element_at(F.array(*[F.lit(d) for d in ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")]), F.dayofweek(local))
        text = F.concat(text, F.lit(" ("), day, F.lit(")"))
    return F.when(ms.isNotNull() & (ms != 0), text)


def day(ms: Column) -> Column:
    return F.when(ms.isNotNull() & (ms != 0), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"))


def strict_date(text: Column) -> Column:
    """A zero-padded ASCII date, else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def cleaned_date(text: Column) -> Column:
    """What is left of a date's text after all but digits and hyphens are gone, if that is a date."""
    left = F.regexp_replace(text, "[^0-9-]", "")
    return F.when(strict_date(left).isNotNull(), left)


def plus_days(date_text: Column, days: Column) -> Column:
    return F.date_format(F.date_add(strict_date(date_text), days), "yyyy-MM-dd")


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(strict_date(end), strict_date(start))


def gap_label(before: Column, now: Column) -> Column:
    """The gap between two instants in words; units are always plural."""
    seconds = F.floor((now - before) / 1000)
    words = (
        F.when(seconds < 0, F.lit("Messages appear to be out of order"))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" seconds (immediate response)")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" minutes (recent conversation)")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" hours (same day, but significant pause)")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit(" days (long gap, likely new conversation)")))
    )
    missing = before.isNull() | now.isNull() | (before == 0) | (now == 0)
    return F.when(missing, F.lit("No timestamp information available")).otherwise(F.concat(F.lit("Time gap: "), words))


def spacing_ms(n: Column, start: Column, following: Column) -> Column:
    """Milliseconds between a session's messages: 30 s, or as many as fit into nine tenths of the gap to the next session."""
    gap = following - start
    tight = 0.9 * gap
    return (
        F.when(n <= 1, F.lit(0.0))
        .when(following.isNull() | (gap <= 0), F.lit(30000.0))
        .when((n - 1) * 30000 > tight, tight / (n - 1))
        .otherwise(F.lit(30000.0))
    )


def session_clock(text: Column) -> Column:
    """Milliseconds of ``1:00 pm on 1 May, 2023``; 0 if that is not what the text says."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text, F.lit("h:mm a 'on' d MMMM, yyyy"))), F.lit(0))


def ordered(times: Column) -> Column:
    """True if an array of instants never decreases."""
    pairs = F.zip_with(F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), lambda a, b: a <= b)
    return F.forall(pairs, lambda x: F.coalesce(x, F.lit(False)))
