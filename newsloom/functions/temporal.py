"""Time functions on columns; the clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed_time(text: Column) -> Column:
    """A timestamp from 'date time', 'dateTtime' with or without fraction and offset; null if corrupt."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2})T", "$1 "))


def age_hours(ts: Column, now: Column) -> Column:
    """Whole hours since ts, never below 0; 0 for null."""
    return F.coalesce(F.greatest(F.lit(0).cast("long"), F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3_600_000_000)), F.lit(0))


def julian_age_days(ts: Column, now: Column) -> Column:
    """Days since ts, cut towards zero."""
    return ((F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000).cast("int")


def within(ts: Column, now: Column, window: str) -> Column:
    """ts not before now minus a window ('30 days'), the border included."""
    return ts >= now - F.expr(f"interval {window}")


def percent_half_even(share: Column) -> Column:
    """A share as a whole percentage, halves to even."""
    return F.bround(share * 100).cast("int")


def retry_after(text: Column, low: float = 1.0, high: float = 120.0, default: float = 30.0) -> Column:
    """Seconds of a retry-after header, clamped; the default if it is no number."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(text.try_cast("double"), F.lit(default))))


def fixed_slots(now: Column, n: Column, times: tuple[str, ...] = ("10:00", "15:00", "19:30"), grace_minutes: int = 5) -> Column:
    """struct(slots, carry): the next n of today's times that are not past by more than the grace, and what is left over."""
    day = F.date_trunc("day", now)
    every = F.array_sort(F.array(*[day + F.expr(f"interval '{t}:00' hour to second") for t in times]))
    open_ = F.filter(every, lambda s: s >= now - F.expr(f"interval {grace_minutes} minutes"))
    want = F.greatest(n, F.lit(0))
    taken = F.slice(open_, F.lit(1), F.least(want, F.size(open_)))
    return F.struct(taken.alias("slots"), F.greatest(want - F.size(taken), F.lit(0)).alias("carry"))


def even_slots(now: Column, end: Column, n: Column, gap_minutes: int = 90) -> Column:
    """struct(slots, carry): n times spread evenly from now to end, at least a gap apart."""
    left = (F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))) / 60.0
    interval = F.greatest(F.try_divide(left, n), F.lit(float(gap_minutes)))
    count = F.when((n <= 0) | (left <= 0), F.lit(0)).otherwise(F.least(n, F.floor(left / interval).cast("int") + 1))
    slots = F.transform(
        F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.timestamp_seconds(F.unix_timestamp(now.cast("timestamp")) + F.floor(i * interval * 60)),
    )
    return F.struct(slots.alias("slots"), (F.greatest(n, F.lit(0)) - count).alias("carry"))


def page_freshness(path: Column, now: Column, zone: str = "Europe/Moscow", stale_hour: int = 21) -> Column:
    """fresh, stale or inconclusive, from the -MM-DD suffix of the newest page's path and the local clock.

    A date in the future means last year only for a December date seen in January.
    """
    local = F.from_utc_timestamp(now, zone)
    month, day = (F.regexp_extract(path, r"-(\d{2})-(\d{2})(?:-\d+)?$", k) for k in (1, 2))
    this = F.try_to_timestamp(F.concat_ws("-", F.year(local).cast("string"), month, day), F.lit("yyyy-MM-dd")).cast("date")
    last = F.try_to_timestamp(F.concat_ws("-", (F.year(local) - 1).cast("string"), month, day), F.lit("yyyy-MM-dd")).cast("date")
    today = F.to_date(local)
    date = F.when(this <= today, this).when((month == "12") & (F.month(local) == 1), last)
    age = F.date_diff(today, date)
    return (
        F.when((month == "") | date.isNull(), F.lit("inconclusive"))
        .when(age == 0, F.lit("fresh"))
        .when(age >= 2, F.lit("stale"))
        .when((age == 1) & (F.hour(local) >= stale_hour), F.lit("stale"))
        .otherwise(F.lit("inconclusive"))
    )
