"""Clinical times: parsing, zones, fallbacks and their flags."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.hashing import NULL_LITERALS, strip

BUILTIN = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss")


def parse_naive(cell: Column, formats: Sequence[str] = (), null_literals: Sequence[str] = NULL_LITERALS) -> Column:
    """Local time of a cell by the first format that fits, null if none does; more than six digits of a second are cut."""
    s = strip(cell)
    s = F.regexp_replace(s, r"(\.\d{6})\d+", "$1")
    s = F.when(~s.isin("", *null_literals), s)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in (*formats, *BUILTIN)]).cast("timestamp_ntz")


def unparseable(cell: Column, formats: Sequence[str] = (), null_literals: Sequence[str] = NULL_LITERALS) -> Column:
    """Whether a cell says something that no format reads."""
    return ~F.coalesce(strip(cell).isin("", *null_literals), F.lit(True)) & parse_naive(cell, formats, null_literals).isNull()


def to_utc(local: Column, zone: str) -> Column:
    """Local wall clock to UTC, to the second; an ambiguous hour is its first occurrence."""
    return F.date_trunc("second", F.convert_timezone(F.lit(zone), F.lit("UTC"), local)).cast("timestamp_ntz")


def to_local(utc: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def local_date(utc: Column, zone: str) -> Column:
    return to_local(utc, zone).cast("date")


def looks_date_only(cell: Column) -> Column:
    return F.coalesce(strip(cell).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def days_between(a: Column, b: Column) -> Column:
    """Signed difference in days, with its fraction."""
    return (micros(a) - micros(b)) / F.lit(86_400_000_000.0)


def plus_days(t: Column, days: Column) -> Column:
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (days * 86400).cast("decimal(18,6)"))


def resolve_times(event: Column, alias: Column, available: Column, end: Column) -> Column:
    """(event_time, available_time, end_time, flags): fallbacks are flagged, availability never precedes the event."""
    e, a = F.coalesce(event, available), F.coalesce(available, event)
    none = F.array().cast("array<string>")
    say = lambda when, what: F.when(F.coalesce(when, F.lit(False)), F.array(F.lit(what))).otherwise(none)
    flags = F.concat(
        say((alias > 0) | (event.isNull() & available.isNotNull()), "TIME_FALLBACK"),
        say(available.isNull() & event.isNotNull(), "AVAILABILITY_ASSUMED"),
        say(a < e, "AVAILABILITY_BEFORE_EVENT"),
        say(end < e, "END_BEFORE_START"),
    )
    return F.struct(e.alias("event_time"), F.when(e.isNull() | a.isNull(), a).otherwise(F.greatest(a, e)).alias("available_time"), end.alias("end_time"), F.array_sort(flags).alias("flags"))


def boundaries_between(a: Column, b: Column, unit: str) -> Column:
    """How many hour or day boundaries lie between two times: both are cut to the unit first."""
    size = {"hour": 3_600_000_000, "day": 86_400_000_000}[unit]
    return ((micros(F.date_trunc(unit, a)) - micros(F.date_trunc(unit, b))) / size).cast("bigint")


def offset_change_days(zone: str, first_year: int, last_year: int) -> list[dt.date]:
    """Days on which a zone changes its offset, for the years that the data hold; a few per year, made on the driver."""
    z, out = ZoneInfo(zone), []
    day, end = dt.date(first_year, 1, 1), dt.date(last_year, 12, 31)
    while day <= end:
        a = dt.datetime.combine(day, dt.time(), z).utcoffset()
        b = dt.datetime.combine(day + dt.timedelta(days=1), dt.time(), z).utcoffset()
        if a != b:
            out.append(day)
        day += dt.timedelta(days=1)
    return out
