"""Date and time expressions for timestamps with or without zone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

# fixed values: accepted text formats, tried in this order
FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss")


def whole(c: Column) -> Column:
    return c.cast("bigint")


def calendar_parts(col: str) -> dict[str, Column]:
    """Year to second; Monday is weekday 0."""
    t = F.col(col)
    parts = {
        "year": F.year(t),
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "dayofweek": F.weekday(t),
        "dayofyear": F.dayofyear(t),
        "week": F.weekofyear(t),
        "quarter": F.quarter(t),
        "hour": F.hour(t),
        "minute": F.minute(t),
        "second": F.second(t),
    }
    return {f"{col}_{k}": whole(v) for k, v in parts.items()}


def day_flags(col: str) -> dict[str, Column]:
    weekend = F.weekday(col) >= 5
    return {f"{col}_is_weekend": whole(weekend), f"{col}_is_business_day": whole(~weekend)}


def boundary_flags(col: str) -> dict[str, Column]:
    """First and last days of months, quarters and years."""
    day = F.to_date(F.col(col))
    flags = {"month": ("MM", 1), "quarter": ("quarter", 3), "year": ("year", 12)}
    out = {}
    for name, (unit, months) in flags.items():
        start = F.trunc(day, unit) if unit != "quarter" else F.date_trunc("quarter", day).cast("date")
        out[f"{col}_is_{name}_start"] = whole(day == start)
        out[f"{col}_is_{name}_end"] = whole(day == F.date_sub(F.add_months(start, months), 1))
    return out


def cyclic_features(col: str) -> dict[str, Column]:
    """Month, day and hour on the circle."""
    out = {}
    for name, part, size in (("month", F.month(col), 12), ("day", F.dayofmonth(col), 31), ("hour", F.hour(col), 24)):
        angle = part * (2 * math.pi) / size
        out |= {f"{col}_{name}_sin": F.sin(angle), f"{col}_{name}_cos": F.cos(angle)}
    return out


def seconds_of_day(c: Column) -> Column:
    return whole(F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c))


def epoch_features(col: str) -> dict[str, Column]:
    t = F.col(col)
    days = whole(F.unix_date(F.to_date(t)))
    return {
        f"{col}_days_since_epoch": days,
        f"{col}_seconds_since_midnight": seconds_of_day(t),
        f"{col}_timestamp": epoch_seconds(t),
    }


def epoch_seconds(t: Column) -> Column:
    """Seconds since 1970 of the wall-clock time, in either timestamp type."""
    return whole(F.unix_date(F.to_date(t))) * 86400 + seconds_of_day(t)


def elapsed_seconds(df: DataFrame, t: str) -> Column:
    """A count of seconds for gaps: real time where the timestamp has a zone, wall clock where it has none."""
    if isinstance(df.schema[t].dataType, T.TimestampType):
        return F.floor(F.unix_micros(F.col(t)) / 1_000_000)
    return epoch_seconds(F.col(t))


def from_epoch_seconds(seconds: Column) -> Column:
    """Inverse of epoch_seconds, as a zone-less timestamp."""
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("timestamp_ntz")
    return day + F.make_dt_interval(secs=F.pmod(seconds, F.lit(86400)).cast("decimal(18,6)"))


def season(col: str) -> dict[str, Column]:
    """0 winter, 1 spring, 2 summer, 3 autumn."""
    return {f"{col}_season": whole(F.floor(F.pmod(F.month(col), F.lit(12)) / 3))}


def parse_datetime(c: Column) -> Column:
    """Text to timestamp by the first format that fits; other text is null."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS])


def frequency_name(gap_seconds: Column) -> Column:
    """Name of a gap length in whole days."""
    days = F.floor(gap_seconds / 86400)
    return (
        F.when(gap_seconds.isNull(), "unknown")
        .when(days == 1, "daily")
        .when(days == 7, "weekly")
        .when(days.between(28, 31), "monthly")
        .when(days.between(365, 366), "yearly")
        .otherwise(F.concat(days.cast("string"), F.lit("_days")))
    )
