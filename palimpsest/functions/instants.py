"""Strict time bounds as users write them, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})$"


def instant_ms(text: Column) -> Column:
    """Milliseconds since 1970 of a full RFC 3339 time with an offset; null for anything else.

    Days must exist and no part may run over; of a fraction the milliseconds count.
    """
    part = lambda n: F.regexp_extract(text, _SHAPE, n)
    number = lambda c: F.when(c == "", "0").otherwise(c).cast("long")
    day = F.try_to_timestamp(F.nullif(part(1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")
    zone = part(6)
    far, near = number(F.substring(zone, 2, 2)), number(F.substring(zone, 5, 2))
    hour, minute, second = (number(part(n)) for n in (2, 3, 4))
    valid = text.rlike(_SHAPE) & day.isNotNull() & (hour < 24) & (minute < 60) & (second < 60) & (far < 24) & (near < 60)
    offset = F.when(zone == "Z", 0).otherwise(F.when(zone.startswith("-"), -1).otherwise(1) * (far * 60 + near) * 60_000)
    at = F.unix_date(day).cast("long") * 86_400_000 + (hour * 3600 + minute * 60 + second) * 1000 + number(F.substring(F.concat(part(5), F.lit("000")), 1, 3)) - offset
    return F.when(valid, at)


def canonical(ms: Column) -> Column:
    """A time as canonical text: UTC, milliseconds, Z."""
    days = F.floor(ms / 86_400_000).cast("int")
    rest = F.pmod(ms, F.lit(86_400_000))
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    clock = F.concat(two(rest / 3_600_000), F.lit(":"), two(F.pmod(rest, F.lit(3_600_000)) / 60_000), F.lit(":"), two(F.pmod(rest, F.lit(60_000)) / 1000), F.lit("."), F.lpad(F.pmod(rest, F.lit(1000)).cast("string"), 3, "0"))
    return F.concat(F.date_format(F.date_from_unix_date(days), "yyyy-MM-dd"), F.lit("T"), clock, F.lit("Z"))


def window(after: Column, before: Column) -> Column:
    """A pair of bounds, either of which may be null, as after_ms, before_ms and verdict: valid, bound or window."""
    a, b = instant_ms(after), instant_ms(before)
    bad = (after.isNotNull() & a.isNull()) | (before.isNotNull() & b.isNull())
    return F.struct(a.alias("after_ms"), b.alias("before_ms"), F.when(bad, "bound").when(a > b, "window").otherwise("valid").alias("verdict"))
