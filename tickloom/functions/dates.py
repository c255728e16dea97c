"""Calendar parts, time zones and range algebra.

Instants, durations and civil times are long microseconds; a civil time is
counted as if its zone were UTC.  So no result depends on the session's zone.
Null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import mod_, range_empty, range_intersection, range_mergeable, temporal_floor

SECOND = 1_000_000
DAY = 86_400 * SECOND


def date_of(us: Column) -> Column:
    return F.date_from_unix_date(F.floor(us / DAY).cast("int"))


def year(us: Column) -> Column:
    return F.year(date_of(us))


def month(us: Column) -> Column:
    return F.month(date_of(us))


def day(us: Column) -> Column:
    return F.dayofmonth(date_of(us))


def weekday(us: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date_of(us))


def isoweekday(us: Column) -> Column:
    """Monday is 1."""
    return F.weekday(date_of(us)) + 1


def _part(us: Column, unit: int, size: int) -> Column:
    return F.floor(mod_(us, F.lit(unit * size)) / unit)


def hour(us: Column) -> Column:
    return _part(us, 3600 * SECOND, 24)


def minute(us: Column) -> Column:
    return _part(us, 60 * SECOND, 60)


def second(us: Column) -> Column:
    return _part(us, SECOND, 60)


def microsecond(us: Column) -> Column:
    return mod_(us, F.lit(SECOND))


def timestamp(us: Column) -> Column:
    """Fractional seconds since 1970; also the total seconds of a duration."""
    return us / F.lit(float(SECOND))


total_seconds = timestamp


def isoformat(us: Column) -> Column:
    """ISO 8601 with microseconds only where they are not zero."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(F.date_format(date_of(us), "yyyy-MM-dd"), F.lit("T"), two(hour(us)), F.lit(":"), two(minute(us)), F.lit(":"), two(second(us)))
    fraction = microsecond(us)
    return F.when(fraction == 0, text).otherwise(F.concat(text, F.lit("."), F.lpad(fraction.cast("string"), 6, "0")))


def explode(us: Column) -> Column:
    """Year, month and day in an array."""
    return F.array(year(us), month(us), day(us))


def to_civil(us: Column, zone: str) -> Column:
    """The local time that clocks of `zone` show at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def resolve_civil(civil: Column, zone: str, overlap: str = "earlier", gap: str = "forward") -> Column:
    """The instant at which clocks of `zone` show `civil`.

    overlap (the time is shown twice): earlier, later or error.  gap (it is
    never shown): forward (by the width of the gap), backward, null or error.
    """
    if overlap not in ("earlier", "later", "error") or gap not in ("forward", "backward", "null", "error"):
        raise ValueError("unknown policy")
    before, after = (to_civil(civil + d, zone) - (civil + d) for d in (-DAY, DAY))
    a, b = civil - before, civil - after
    fits_a, fits_b = to_civil(a, zone) == civil, to_civil(b, zone) == civil
    fail = lambda m: F.raise_error(F.lit(m)).cast("long")
    twice = {"earlier": F.least(a, b), "later": F.greatest(a, b), "error": fail("ambiguous local time")}[overlap]
    never = {"forward": a, "backward": b, "null": F.lit(None).cast("long"), "error": fail("local time in a gap")}[gap]
    return F.when(fits_a & fits_b, F.when(a == b, a).otherwise(twice)).when(fits_a, a).when(fits_b, b).when(civil.isNotNull(), never)


def in_range(us: Column, start: Column, end: Column) -> Column:
    """LT before the range, EQ in it (both ends included), GT after it."""
    return F.when(us < start, "LT").when(us > end, "GT").when(us.isNotNull(), "EQ")


# Ranges are tuples (lo, hi, lo_in, hi_in), as in `scalar`.


def range_shift(a: tuple, by: Column) -> tuple:
    return a[0] + by, a[1] + by, a[2], a[3]


def range_extent(lo: Column, hi: Column) -> Column:
    return F.greatest(hi - lo, F.lit(0))


def _hull(a: tuple, b: tuple) -> tuple:
    lo_in = F.when(a[0] < b[0], a[2]).when(a[0] > b[0], b[2]).otherwise(a[2] | b[2])
    hi_in = F.when(a[1] > b[1], a[3]).when(a[1] < b[1], b[3]).otherwise(a[3] | b[3])
    return F.least(a[0], b[0]), F.greatest(a[1], b[1]), lo_in, hi_in


def range_struct(r: tuple) -> Column:
    return F.struct(*[c.alias(n) for c, n in zip(r, ("lo", "hi", "lo_in", "hi_in"), strict=True)])


def range_merge(a: tuple, b: tuple) -> Column:
    """One range, or null where the two are not mergeable."""
    return F.when(range_mergeable(a, b), range_struct(_hull(a, b)))


def _not_empty(*ranges: tuple) -> Column:
    parts = F.array(*[F.when(~range_empty(*r), range_struct(r)) for r in ranges])
    return F.array_compact(parts)


def range_union(a: tuple, b: tuple) -> Column:
    """The ranges of the union, ascending; empty ones are left out."""
    merged = F.array(range_struct(_hull(a, b)))
    whole = ~range_empty(*a) & ~range_empty(*b) & range_mergeable(a, b)
    return F.when(whole, merged).otherwise(F.array_sort(_not_empty(a, b)))


def range_difference(a: tuple, b: tuple) -> Column:
    """What of `a` is not in `b`: no range, one or two, ascending."""
    i = range_intersection(a, b)
    left, right = (a[0], i[0], a[2], ~i[2]), (i[1], a[1], ~i[3], a[3])
    return F.when(range_empty(*i), _not_empty(a)).otherwise(_not_empty(left, right))


def temporal_bucket(us: Column, quantum: int, origin: int = 0) -> tuple:
    """The half-open range of fixed width that holds an instant."""
    low = temporal_floor(us, quantum, origin)
    return low, low + quantum, F.lit(True), F.lit(False)


# Durations in microseconds, with Python's floor rules.


def days(us: Column) -> Column:
    return F.floor(us / F.lit(86_400_000_000).cast("decimal(20,0)")).cast("long")


def seconds(us: Column) -> Column:
    """The whole seconds of the day that is left."""
    return F.floor((us - days(us) * 86_400_000_000) / 1_000_000).cast("long")


def microseconds(us: Column) -> Column:
    return F.pmod(us, F.lit(1_000_000)).cast("long")


def total_seconds(us: Column) -> Column:
    return us.cast("double") / 1_000_000


def day_of_month(us: Column) -> Column:
    return day(us)


def month_of_year(us: Column) -> Column:
    return month(us)


# An instant with the zone that it is shown in.


def at_zone(us: Column, zone: Column | str) -> Column:
    return F.struct(us.alias("instant"), (zone if isinstance(zone, Column) else F.lit(zone)).alias("zone"))


def convert_zone(zoned: Column, zone: Column | str) -> Column:
    return at_zone(zoned["instant"], zone)


def to_instant(zoned: Column) -> Column:
    return zoned["instant"]


def last_modified_date(us: Column) -> Column:
    return date_of(us)
