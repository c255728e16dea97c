"""Time arithmetic on single Python values, by the rules of `dates` and `scalar`.

An instant is a `datetime`, a span a `timedelta`; a result outside of what they
hold is an OverflowError."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1)
ONE = timedelta(microseconds=1)


def checked_add(a, b):
    return a + b


def checked_subtract(a, b):
    return a - b


def checked_negate(span: timedelta) -> timedelta:
    return -span


def checked_multiply(span: timedelta, factor: int) -> timedelta:
    return span * factor


def checked_divide(span: timedelta, divisor: int) -> timedelta:
    """Rounded down to a microsecond."""
    if divisor == 0:
        raise ZeroDivisionError("a span is divided by zero")
    return span // divisor


def apply_period(at: datetime, years: int = 0, months: int = 0, days: int = 0) -> datetime:
    """Later by calendar months, then days; a day that the month lacks becomes its last."""
    n = at.year * 12 + at.month - 1 + 12 * years + months
    year, month = divmod(n, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return at.replace(year=year, month=month + 1, day=min(at.day, last)) + timedelta(days=days)


def floor(at, quantum: timedelta, origin: datetime = EPOCH):
    if quantum <= timedelta(0):
        raise ValueError("a quantum is longer than nothing")
    return at - (at - origin) % quantum


def ceil(at, quantum: timedelta, origin: datetime = EPOCH):
    low = floor(at, quantum, origin)
    return at if low == at else low + quantum


def round_(at, quantum: timedelta, origin: datetime = EPOCH):
    """The nearest multiple; of two, the even one."""
    low = floor(at, quantum, origin)
    twice, odd = 2 * (at - low), (low - origin) // quantum % 2 == 1
    return low + quantum if twice > quantum or (twice == quantum and odd) else low


@dataclass(frozen=True)
class Range:
    """From `lo` to `hi`; both ends finite, each part of it or not."""

    lo: datetime
    hi: datetime
    lo_in: bool = True
    hi_in: bool = False

    def __bool__(self) -> bool:
        return self.lo < self.hi or (self.lo == self.hi and self.lo_in and self.hi_in)

    def __contains__(self, x) -> bool:
        return (self.lo < x or (self.lo == x and self.lo_in)) and (x < self.hi or (x == self.hi and self.hi_in))

    def shift(self, span: timedelta) -> Range:
        return Range(self.lo + span, self.hi + span, self.lo_in, self.hi_in)

    def extent(self) -> timedelta:
        return max(self.hi - self.lo, timedelta(0))

    def intersection(self, other: Range) -> Range:
        # an end is later the larger its time, and of equal times if it is open
        lo, closed = max((self.lo, not self.lo_in), (other.lo, not other.lo_in))
        hi, hi_in = min((self.hi, self.hi_in), (other.hi, other.hi_in))
        return Range(lo, hi, not closed, hi_in)

    def overlaps(self, other: Range) -> bool:
        return bool(self.intersection(other))

    def touches(self, other: Range) -> bool:
        return self.hi == other.lo or other.hi == self.lo

    def adjacent(self, other: Range) -> bool:
        """They touch, and exactly one of them has the shared end."""
        return (self.hi == other.lo and self.hi_in != other.lo_in) or (other.hi == self.lo and other.hi_in != self.lo_in)

    def mergeable(self, other: Range) -> bool:
        return self.overlaps(other) or self.adjacent(other)

    def hull(self, other: Range) -> Range:
        lo, opened = min((self.lo, not self.lo_in), (other.lo, not other.lo_in))
        hi, hi_in = max((self.hi, self.hi_in), (other.hi, other.hi_in))
        return Range(lo, hi, not opened, hi_in)

    def merge(self, other: Range) -> Range:
        if not self.mergeable(other):
            raise ValueError("the ranges neither overlap nor meet")
        return self.hull(other)

    def union(self, other: Range) -> list[Range]:
        some = sorted((r for r in (self, other) if r), key=lambda r: (r.lo, not r.lo_in))
        return [self.hull(other)] if len(some) == 2 and self.mergeable(other) else some

    def difference(self, other: Range) -> list[Range]:
        cut = self.intersection(other)
        if not cut:
            return [self] if self else []
        parts = Range(self.lo, cut.lo, self.lo_in, not cut.lo_in), Range(cut.hi, self.hi, not cut.hi_in, self.hi_in)
        return [p for p in parts if p]


def bucket(at: datetime, width: timedelta, origin: datetime = EPOCH) -> Range:
    low = floor(at, width, origin)
    return Range(low, low + width)


def to_civil(instant: datetime, zone: str) -> datetime:
    """What clocks of the zone show at an instant (a time without a zone is UTC's)."""
    return instant.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone)).replace(tzinfo=None)


def resolve_civil(civil: datetime, zone: str, overlap: str = "earlier", gap: str = "forward") -> datetime | None:
    """The instant at which clocks of the zone show `civil`.

    overlap (shown twice): earlier, later or error.  gap (never shown): forward, backward, null or error."""
    if overlap not in ("earlier", "later", "error") or gap not in ("forward", "backward", "null", "error"):
        raise ValueError("unknown policy")
    first, second = (civil.replace(tzinfo=ZoneInfo(zone), fold=f).astimezone(ZoneInfo("UTC")).replace(tzinfo=None) for f in (0, 1))
    if first == second:
        return first
    if to_civil(first, zone) == civil:
        if overlap == "error":
            raise ValueError("ambiguous local time")
        return first if overlap == "earlier" else second
    if gap == "error":
        raise ValueError("local time in a gap")
    return {"forward": first, "backward": second, "null": None}[gap]
