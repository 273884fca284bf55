"""Date, time and interval functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import _col, date_pattern


def now() -> Column:
    return F.current_timestamp()


def current_date() -> Column:
    return F.current_date()


def current_time() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


def extract(field: str, x) -> Column:
    """YEAR MONTH DAY HOUR MINUTE SECOND DOW DOY EPOCH as integers; Sunday is 0; seconds are cut off."""
    c = _col(x).cast("timestamp")
    if field.upper() == "DOW":
        return F.dayofweek(c) - 1
    if field.upper() == "EPOCH":
        return F.unix_timestamp(c)
    names = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "DOY": F.dayofyear}
    return names[field.upper()](c)


date_part = extract


def date_trunc(unit: str, x, is_date: bool = False) -> Column:
    return F.trunc(_col(x), unit) if is_date else F.date_trunc(unit, _col(x))


def interval(months: int = 0, days: int = 0, seconds: float = 0) -> Column:
    """Months, days and seconds stay apart, as calendar arithmetic needs."""
    return F.make_interval(months=F.lit(months), days=F.lit(days), secs=F.lit(seconds).cast("decimal(18,6)"))


def date_add(d, months: int = 0, days: int = 0, seconds: float = 0) -> Column:
    """Months clamp to the month's last day."""
    c = _col(d)
    c = F.add_months(c, months) if months and not seconds else c
    if not seconds:
        return F.date_add(c, days) if days else c
    return _col(d) + interval(months, days, seconds)


def date_sub(d, months: int = 0, days: int = 0, seconds: float = 0) -> Column:
    return date_add(d, -months, -days, -seconds)


def datediff(unit: str, a, b) -> Column:
    """a - b in whole units."""
    return F.datediff(_col(a), _col(b)) if unit.upper() == "DAY" else F.timestamp_diff(unit.upper(), _col(b), _col(a))


def age(a, b=None) -> Column:
    return _col(a) - (F.current_timestamp() if b is None else _col(b))


def to_date(s, fmt: str | None = None) -> Column:
    return F.to_date(_col(s), date_pattern(fmt)) if fmt else F.to_date(_col(s))


def unix_timestamp(x=None) -> Column:
    return F.unix_timestamp() if x is None else F.unix_timestamp(_col(x).cast("timestamp"))


def from_unixtime(n) -> Column:
    return F.timestamp_seconds(_col(n))
