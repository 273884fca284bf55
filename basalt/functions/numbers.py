"""Mathematical functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import _col, _num

abs_ = F.abs
sin, cos, tan, asin, acos, atan, atan2 = F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.atan2
degrees, radians, exp, ln, log10, sqrt, power = F.degrees, F.radians, F.exp, F.ln, F.log10, F.sqrt, F.power


def pi() -> Column:
    return F.pi()


def ceil(x, kind: str = "double") -> Column:
    """The type stays."""
    return F.ceil(_col(x)).cast(kind)


def floor(x, kind: str = "double") -> Column:
    return F.floor(_col(x)).cast(kind)


def round_(x, n: int = 0) -> Column:
    """Half to even on the decimal value; without places an integer."""
    out = F.bround(_col(x).cast("decimal(38,10)"), n)
    return out.cast("bigint") if n == 0 else out.cast("double")


def trunc(x, n: int = 0) -> Column:
    """Digits after the n-th place are cut off, on the decimal value, so that binary fractions do no harm."""
    scale = F.lit(10**n)
    value = _col(x).cast("decimal(28,10)")
    return (F.signum(value) * F.floor(F.abs(value) * scale) / scale).cast("double")


def sign(x) -> Column:
    return F.signum(_col(x)).cast("int")


def mod(a, b) -> Column:
    """The sign of the dividend."""
    return _col(a) % _num(b)


def log(*args) -> Column:
    """One argument: natural; two: base, value."""
    return F.ln(_col(args[0])) if len(args) == 1 else F.ln(_col(args[1])) / F.ln(_num(args[0]))


def square(x) -> Column:
    return _col(x) * _col(x)


def random(seed: int | None = None) -> Column:
    return F.rand(seed)


def to_number(s, kind: str = "decimal(38,10)") -> Column:
    return F.btrim(_col(s)).cast(kind)


def divide(a: Column, b: Column, integral: bool) -> Column:
    """Integers divide to integers."""
    return F.call_function("div", a, b) if integral else a / b
