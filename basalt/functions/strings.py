"""String functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def upper(s) -> Column:
    return F.upper(_col(s).cast("string"))


def lower(s) -> Column:
    return F.lower(_col(s).cast("string"))


def concat(*parts) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *(_col(p).cast("string") for p in parts))


def concat_ws(separator: Column, *parts) -> Column:
    """A null separator gives null; null parts are skipped."""
    joined = F.array_join(F.array_compact(F.array(*(_col(p).cast("string") for p in parts))), "\x00")
    return F.when(separator.isNotNull(), F.replace(joined, F.lit("\x00"), separator))


def length(s) -> Column:
    return F.char_length(_col(s).cast("string"))


def substr(s, start, count=None) -> Column:
    """Positions from 1; a start below 1 is 1; beyond the end there is the empty string."""
    begin = F.greatest(_num(start), F.lit(1))
    return F.substr(_col(s), begin, _num(count)) if count is not None else F.substr(_col(s), begin)


def trim(s, chars: str = " ", side: str = "both") -> Column:
    return {"both": F.btrim, "leading": F.ltrim, "trailing": F.rtrim}[side](_col(s), F.lit(chars))


def replace(s, old, new) -> Column:
    return F.replace(_col(s), _num(old), _num(new))


def lpad(s, n: int, pad: str = " ") -> Column:
    return F.lpad(_col(s), n, pad)


def rpad(s, n: int, pad: str = " ") -> Column:
    return F.rpad(_col(s), n, pad)


def initcap(s) -> Column:
    """Every run of letters and digits is a word."""
    runs = F.regexp_extract_all(_col(s), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")


def reverse(s) -> Column:
    return F.reverse(_col(s))


def repeat(s, n) -> Column:
    return F.repeat(_col(s), F.greatest(_num(n), F.lit(0)))


def translate(s, old: str, new: str) -> Column:
    return F.translate(_col(s), old, new)


def split_part(s, delimiter: str, n) -> Column:
    """Parts from 1; other numbers give the empty string."""
    return F.when(_num(n) <= 0, F.lit("")).otherwise(F.split_part(_col(s), F.lit(delimiter), F.greatest(_num(n), F.lit(1))))


def left(s, n) -> Column:
    return F.left(_col(s), F.greatest(_num(n), F.lit(0)))


def right(s, n) -> Column:
    return F.right(_col(s), F.greatest(_num(n), F.lit(0)))


def chr_(n) -> Column:
    """The character of a code point, also beyond one byte (UTF-32 read as text)."""
    return F.when(_num(n) < 128, F.chr(_num(n))).otherwise(F.decode(F.unhex(F.lpad(F.hex(_num(n)), 8, "0")), "UTF-32"))


def ascii_(s) -> Column:
    return F.ascii(_col(s))


def charindex(part, s, start=1) -> Column:
    """Position in characters from 1, 0 where absent."""
    return F.locate(part, _col(s), start) if isinstance(part, str) else F.position(part, _col(s), _num(start))


def instr(s, part: str, start: int = 1) -> Column:
    return charindex(part, s, start)


def regexp_like(s, pattern: str, flags: str = "") -> Column:
    return _col(s).rlike(f"(?i){pattern}" if "i" in flags else pattern)


def regexp_replace(s, pattern: str, new: str, flags: str = "") -> Column:
    """The first match, or every match with flag g."""
    pattern = f"(?i){pattern}" if "i" in flags else pattern
    if "g" in flags:
        return F.regexp_replace(_col(s), pattern, new)
    at = F.regexp_instr(_col(s), F.lit(pattern))
    hit = F.regexp_substr(_col(s), F.lit(pattern))
    changed = F.concat(F.left(_col(s), at - 1), F.regexp_replace(hit, pattern, new), F.substr(_col(s), at + F.char_length(hit)))
    return F.when(at > 0, changed).otherwise(_col(s))


def regexp_substr(s, pattern: str) -> Column:
    return F.regexp_substr(_col(s), F.lit(pattern))


_FORMATS = (("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("HH24", "HH"), ("MI", "mm"), ("SS", "ss"))


def date_pattern(fmt: str) -> str:
    """YYYY MM DD HH24 MI SS as Spark's pattern letters; other text is quoted."""
    out, rest = "", fmt
    while rest:
        for name, letters in _FORMATS:
            if rest.startswith(name):
                out, rest = out + letters, rest[len(name) :]
                break
        else:
            at = min((k for k in (rest.find(name, 1) for name, _ in _FORMATS) if k > 0), default=len(rest))
            plain, rest = rest[:at], rest[at:]
            out += re.sub("[A-Za-z']+", lambda m: "'" + m[0].replace("'", "''") + "'", plain)
    return out


def to_char(x, fmt: str | None = None) -> Column:
    return F.date_format(_col(x), date_pattern(fmt)) if fmt else _col(x).cast("string")


def newid() -> Column:
    return F.uuid()
