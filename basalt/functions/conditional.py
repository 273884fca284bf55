"""Conditional, session and JSON functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .strings import _col, _num


def coalesce(*xs) -> Column:
    return F.coalesce(*map(_col, xs))


nvl = ifnull = isnull = coalesce


def nvl2(a, b, c) -> Column:
    return F.when(_col(a).isNotNull(), _num(b)).otherwise(_num(c))


def if_(condition: Column, a, b) -> Column:
    return F.when(condition.cast("boolean"), _num(a)).otherwise(_num(b))


def decode(x, *pairs) -> Column:
    """Null matches null; an odd last argument is the default."""
    pairs, default = (pairs[:-1], pairs[-1]) if len(pairs) % 2 else (pairs, None)
    out = F.lit(default)
    for k in reversed(range(0, len(pairs), 2)):
        out = F.when(_col(x).eqNullSafe(F.lit(pairs[k])), _num(pairs[k + 1])).otherwise(out)
    return out


def equal_or_both_null(a, b) -> Column:
    return _col(a).eqNullSafe(_col(b))


def empty_as_null(x) -> Column:
    return F.nullif(_col(x), F.lit(""))


def database(spark: SparkSession) -> Column:
    return F.lit(spark.catalog.currentDatabase())


def version(spark: SparkSession) -> Column:
    return F.lit(spark.version)


def json_extract(j, path: str, kind: str = "string") -> Column:
    """A typed scalar at a path; null for invalid JSON."""
    return F.try_variant_get(F.try_parse_json(_col(j)), path, kind)


json_value = json_extract


def json_text(j, key) -> Column:
    """``j ->> key`` (or index): text."""
    return F.get_json_object(_col(j), f"$[{key}]" if isinstance(key, int) else f"$.{key}")


json_get = json_text
