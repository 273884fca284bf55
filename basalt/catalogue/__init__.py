"""All queries of the engine's own operators, by name, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from basalt.catalogue import features, relational, scalars
from basalt.sources import tables


def _sql(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sql(spark, sf_dir, text)


def _scalar(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    table, keys, column, _ = scalars.FUNCTIONS[name]
    return tables.table(spark, sf_dir, table).select(*[k.strip() for k in keys.split(",")], column().alias("v"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(relational.FLAGSHIP, spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: partial(_sql, text) for k, text in relational.SAME.items()}
    found |= {k: partial(_sql, pair[0]) for k, pair in relational.PAIRS.items()}
    found |= {k: partial(_scalar, k) for k in scalars.FUNCTIONS}
    return found | features.QUERIES


def oracle_sql() -> dict[str, str]:
    found = dict(relational.SAME) | {k: pair[1] for k, pair in relational.PAIRS.items()}
    found |= {k: f"SELECT {keys}, {duck} AS v FROM {table}" for k, (table, keys, _, duck) in scalars.FUNCTIONS.items()}
    return found | features.ORACLES
