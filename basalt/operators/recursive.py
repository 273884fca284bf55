"""Recursive queries: fixpoints whose rounds are written tables, so lineage stays short."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class RecursionLimit(RuntimeError):
    """More rounds than allowed; the result would be incomplete."""


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="basalt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def round_table(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def recursive(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, limit: int = 1000) -> DataFrame:
    """Rows of ``base`` and of ``step`` applied to each round's new rows, until there are none.

    ``distinct`` keeps each row once, so cycles end; without it every path counts, and a cycle runs into
    the limit, which is an error.
    """
    every = work = round_table(base.distinct() if distinct else base)
    for _ in range(limit):
        new = step(work)
        new = new.toDF(*every.columns)
        if distinct:
            new = new.distinct().join(every, [new[c].eqNullSafe(every[c]) for c in every.columns], "left_anti")
        work = round_table(new)
        if work.isEmpty():
            return every
        every = every.unionAll(work)
    raise RecursionLimit(f"no fixpoint after {limit} rounds")


def shortest_hops(edges: DataFrame, sources: DataFrame, limit: int = 1000) -> DataFrame:
    """source, node, hops by breadth-first search over edges (src, dst) from a table of sources (source)."""
    from pyspark.sql import functions as F

    seen = frontier = round_table(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")).distinct())
    for hop in range(1, limit + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        frontier = round_table(step.join(seen, ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RecursionLimit(f"paths of over {limit} hops")
