"""Table statistics by one aggregation a column, query statistics, and maintenance thresholds."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.operators.recursive import round_table

STATS = "table_name string, column_name string, row_count long, distinct_values double, null_fraction double, average_width double, common_values array<string>, common_frequencies array<double>"


def analyze(df: DataFrame, name: str, percent: float | None = None, rows: int | None = None, top: int = 10) -> DataFrame:
    """A row a column: rows, distinct values, null fraction, width and the commonest values.

    With ``percent`` or ``rows`` columns are read from a sample; distinct values then follow
    d + f1 * (N - n) / n, with d distinct and f1 single values among n sampled of N rows.
    """
    total = df.count()
    share = min(1.0, percent / 100 if percent else rows / max(total, 1) if rows else 1.0)
    sample = df.sample(fraction=share, seed=1) if share < 1 else df
    out = None
    for c in df.columns:
        value = F.col(f"`{c}`").cast("string") if df.schema[c].dataType.typeName() not in ("array", "map", "struct") else F.to_json(F.col(f"`{c}`"))
        counted = sample.select(value.alias("v")).groupBy("v").agg(F.count("*").alias("n"))
        width = F.sum(F.octet_length("v") * F.col("n"))
        common = F.slice(F.sort_array(F.collect_list(F.struct("n", "v")), asc=False), 1, top)
        best = counted.filter("v IS NOT NULL").orderBy(F.desc("n"), "v").limit(top).agg(common.alias("common"))
        one = counted.agg(
            F.sum("n").alias("m"), F.count("v").alias("d"), F.sum(F.when(F.col("v").isNotNull() & (F.col("n") == 1), 1).otherwise(0)).alias("f1"),
            F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("nulls"), width.alias("width"),
        ).crossJoin(best)  # one row each
        m = F.greatest(F.coalesce("m", F.lit(0)), F.lit(1))
        row = one.select(
            F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(total).cast("long").alias("row_count"),
            (F.col("d") + F.coalesce("f1", F.lit(0)) * (F.lit(total) - m) / m).cast("double").alias("distinct_values") if share < 1 else F.col("d").cast("double").alias("distinct_values"),
            (F.coalesce("nulls", F.lit(0)) / m).cast("double").alias("null_fraction"),
            (F.coalesce("width", F.lit(0)) / F.greatest(m - F.coalesce("nulls", F.lit(0)), F.lit(1))).cast("double").alias("average_width"),
            F.transform("common", lambda x: x["v"]).alias("common_values"), F.transform("common", lambda x: (x["n"] / m).cast("double")).alias("common_frequencies"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def fingerprint(sql: str) -> str:
    """The text with literals and spacing made alike."""
    plain = re.sub(r"'(?:[^']|'')*'|\b\d+(?:\.\d+)?\b", "?", sql.strip().rstrip(";"))
    return re.sub(r"\s+", " ", plain).lower()


@dataclass
class QueryStats:
    """Calls, rows and milliseconds by fingerprint."""

    seen: dict[str, list[float]] = field(default_factory=dict)

    def record(self, sql: str, ms: float, rows: int) -> None:
        own = self.seen.setdefault(fingerprint(sql), [0, 0.0, 0.0, 0])
        own[0] += 1
        own[1] += ms
        own[2] = max(own[2], ms)
        own[3] += rows

    def run(self, spark: SparkSession, sql: str):
        """Run to the end and record; the result is a written table, however large."""
        began = time.perf_counter()
        out = round_table(spark.sql(sql))
        self.record(sql, (time.perf_counter() - began) * 1000, out.count())
        return out

    def show(self, spark: SparkSession) -> DataFrame:
        rows = [(k, int(n), ms, ms / n, most, int(r)) for k, (n, ms, most, r) in self.seen.items()]
        return spark.createDataFrame(rows, "query string, calls long, total_ms double, mean_ms double, max_ms double, rows long")

    def reset(self) -> None:
        self.seen.clear()


def explain(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def explain_analyze(df: DataFrame) -> dict[str, float]:
    """Actual rows and milliseconds."""
    began = time.perf_counter()
    rows = df.count()
    return {"rows": rows, "ms": (time.perf_counter() - began) * 1000}


def needs_vacuum(live: int, dead: int) -> bool:
    return dead > 50 + 0.2 * live


def needs_analyze(live: int, modified: int) -> bool:
    return modified > 50 + 0.1 * live


def needs_compaction(files: int, delete_files: int = 0) -> bool:
    return files + delete_files >= 10


def maintain(table) -> DataFrame | None:
    """Compact a lake table that has many deleted rows, or many files that came since it was compacted."""
    s = table.current()
    live, dead = s.n_rows, s.n_deleted
    return table.compact() if needs_compaction(s.n_loose, len(s.deletes)) or needs_vacuum(live - dead, dead) else None
