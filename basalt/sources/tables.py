"""Reading base tables, CSV in and out, the one-row table, system views and SQL scripts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_known: dict[tuple, DataFrame] = {}


def _scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, listed and its schema read once, and again when its files have changed."""
    path = f"{sf_dir}/{name}.parquet"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where)
    key = (spark.sparkContext.applicationId, path, status.getModificationTime(), status.getLen())
    if key not in _known:
        _known[key] = spark.read.parquet(path)
    return _known[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table as a relation of its own, so that it can be joined with itself."""
    return spark.read.schema(_scan(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Make base tables available to SQL text; scans stay lazy, pruned and pushed down."""
    for name in names:
        _scan(spark, sf_dir, name).createOrReplaceTempView(name)


def sql(spark: SparkSession, sf_dir: str, text: str, args=None) -> DataFrame:
    """Run SQL text over the base tables that it names."""
    words = set(re.findall(r"\w+", text.lower()))
    register(spark, sf_dir, *(t for t in TABLES if t in words))
    if "dual" in words:
        dual(spark).createOrReplaceTempView("dual")
    return spark.sql(text, args=args)


def dual(spark: SparkSession) -> DataFrame:
    """One row, X in its column ``dummy``."""
    return spark.sql("SELECT 'X' AS dummy")


def copy_to_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",") -> None:
    """COPY ... TO: a folder of CSV parts, written in parallel; nulls are empty, empty strings quoted."""
    df.write.mode("errorifexists").csv(path, header=header, sep=delimiter, nullValue="", emptyValue='""', escape='"', quoteAll=False)


def copy_from_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True, delimiter: str = ",", multi_line: bool = False) -> DataFrame:
    """COPY ... FROM: the declared schema, so no pass to infer it; a malformed row is an error."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line)
    return reader.csv(path, header=header, sep=delimiter, nullValue="", emptyValue="", escape='"')


def information_tables(spark: SparkSession) -> DataFrame:
    """table_schema, table_name, table_type of the session's tables and views."""
    rows = [(t.namespace[0] if t.namespace else "public", t.name, "VIEW" if t.isTemporary or t.tableType == "VIEW" else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def information_columns(spark: SparkSession, *names: str) -> DataFrame:
    """table_name, column_name, ordinal_position, data_type, is_nullable."""
    rows = []
    for name in names or [t.name for t in spark.catalog.listTables()]:
        for k, f in enumerate(spark.table(name).schema, 1):
            rows.append((name, f.name, k, f.dataType.simpleString(), "YES" if f.nullable else "NO"))
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable string")


def information_schemata(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.catalog or "", d.name) for d in spark.catalog.listDatabases()], "catalog_name string, schema_name string")


def split_statements(script: str) -> list[str]:
    """Statements of a script: semicolons outside quotes, dollar quotes and comments end them."""
    token = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\$(\w*)\$.*?\$\1\$|;|[^;'\"$/-]+|.", re.S)
    out, now = [], ""
    for m in token.finditer(script):
        if m[0] == ";":
            out.append(now.strip())
            now = ""
        elif not m[0].startswith(("--", "/*")):
            now += m[0]
    return [s for s in [*out, now.strip()] if s]


def run_script(spark: SparkSession, script: str, run=None) -> list[DataFrame]:
    """RUNSCRIPT: each statement in order, by Spark or by another runner of statements."""
    return [(run or spark.sql)(s) for s in split_statements(script)]


def bind(text: str, values: list) -> tuple[str, dict]:
    """Positional ``?``, ``?1`` and ``$1`` markers as Spark's named ones; values never become text."""
    count = 0

    def marker(m: re.Match) -> str:
        nonlocal count
        if not (m[1] or m[2]):
            return m[0]
        if m[1] == "?":
            count += 1
            return f":p{count}"
        return f":p{m[2] or m[1][1:]}"

    out = re.sub(r"'(?:[^']|'')*'|(\?\d*)|\$(\d+)", marker, text)
    return out, {f"p{k}": v for k, v in enumerate(values, 1)}


def with_row_cap(df: DataFrame, most: int) -> DataFrame:
    """The result, or an error if it has more rows than a caller may hold: one row over is looked for."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"the result has more than {most} rows")
    return df


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """DISTINCT ON: the first row of each key in an order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
