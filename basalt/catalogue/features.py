"""Queries over stateful features: lake and mutable tables, queues, caches, streams, graphs, routines.

Each works on a table of its own in a temporary folder (or ``spark.checkpoint.dir``) and returns what a
user would read from it.
"""

from __future__ import annotations

import datetime
import decimal
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.functions.fulltext import inverted_index, script_words, search_index
from basalt.operators.cursors import Cursor
from basalt.operators.recursive import recursive, shared_folder
from basalt.operators.relational import many_to_many, range_join, salted_distinct_count
from basalt.plans import statistics as stats
from basalt.plans.dialect import Database
from basalt.plans.graph import Graph
from basalt.plans.routines import Routines
from basalt.sources import tables
from basalt.sources.lake import LakeTable
from basalt.sources.mutable import ForeignKey, MutableTable, Transaction
from basalt.sources.queues import CacheTable, Consumer, QueueTable
from basalt.streaming import events as streams

_ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "orders")


def _lake(spark: SparkSession, sf_dir: str, by: list[str] = ()) -> LakeTable:
    """Orders in two commits: up to key 500, and the rest."""
    lake = LakeTable.create(spark, _folder(spark), _ORDERS, by)
    lake.append(_orders(spark, sf_dir).filter("o_orderkey <= 500"))
    lake.append(_orders(spark, sf_dir).filter("o_orderkey > 500"))
    return lake


def lake_append_read(spark, sf_dir):
    return _lake(spark, sf_dir).read().select("o_orderkey", "o_orderstatus", "o_totalprice")


def lake_time_travel(spark, sf_dir):
    return _lake(spark, sf_dir).read(snapshot_id=1).select("o_orderkey")


def lake_partition_prune(spark, sf_dir):
    lake = _lake(spark, sf_dir, ["o_orderstatus", "year(o_orderdate)"])
    return lake.read(where={"o_orderstatus": ("=", "F"), "o_totalprice": (">", 100000)}).select("o_orderkey", "o_totalprice")


def lake_position_delete(spark, sf_dir):
    lake = _lake(spark, sf_dir, ["bucket(4, o_custkey)"])
    lake.delete_where("o_orderpriority LIKE '1%'")
    return lake.read().select("o_orderkey", "o_orderpriority")


def lake_compact(spark, sf_dir):
    lake = _lake(spark, sf_dir, ["truncate(1, o_orderpriority)"])
    lake.delete_where("o_orderstatus = 'P'")
    lake.compact()
    return lake.read().select("o_orderkey")


def lake_snapshots(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    lake.delete_where("o_orderkey < 10")
    return lake.snapshots().select("snapshot_id", "parent_snapshot_id", "operation", "added_records", "total_records")


def lake_files(spark, sf_dir):
    files = _lake(spark, sf_dir, ["o_orderstatus"]).files()
    sizes = F.min(F.col("file_size_in_bytes") > 0).alias("sized")
    return files.groupBy("snapshot_id", "file_format").agg(F.sum("record_count").alias("record_count"), sizes)


def lake_partitions(spark, sf_dir):
    return _lake(spark, sf_dir, ["o_orderstatus"]).partitions().select("partition", "record_count")


def lake_compaction_report(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    lake.delete_where("o_orderstatus = 'P'")
    return lake.compact().select("compacted", (F.col("files_before") >= 2).alias("several_before"), "total_records", "delete_files_removed")


_TYPES = "k long, d double, b boolean, at timestamp_ntz, day date, big long, dec decimal(18,2), s string"


def lake_prune_types(spark, sf_dir):
    """Counts of rows found through pruned files, for columns of every type with NaN, nulls and longs beyond 2 ** 53."""
    orders = _orders(spark, sf_dir)
    key = F.col("o_orderkey")
    rows = orders.select(
        key.alias("k"), F.when(key % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("d"), F.when(key % 3 > 0, key % 2 == 0).alias("b"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("at"), F.col("o_orderdate").cast("date").alias("day"), (key + (1 << 60)).alias("big"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("dec"), F.when(key % 7 > 0, F.col("o_orderpriority")).alias("s"),
    )
    lake = LakeTable.create(spark, _folder(spark), _TYPES, ["bucket(4, k)"])
    for part in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        lake.append(orders.select("o_orderkey", "o_orderstatus").join(rows, key == F.col("k")).filter(part).select(*rows.columns))
    middle = datetime.datetime(1995, 6, 1)
    tests = {
        "nan_above": ("d", ">", 1e9), "equal": ("k", "=", 7), "true": ("b", "=", True), "not_true": ("b", "<>", True), "before": ("at", "<", middle), "since": ("day", ">=", middle.date()),
        "big": ("big", "<=", (1 << 60) + 1001), "decimal": ("dec", ">", decimal.Decimal("150000.25")), "text": ("s", ">=", "3"), "date_of_time": ("at", ">", middle.date()),
    }
    counts = [lake.read(where={c: (op, v)}).agg(F.lit(name).alias("test"), F.count("*").alias("n")) for name, (c, op, v) in tests.items()]
    return reduce(DataFrame.unionByName, counts)


def lake_backup_verify(spark, sf_dir):
    lake = _lake(spark, sf_dir, ["o_orderstatus"])
    lake.delete_where("o_orderpriority LIKE '1%'")
    copy = lake.backup(_folder(spark))
    return copy.read().agg(F.count("*").alias("n"), F.lit(copy.verify().count()).cast("long").alias("broken"))


def lake_join(spark, sf_dir):
    lake = _lake(spark, sf_dir)
    return lake.read().join(tables.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def lake_schema_evolution(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.add_column("note", "string")
    t.drop_column("c_mktsegment")
    t.update({"note": F.lit("poor")}, F.col("c_acctbal") < 0)
    return t.read().select("c_custkey", "note")


# mutable tables ----------------------------------------------------------------------------------

_CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _customers(spark: SparkSession, sf_dir: str, part: str = "true") -> MutableTable:
    """All customers, or those of some nations."""
    t = MutableTable.create(spark, _folder(spark), _CUSTOMER, primary_key=["c_custkey"])
    t.insert(tables.table(spark, sf_dir, "customer").filter(part))
    return t


#: What a table begins with, and what comes to it: some nations are in both, every customer is in one.
_FIRST, _COMING = "c_nationkey < 20", "c_nationkey >= 15"


def dml_insert_select(spark, sf_dir):
    t = _customers(spark, sf_dir, _FIRST)
    t.insert(tables.table(spark, sf_dir, "customer").filter(f"NOT ({_FIRST})").select("c_custkey", "c_name"))
    return t.read().select("c_custkey", "c_name", "c_nationkey")


def _overlap(spark, sf_dir):
    return tables.table(spark, sf_dir, "customer").filter(_COMING).withColumn("c_acctbal", F.lit(1.0))


def dml_upsert_nothing(spark, sf_dir):
    t = _customers(spark, sf_dir, _FIRST)
    t.upsert(_overlap(spark, sf_dir))
    return t.read().select("c_custkey", "c_acctbal")


def dml_upsert_update(spark, sf_dir):
    t = _customers(spark, sf_dir, _FIRST)
    t.upsert(_overlap(spark, sf_dir), update={"c_acctbal": F.col("old.c_acctbal") + F.col("excluded.c_acctbal")}, where=F.col("old.c_nationkey") > 16)
    return t.read().select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


def dml_update(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.update({"c_nationkey": F.col("c_nationkey") + 100, "c_name": F.concat(F.col("c_name"), F.col("c_nationkey").cast("string"))}, F.col("c_acctbal") > 0)
    return t.read().select("c_custkey", "c_nationkey", "c_name")


def dml_update_from(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.update({"c_mktsegment": F.col("s.n_name")}, source=tables.table(spark, sf_dir, "nation").filter("n_regionkey = 1"), on=F.col("t.c_nationkey") == F.col("s.n_nationkey"))
    return t.read().select("c_custkey", "c_mktsegment")


def dml_delete(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.delete(F.col("c_acctbal") < 0)
    return t.read().select("c_custkey")


def dml_delete_using(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.delete(using=tables.table(spark, sf_dir, "nation").filter("n_regionkey = 2"), on=F.col("t.c_nationkey") == F.col("s.n_nationkey"))
    return t.read().select("c_custkey")


def dml_merge(spark, sf_dir):
    t = _customers(spark, sf_dir, _FIRST)
    t.merge(
        _overlap(spark, sf_dir), F.col("t.c_custkey") == F.col("s.c_custkey"),
        matched=[(F.col("t.c_nationkey") < 17, "delete"), (None, {"c_acctbal": F.col("t.c_acctbal") + F.col("s.c_acctbal")})],
        not_matched=[(F.col("s.c_nationkey") > 21, {"c_custkey": F.col("s.c_custkey"), "c_acctbal": F.col("s.c_acctbal")})],
    )
    return t.read().select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


def dml_returning(spark, sf_dir):
    t = _customers(spark, sf_dir)
    done = t.update({"c_nationkey": F.lit(0)}, F.col("c_acctbal") < 0)
    return done.rows.select("c_custkey", "c_nationkey")


def dml_truncate(spark, sf_dir):
    t = _customers(spark, sf_dir)
    t.truncate()
    return t.read().agg(F.count("*").alias("n"))


def _with_orders(spark, sf_dir, on_delete):
    parent = _customers(spark, sf_dir)
    child = MutableTable.create(spark, _folder(spark), "o_orderkey long, o_custkey long", primary_key=["o_orderkey"], foreign_keys=[ForeignKey("o_custkey", parent, "c_custkey", on_delete)])
    child.insert(_orders(spark, sf_dir).select("o_orderkey", "o_custkey"))
    parent.delete(F.col("c_custkey") % 3 == 0)
    return child.read()


def fk_cascade(spark, sf_dir):
    return _with_orders(spark, sf_dir, "cascade")


def fk_set_null(spark, sf_dir):
    return _with_orders(spark, sf_dir, "set null")


def unique_guard(spark, sf_dir):
    t = _customers(spark, sf_dir)
    try:
        t.insert(tables.table(spark, sf_dir, "customer"))
        said = "inserted"
    except ValueError:
        said = "refused"
    return t.read().agg(F.count("*").alias("n"), F.lit(said).alias("said"))


def transaction_rollback(spark, sf_dir):
    """What the transaction did is undone; what another writer added meanwhile stays."""
    t = _customers(spark, sf_dir, _FIRST)
    other = MutableTable(spark, t.path, primary_key=["c_custkey"])
    try:
        with Transaction(t):
            t.delete(F.col("c_acctbal") > 0)
            other.insert(tables.table(spark, sf_dir, "customer").filter(f"NOT ({_FIRST})"))
            raise RuntimeError("stop")
    except RuntimeError:
        pass
    return t.read().agg(F.count("*").alias("n"))


# the same statements as SQL text -----------------------------------------------------------------


def _database(spark, sf_dir, part: str = "true") -> Database:
    """A database with customers (all, or some nations) in a table of its own, and views of the base tables."""
    db = Database(spark, _folder(spark))
    tables.register(spark, sf_dir, "customer", "orders", "nation", "part", "documents")
    db.execute("CREATE TABLE cust (c_custkey BIGINT PRIMARY KEY, c_name VARCHAR(40), c_nationkey INT, c_acctbal DOUBLE PRECISION, c_mktsegment TEXT)")
    db.execute(f"INSERT INTO cust SELECT * FROM customer WHERE {part}")
    return db


def sql_on_conflict(spark, sf_dir):
    db = _database(spark, sf_dir, _FIRST)
    db.execute(
        f"INSERT INTO cust SELECT c_custkey, c_name, c_nationkey, 1.0, c_mktsegment FROM customer WHERE {_COMING} "
        "ON CONFLICT (c_custkey) DO UPDATE SET c_acctbal = cust.c_acctbal + EXCLUDED.c_acctbal, c_name = concat(c_name, ', again') WHERE cust.c_nationkey > 16"
    )
    return db.execute("SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM cust")


def sql_on_conflict_nothing(spark, sf_dir):
    db = _database(spark, sf_dir, _FIRST)
    db.execute(f"INSERT INTO cust SELECT c_custkey, c_name, c_nationkey, 1.0, c_mktsegment FROM customer WHERE {_COMING} ON CONFLICT DO NOTHING")
    return db.execute("SELECT c_custkey, c_acctbal FROM cust")


def sql_on_duplicate_key(spark, sf_dir):
    db = _database(spark, sf_dir, _FIRST)
    db.execute(f"INSERT INTO cust (c_custkey, c_acctbal) SELECT c_custkey, 5.0 FROM customer WHERE {_COMING} ON DUPLICATE KEY UPDATE c_acctbal = VALUES(c_acctbal) * 2, c_nationkey = c_nationkey + 1")
    return db.execute("SELECT c_custkey, c_nationkey, c_acctbal FROM cust")


def sql_update_from(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.execute("UPDATE cust c SET c_mktsegment = concat(n.n_name, ', ', c_mktsegment) FROM nation n WHERE c.c_nationkey = n.n_nationkey AND n_regionkey = 1")
    return db.execute("SELECT c_custkey, c_mktsegment FROM cust")


def sql_delete_using(spark, sf_dir):
    db = _database(spark, sf_dir)
    gone = db.execute("DELETE FROM cust USING nation n WHERE cust.c_nationkey = n.n_nationkey AND n.n_regionkey = 2 RETURNING c_custkey AS gone")
    return gone.join(db.execute("SELECT c_custkey FROM cust"), F.col("gone") == F.col("c_custkey"), "full")


def sql_merge(spark, sf_dir):
    db = _database(spark, sf_dir, _FIRST)
    db.execute(
        f"MERGE INTO cust AS t USING (SELECT c_custkey AS k, c_nationkey AS nk, 1.0D AS extra FROM customer WHERE {_COMING}) AS s ON t.c_custkey = s.k "
        "WHEN MATCHED AND t.c_nationkey < 17 THEN DELETE WHEN MATCHED THEN UPDATE SET c_acctbal = t.c_acctbal + s.extra "
        "WHEN NOT MATCHED AND s.nk > 21 THEN INSERT (c_custkey, c_acctbal) VALUES (s.k, s.extra)"
    )
    return db.execute("SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM cust")


def sql_foreign_key(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.execute("CREATE TABLE ord (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT REFERENCES cust(c_custkey) ON DELETE CASCADE)")
    db.execute("INSERT INTO ord SELECT o_orderkey, o_custkey FROM orders")
    db.execute("DELETE FROM cust WHERE c_custkey % 3 = 0")
    try:
        db.execute("INSERT INTO ord VALUES (-1, -1)")
    except ValueError:
        pass
    return db.execute("SELECT o_orderkey, o_custkey FROM ord")


def sql_foreign_key_restrict(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.execute("CREATE TABLE ord (o_orderkey BIGINT, o_custkey BIGINT, CONSTRAINT fk FOREIGN KEY (o_custkey) REFERENCES cust(c_custkey))")
    db.execute("INSERT INTO ord SELECT o_orderkey, o_custkey FROM orders")
    try:
        db.execute("DELETE FROM cust")
        said = "deleted"
    except ValueError:
        said = "refused"
    return db.execute(f"SELECT COUNT(*) AS n, '{said}' AS said FROM cust")


def sql_sequence(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.execute("CREATE SEQUENCE ids START WITH 100 INCREMENT BY 5")
    db.execute("CREATE TABLE numbered (id BIGINT PRIMARY KEY, k BIGINT)")
    db.execute("INSERT INTO numbered SELECT NEXTVAL('ids') AS id, c_custkey FROM cust")
    db.execute("INSERT INTO numbered VALUES (ids.NEXTVAL, -1)")
    return db.execute("SELECT COUNT(DISTINCT id) AS n, MIN(id) AS least, MAX(id) AS most, CAST(ids.CURRVAL AS BIGINT) AS now, MAX(CASE WHEN k < 0 THEN id END) AS last FROM numbered")


def sql_transaction(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.execute("BEGIN")
    db.execute("DELETE FROM cust WHERE c_acctbal > 0")
    db.execute("ROLLBACK")
    db.execute("BEGIN TRANSACTION")
    db.execute("UPDATE cust SET c_name = 'poor, a = b' WHERE c_acctbal < 0")
    db.execute("COMMIT")
    return db.execute("SELECT c_name = 'poor, a = b' AS poor, COUNT(*) AS n FROM cust GROUP BY 1")


def sql_information_schema(spark, sf_dir):
    db = _database(spark, sf_dir)
    return db.execute("SELECT c.table_name, column_name, data_type, is_nullable, columns_count, table_rows FROM information_schema.columns c JOIN information_schema.tables t ON c.table_name = t.table_name WHERE c.table_name = 'cust'")


def sql_pg_proc(spark, sf_dir):
    db = Database(spark, _folder(spark))
    db.execute("CREATE FUNCTION twice(x int) RETURNS int AS $$ BEGIN RETURN x * 2; END $$ LANGUAGE plpgsql")
    db.execute("CREATE PROCEDURE nothing() AS $$ BEGIN NULL; END $$")
    return db.execute("SELECT proname, prokind, pronargs, proargnames FROM pg_proc")


def sql_match(spark, sf_dir):
    return _database(spark, sf_dir).execute("SELECT doc_id, text MATCH 'THE er' AS hit FROM documents")


def sql_script_roundtrip(spark, sf_dir):
    db, path = _database(spark, sf_dir), _folder(spark)
    db.execute("CREATE TABLE ord (o_orderkey BIGINT PRIMARY KEY, o_custkey BIGINT REFERENCES cust(c_custkey) ON DELETE SET NULL)")
    db.execute("INSERT INTO ord SELECT o_orderkey, o_custkey FROM orders")
    db.execute(f"SCRIPT TO '{path}'")
    again = Database(spark, _folder(spark))
    again.execute(f"RUNSCRIPT FROM '{path}'")
    again.execute("DELETE FROM cust WHERE c_acctbal < 0")
    return again.execute("SELECT o_orderkey, o_custkey FROM ord")


def sql_backup_restore(spark, sf_dir):
    db, path = _database(spark, sf_dir), _folder(spark)
    db.execute(f"BACKUP DATABASE TO '{path}'")
    db.execute("DELETE FROM cust")
    broken = db.execute(f"RESTORE VERIFYONLY FROM '{path}'").count()
    db.execute(f"RESTORE DATABASE FROM '{path}'")
    return db.execute(f"SELECT c_custkey, c_acctbal, {broken} AS broken FROM cust")


def sql_external_table(spark, sf_dir):
    """A second database opens what the first has made, with its schema."""
    first, second, path = Database(spark, _folder(spark)), Database(spark, _folder(spark)), _folder(spark)
    tables.register(spark, sf_dir, "part")
    first.execute(f"CREATE ICEBERG TABLE own (p_partkey BIGINT, p_name VARCHAR(80), p_size INT) LOCATION '{path}' PARTITIONED BY (bucket(4, p_partkey), p_size)")
    first.execute("INSERT INTO own SELECT p_partkey, p_name, p_size FROM part")
    second.execute(f"CREATE EXTERNAL TABLE theirs LOCATION '{path}'")
    return second.execute("SELECT p_partkey, p_name, p_size, (SELECT COUNT(*) FROM iceberg_snapshots(theirs)) AS snapshots FROM theirs")


def sql_views(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.execute("CREATE VIEW rich AS SELECT c_custkey, c_nationkey FROM cust WHERE c_acctbal > 5000")
    return db.execute("SELECT c_nationkey, COUNT(*) AS n FROM rich GROUP BY c_nationkey")


def sql_show_columns(spark, sf_dir):
    return _database(spark, sf_dir).execute("SHOW COLUMNS FROM cust")


def sql_copy(spark, sf_dir):
    db, path = _database(spark, sf_dir), _folder(spark)
    db.execute(f"COPY (SELECT c_custkey, c_name FROM cust WHERE c_acctbal > 0) TO '{path}' WITH CSV HEADER DELIMITER ';'")
    db.execute("CREATE TABLE copied (c_custkey BIGINT PRIMARY KEY, c_name TEXT, note TEXT)")
    db.execute(f"COPY copied (c_custkey, c_name) FROM '{path}' WITH CSV HEADER DELIMITER ';'")
    return db.execute("SELECT * FROM copied")


def sql_alter_table(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.execute("ALTER TABLE cust ADD COLUMN note VARCHAR(10)")
    db.execute("ALTER TABLE cust DROP COLUMN c_mktsegment")
    db.execute("UPDATE cust SET note = 'poor' WHERE c_acctbal < 0")
    db.execute("ALTER TABLE cust RENAME TO clients")
    return db.execute("SELECT c_custkey, note FROM clients")


def sql_unique_index(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.execute("CREATE INDEX by_nation ON cust (c_nationkey)")
    said = []
    for statement in ("CREATE UNIQUE INDEX one ON cust (c_nationkey)", "CREATE UNIQUE INDEX two ON cust (c_name)", "INSERT INTO cust SELECT -c_custkey, c_name, 1, 1.0, 'x' FROM customer", "DROP INDEX two", "DROP SEQUENCE IF EXISTS none"):
        try:
            db.execute(statement)
            said.append("done")
        except ValueError:
            said.append("refused")
    return spark.createDataFrame([(" ".join(said),)], "said string")


def sql_routines(spark, sf_dir):
    """An anonymous block and a procedure that change a table, with variables bound in their SQL."""
    db = _database(spark, sf_dir)
    db.execute("DO $$ DECLARE least double := 0; BEGIN UPDATE cust SET c_nationkey = -1 WHERE c_acctbal < least; END $$")
    db.execute("CREATE PROCEDURE counted(nation int, OUT n long) AS $$ BEGIN SELECT count(*) INTO n FROM cust WHERE c_nationkey = nation; END $$")
    n = db.execute("CALL counted(-1)").first()["n"]
    db.execute("DROP PROCEDURE IF EXISTS counted")
    return db.execute(f"SELECT COUNT(*) AS rows, CAST({n} AS BIGINT) AS n FROM cust")


def sql_bound(spark, sf_dir):
    text, args = tables.bind("SELECT c_custkey, '?' AS mark FROM customer WHERE c_mktsegment = ? AND c_nationkey > $2", ["BUILDING", 10])
    return tables.sql(spark, sf_dir, text, args)


def sql_query_stats(spark, sf_dir):
    db = _database(spark, sf_dir)
    for k in (3, 4, 5):
        db.stats.run(spark, f"SELECT c_custkey FROM customer WHERE c_nationkey = {k}")
    return db.execute("SHOW QUERY STATS").select("query", "calls", "rows")


def sql_show_stats(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.execute("ANALYZE cust")
    return db.execute("SHOW STATS FOR cust").select("column_name", "row_count", F.col("distinct_values").cast("long").alias("distinct_values"))


def sql_explain(spark, sf_dir):
    lines = _database(spark, sf_dir).execute("EXPLAIN ANALYZE SELECT c_custkey FROM cust WHERE c_acctbal > 0")
    return lines.filter("plan LIKE 'actual rows%'").select(F.regexp_extract("plan", r"(\d+)$", 1).cast("long").alias("n"))


def maintenance(spark, sf_dir):
    """A lake table with many files and deletes is compacted; one without is left alone."""
    lake = LakeTable.create(spark, _folder(spark), _ORDERS)
    for k in range(10):
        lake.append(_orders(spark, sf_dir).filter(F.col("o_orderkey") % 10 == k))
    lake.delete_where("o_orderstatus = 'F'")
    first, second = stats.maintain(lake), stats.maintain(lake)
    return lake.read().agg(F.count("*").alias("n"), F.lit(first is not None).alias("first"), F.lit(second is not None).alias("second"))


def read_only(spark, sf_dir):
    db = _database(spark, sf_dir)
    db.read_only = True
    try:
        db.execute("DELETE FROM cust")
        said = "deleted"
    except PermissionError:
        said = "refused"
    return db.execute(f"SELECT COUNT(*) AS n, '{said}' AS said FROM cust")


def session_values(spark, sf_dir):
    """Times and session values, checked against each other: what they are changes."""
    db = Database(spark, _folder(spark))
    db.execute("SET MODE ORACLE")
    db.execute("SET max_materialized_rows = 5")
    db.execute("SET statement_timeout = 600000")
    try:
        db.execute("SELECT id FROM range(6)")
        capped = False
    except ValueError:
        capped = True
    out = db.execute("SELECT CURRENT_MODE AS mode, SYSDATE = current_timestamp() AS now, current_date() = CAST(SYSDATE AS DATE) AS today, length(version()) > 0 AS version, current_database() AS db FROM SYSIBM.SYSDUMMY1")
    return out.withColumn("capped", F.lit(capped))


def first_of_group(spark, sf_dir):
    """A column that isn't grouped gives a value of the group; where it is one value only, that one."""
    return tables.sql(spark, sf_dir, "SELECT o_custkey, any_value(c_name) AS c_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")


# queues and caches -------------------------------------------------------------------------------


def _queue(spark, sf_dir, **rules) -> QueueTable:
    q = QueueTable.create(spark, _folder(spark), "event_id long, payload string", **rules)
    rows = tables.table(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload"), "ts", "event_type")
    at = F.col("ts").cast("timestamp")
    for part in ("event_type IN ('view', 'click')", "event_type NOT IN ('view', 'click')"):
        q.send(rows.filter(part).drop("event_type"), order=["event_id"], at=at)
    return q


def queue_receive(spark, sf_dir):
    consumer = Consumer(_queue(spark, sf_dir), "a")
    consumer.receive(40)
    return consumer.receive(25).select("_offset", "event_id")


def queue_seek_ts(spark, sf_dir):
    q = _queue(spark, sf_dir)
    consumer = Consumer(q, "a")
    middle = q.read("_offset = 100").first()["_timestamp"]
    consumer.seek_to_timestamp(middle)
    return q.read(f"_offset >= {consumer.position}").agg(F.min("_offset").alias("first_offset"), F.count("*").alias("n"))


def queue_groups(spark, sf_dir):
    q = _queue(spark, sf_dir)
    a, b = Consumer(q, "a"), Consumer(q, "b", auto=False)
    a.receive(30)
    b.receive(10)
    again_a, again_b = Consumer(q, "a"), Consumer(q, "b")
    return spark.createDataFrame([("a", again_a.position), ("b", again_b.position)], "consumer string, position long")


def queue_retention_age(spark, sf_dir):
    q = _queue(spark, sf_dir, retention_time="5 DAYS")
    last = q.read().agg(F.max(F.unix_millis("_timestamp"))).first()[0]
    q.purge(now_ms=last)
    return q.read().agg(F.min("_offset").alias("first_offset"), F.count("*").alias("n"))


def queue_retention_bytes(spark, sf_dir):
    q = _queue(spark, sf_dir, max_bytes="8 KB")
    q.purge()
    return q.read().agg(F.min("_offset").alias("first_offset"), F.count("*").alias("n"))


def queue_ids(spark, sf_dir):
    return _queue(spark, sf_dir).read().select("_offset", F.substring_index(F.substring_index("_msg_id", "-", -2), "-", 1).cast("long").alias("in_id"), "event_id")


def queue_scan(spark, sf_dir):
    """Ranges of offsets only; anything else about the messages, and any change of them, is refused."""
    q = _queue(spark, sf_dir)
    refused = 0
    for attempt in (lambda: q.read("payload = 'x'"), lambda: q.update({}), lambda: q.delete(), lambda: q.truncate(), lambda: q.create_index("payload")):
        try:
            attempt()
        except ValueError:
            refused += 1
    return q.read("_offset >= 100 AND _offset < 300").select("_offset", "event_id", F.lit(refused).alias("refused"))


def queue_outbox(spark, sf_dir):
    """A queue and a table in one transaction: both changes, or neither."""
    t, q = _customers(spark, sf_dir, _FIRST), QueueTable.create(spark, _folder(spark), "c_custkey long, props string")
    rows = tables.table(spark, sf_dir, "customer").filter(f"NOT ({_FIRST})")
    told = rows.select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"))).alias("props"))
    for fails in (True, False):
        try:
            with Transaction(t, q):
                t.insert(rows)
                q.send(told, order=["c_custkey"], correlation_id=F.col("c_custkey").cast("string"))
                if fails:
                    raise RuntimeError("stop")
        except RuntimeError:
            pass
    messages = q.read().select(F.col("c_custkey").alias("k"), F.col("_correlation_id").alias("correlation"), F.get_json_object("props", "$.name").alias("name"))
    return t.read().join(messages, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", "correlation", "name")


def _cache(spark, sf_dir) -> CacheTable:
    target = _customers(spark, sf_dir)
    cache = CacheTable.create(spark, _folder(spark), _CUSTOMER, ["c_custkey"], ttl="10s", target=target, mode="both")
    cache.clock.append(1_000_000)
    rows = tables.table(spark, sf_dir, "customer").withColumn("c_acctbal", F.lit(1.0))
    cache.insert(rows.filter("c_nationkey < 10"))
    cache.clock.append(1_006_000)
    cache.insert(rows.filter("NOT (c_nationkey < 10)"))
    return cache


def cache_ttl(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    cache.clock.append(1_012_000)
    return cache.read().select("c_custkey")


def cache_touch(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    cache.touch(F.col("c_custkey") % 5 == 0, "1 MINUTE")
    cache.clock.append(1_012_000)
    return cache.read().select("c_custkey")


def cache_flush(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    cache.clock.append(1_012_000)
    cache.flush()
    return cache.target.read().select("c_custkey", "c_acctbal")


def cache_write_behind(spark, sf_dir):
    """The background flush writes to the target what the cache holds, without being asked."""
    target = _customers(spark, sf_dir, _FIRST)
    cache = CacheTable.create(spark, _folder(spark), _CUSTOMER, ["c_custkey"], target=target)
    cache.insert(_overlap(spark, sf_dir))
    thread = cache.write_behind("50 MS")
    while not thread.flushes and len(thread.errors) < 5:
        time.sleep(0.05)
    thread.stop()
    return target.read().select("c_custkey", "c_acctbal")


def cache_purge(spark, sf_dir):
    cache = _cache(spark, sf_dir)
    cache.clock.append(1_012_000)
    gone = cache.purge_expired()
    return cache.table.read().agg(F.count("*").alias("left"), F.lit(gone).cast("long").alias("gone"))


# streams -----------------------------------------------------------------------------------------


def stream_tumbling(spark, sf_dir):
    return streams.run_to_table(streams.tumbling(streams.event_stream(spark, sf_dir)), "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_sliding(spark, sf_dir):
    return streams.run_to_table(streams.sliding(streams.event_stream(spark, sf_dir)), "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_session(spark, sf_dir):
    out = streams.run_to_table(streams.sessions(streams.event_stream(spark, sf_dir)), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


def stream_dedup(spark, sf_dir):
    made = streams.deduplicate(streams.event_stream(spark, sf_dir, "3650 days").select("ts", "event_type"), "event_type")
    return streams.run_to_table(made).select("event_type")


# graphs ------------------------------------------------------------------------------------------


def _graph(spark, sf_dir) -> Graph:
    """Customers, orders and parts; customers place orders, orders contain parts."""
    c, o, lines, p = (tables.table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "part"))
    # ids of the three kinds of nodes, and of the two of edges, never meet, however large the keys are
    own = lambda key, kind: key * 3 + kind
    node = lambda df, key, kind, label, **props: df.select(own(F.col(key), kind).alias("id"), F.array(F.lit(label)).alias("labels"), F.col(key).alias("key"), *[v.alias(k) for k, v in props.items()])
    nodes = [
        node(c, "c_custkey", 0, "Customer", name=F.col("c_name"), balance=F.col("c_acctbal")),
        node(o, "o_orderkey", 1, "Order", price=F.col("o_totalprice"), status=F.col("o_orderstatus")),
        node(p, "p_partkey", 2, "Part", name=F.col("p_name"), size=F.col("p_size")),
    ]
    key, customer, order, part = F.col("o_orderkey"), own(F.col("o_custkey"), 0), own(F.col("l_orderkey"), 1), own(F.col("l_partkey"), 2)
    placed = o.select((key * 2).alias("id"), customer.alias("src_id"), own(key, 1).alias("dst_id"), F.lit("PLACED").alias("type"))
    holds = lines.select(((F.col("l_orderkey") * 1000 + F.col("l_linenumber")) * 2 + 1).alias("id"), order.alias("src_id"), part.alias("dst_id"), F.lit("CONTAINS").alias("type"), F.col("l_quantity").alias("quantity"))
    return Graph(spark, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), nodes), placed.unionByName(holds, allowMissingColumns=True), "shop")


def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir).cypher("MATCH (c:customer) WHERE c.balance > 5000 RETURN c.key AS key, c.name AS name")


def graph_1hop(spark, sf_dir):
    return _graph(spark, sf_dir).cypher("MATCH (c:Customer)-[r:PLACED]->(o:Order {status: 'F'}) RETURN c.key AS customer, o.key AS order_key, type(r) AS kind")


def graph_2hop(spark, sf_dir):
    return _graph(spark, sf_dir).cypher("MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE p.size < 10 AND l.quantity > 20 RETURN DISTINCT c.key AS customer, p.key AS part")


def graph_var_length(spark, sf_dir):
    return _graph(spark, sf_dir).cypher("MATCH (c:Customer {key: $k})-[*1..2]->(x) RETURN labels(x) AS labels, count(*) AS n", {"k": 4}).select(F.element_at("labels", 1).alias("label"), "n")


def graph_shortest(spark, sf_dir):
    return _graph(spark, sf_dir).cypher("MATCH p = shortestPath((c:Customer)-[*]-(d:Customer {key: 7})) RETURN c.key AS customer, length(p) AS hops")


def graph_optional(spark, sf_dir):
    return _graph(spark, sf_dir).cypher("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.price > 300000 RETURN c.key AS customer, o.key AS order_key")


def graph_agg(spark, sf_dir):
    return _graph(spark, sf_dir).cypher("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.key AS customer, count(o) AS n, max(o.price) AS top ORDER BY n DESC, customer LIMIT 10")


def graph_merge(spark, sf_dir):
    g = _graph(spark, sf_dir)
    g.cypher("MERGE (c:Customer {key: 3}) ON MATCH SET c.name = 'known'")
    g.cypher("MERGE (c:Customer {key: -1}) ON CREATE SET c.name = 'new'")
    g.cypher("MATCH (a:Customer {key: 3}), (b:Customer {key: -1}) CREATE (a)-[:KNOWS {since: 2020}]->(b)")
    return g.cypher("MATCH (a:Customer)-[k:KNOWS]->(b:Customer) RETURN a.name AS a, b.name AS b, k.since AS since")


def graph_delete(spark, sf_dir):
    g = _graph(spark, sf_dir)
    g.cypher("MATCH (o:Order) WHERE o.status = 'F' DETACH DELETE o")
    return g.cypher("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN o.status AS status, count(*) AS n")


def graph_sql_join(spark, sf_dir):
    db = Database(spark, _folder(spark))
    db.graphs["shop"] = _graph(spark, sf_dir)
    tables.register(spark, sf_dir, "nation", "customer")
    return db.execute("SELECT n_name, COUNT(*) AS n FROM CYPHER('shop', 'MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.key, o.key') AS g(ck, ok) JOIN customer ON ck = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")


def graph_path_functions(spark, sf_dir):
    """Parts of a path, as a table function gives them to SQL: lists as JSON."""
    db = Database(spark, _folder(spark))
    db.graphs["shop"] = _graph(spark, sf_dir)
    text = "SELECT customer, size(from_json(ns, 'array<string>')) AS nodes, size(from_json(es, 'array<string>')) AS edges, hops FROM CYPHER('shop', 'MATCH p = (c:Customer)-[:PLACED]->(o:Order {status: ''P''}) RETURN c.key, nodes(p), relationships(p), length(p)') AS g(customer, ns, es, hops)"
    return db.execute(text)


def graph_counters(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return g.cypher("MATCH (c:Customer) WHERE c.balance < 0 SET c.name = 'poor'").select("nodes_created", "properties_set")


def graph_virtual_tables(spark, sf_dir):
    g = _graph(spark, sf_dir)
    g.register()
    return spark.sql("SELECT labels[0] AS label, COUNT(*) AS n, COUNT(get_json_object(properties, '$.price')) AS priced FROM graph_shop_nodes GROUP BY labels[0]")


# recursion, routines, administration ---------------------------------------------------------------


def json_cast(spark, sf_dir):
    return tables.sql(spark, sf_dir, "SELECT event_id, variant_get(parse_json(props), '$.k', 'bigint') AS k, schema_of_variant(parse_json(props)) LIKE 'OBJECT<%' AS object, array(event_id, user_id)[1] AS second FROM events")


def cte_recursive_distinct(spark, sf_dir):
    """Numbers reached by k -> (7 k + 3) mod 50 from the regions: a graph with cycles."""
    start = tables.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"))
    return recursive(start, lambda w: w.select(((F.col("k") * 7 + 3) % 50).alias("k")))


def udf_scalar(spark, sf_dir):
    Routines(spark).create("CREATE OR REPLACE FUNCTION price_with_tax(x double, rate double) RETURNS double AS $$ BEGIN RETURN x * (1 + rate); END $$ LANGUAGE plpgsql")
    return tables.sql(spark, sf_dir, "SELECT p_partkey, round(price_with_tax(p_retailprice, 0.1), 2) AS v FROM part")


def routine_loop(spark, sf_dir):
    r = Routines(spark)
    r.create("CREATE FUNCTION triangle(n int) RETURNS int AS $$ DECLARE s int := 0; BEGIN FOR i IN 1..n LOOP CONTINUE WHEN i % 2 = 0; s := s + i; END LOOP; RETURN s; END $$")
    return spark.createDataFrame([(n, r.call("triangle", n)) for n in (1, 10, 99)], "n long, s long")


def routine_exception(spark, sf_dir):
    r = Routines(spark)
    r.create("CREATE FUNCTION safe(n int) RETURNS string AS $$ DECLARE m string; BEGIN IF n < 0 THEN RAISE EXCEPTION 'negative %', n; END IF; RETURN 'ok'; EXCEPTION WHEN OTHERS THEN RETURN 'caught'; END $$")
    return spark.createDataFrame([(n, r.call("safe", n)) for n in (5, -5)], "n long, said string")


def routine_sql(spark, sf_dir):
    tables.register(spark, sf_dir, "part")
    r = Routines(spark)
    r.create("CREATE PROCEDURE sized(least int, OUT n long, OUT top double) AS $$ BEGIN SELECT count(*), max(p_retailprice) INTO n, top FROM part WHERE p_size >= least; END $$")
    out = r.call("sized", 40)
    return spark.createDataFrame([(out["n"], out["top"])], "n long, top double")


def table_udf(spark, sf_dir):
    tables.register(spark, sf_dir, "part")
    Routines(spark).table_function("parts_of_size", "wanted int", "p_partkey long, p_name string", "SELECT p_partkey, p_name FROM part WHERE p_size = wanted")
    return spark.sql("SELECT * FROM parts_of_size(7)")


def analyze_stats(spark, sf_dir):
    found = stats.analyze(_orders(spark, sf_dir).select("o_orderstatus", "o_orderpriority", "o_custkey"), "orders")
    return found.select("column_name", "row_count", F.col("distinct_values").cast("long").alias("distinct_values"), "null_fraction")


def copy_csv_roundtrip(spark, sf_dir):
    path = _folder(spark)
    part = tables.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    tables.copy_to_csv(part, path, delimiter="|")
    return tables.copy_from_csv(spark, path, part.schema, delimiter="|")


def system_tables(spark, sf_dir):
    tables.register(spark, sf_dir, "nation")
    return tables.information_columns(spark, "nation").select("column_name", F.col("ordinal_position").cast("long").alias("ordinal_position"))


def cursor_fetch(spark, sf_dir):
    cursor = Cursor(_orders(spark, sf_dir).select("o_orderkey"), "o_orderkey")
    cursor.absolute(10)
    return cursor.forward(5).unionAll(cursor.backward(2)).unionAll(cursor.last())


def script_run(spark, sf_dir):
    db = Database(spark, _folder(spark))
    script = """
    CREATE TABLE players (id INT PRIMARY KEY, name VARCHAR(50), score INT);
    INSERT INTO players VALUES (1, 'Ann; a', 10), (2, 'Bob', 20), (3, 'Cy', 30);
    UPDATE players SET score = score + 1 WHERE id >= 2;
    DELETE FROM players WHERE name = 'Cy'
    """
    tables.run_script(spark, script, db.execute)
    return db.execute("SELECT id, name, score FROM players")


def dialect_modes(spark, sf_dir):
    db = Database(spark, _folder(spark))
    tables.register(spark, sf_dir, "part")
    db.execute("SET MODE MSSQLSERVER")
    return db.execute("SELECT TOP 5 [p_partkey], LEN(p_name) AS n FROM part WHERE p_brand ~ '^Brand' ORDER BY p_partkey")


def join_self(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer")
    group = ["c_nationkey", "c_mktsegment"]
    a, b = c.select(*group, F.col("c_custkey").alias("a")), c.select(*group, F.col("c_custkey").alias("b"))
    return many_to_many(a, b, group, "b").filter("a < b").select("a", "b")


def join_null_keys(spark, sf_dir):
    key = lambda c: F.nullif(F.col(c), F.lit(3)).alias("k")
    a = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), key("c_nationkey"))
    b = tables.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), key("s_nationkey"))
    return many_to_many(a, b, ["k"], "b", "left").select("a", "b")


def join_range(spark, sf_dir):
    bands = spark.createDataFrame([(k, k * 1000.0, k * 1000.0 + 1500) for k in range(-1, 10)], "band int, low double, high double")
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return range_join(c, bands, "c_acctbal", "low", "high", 1500.0).select("c_custkey", "band")


def agg_distinct_salted(spark, sf_dir):
    return salted_distinct_count(_orders(spark, sf_dir), "o_orderpriority", "o_custkey", "n")


def distinct_on(spark, sf_dir):
    return tables.first_per_key(_orders(spark, sf_dir), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey")


def fts_inverted_index(spark, sf_dir):
    index = inverted_index(tables.table(spark, sf_dir, "documents"), "doc_id", "text", script_words)
    return search_index(index, "doc_id", ["the", "of"])


_NAMES = """lake_append_read lake_time_travel lake_partition_prune lake_position_delete lake_compact lake_snapshots lake_files lake_partitions
lake_compaction_report lake_prune_types lake_backup_verify lake_join lake_schema_evolution dml_insert_select dml_upsert_nothing dml_upsert_update dml_update
dml_update_from dml_delete dml_delete_using dml_merge dml_returning dml_truncate fk_cascade fk_set_null unique_guard transaction_rollback
sql_on_conflict sql_on_conflict_nothing sql_on_duplicate_key sql_update_from sql_delete_using sql_merge sql_foreign_key sql_foreign_key_restrict
sql_sequence sql_transaction sql_information_schema sql_pg_proc sql_match sql_script_roundtrip sql_backup_restore sql_external_table sql_views
sql_show_columns sql_copy sql_alter_table sql_unique_index sql_routines sql_bound sql_query_stats sql_show_stats sql_explain maintenance read_only session_values
first_of_group json_cast queue_receive queue_seek_ts queue_groups queue_retention_age
queue_retention_bytes queue_ids queue_scan queue_outbox cache_ttl cache_touch cache_flush cache_write_behind cache_purge stream_tumbling stream_sliding stream_session stream_dedup
graph_nodes graph_1hop graph_2hop graph_var_length graph_shortest graph_optional graph_agg graph_merge graph_delete graph_sql_join graph_path_functions
graph_counters graph_virtual_tables cte_recursive_distinct udf_scalar routine_loop routine_exception routine_sql table_udf analyze_stats
copy_csv_roundtrip system_tables cursor_fetch script_run dialect_modes join_self join_null_keys join_range agg_distinct_salted distinct_on fts_inverted_index""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_EV = "(SELECT event_id, props, ts, row_number() OVER (ORDER BY CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END, event_id) - 1 AS off FROM events)"
_TUMBLE = "SELECT date_trunc('day', ts) AS window_start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"
_SLIDE = "SELECT time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * k AS window_start, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1, 2"
_SESSION = """
WITH a AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS n FROM b GROUP BY user_id, s"""
ORACLES = {
    "lake_append_read": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "lake_time_travel": "SELECT o_orderkey FROM orders WHERE o_orderkey <= 500",
    "lake_partition_prune": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "lake_position_delete": "SELECT o_orderkey, o_orderpriority FROM orders WHERE NOT o_orderpriority LIKE '1%'",
    "lake_compact": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'",
    "lake_snapshots": "SELECT 0::BIGINT AS snapshot_id, NULL::BIGINT AS parent_snapshot_id, 'create' AS operation, 0::BIGINT AS added_records, 0::BIGINT AS total_records UNION ALL SELECT 1, 0, 'append', COUNT(*), COUNT(*) FROM orders WHERE o_orderkey <= 500 UNION ALL SELECT 2, 1, 'append', COUNT(*) FILTER (o_orderkey > 500), COUNT(*) FROM orders UNION ALL SELECT 3, 2, 'delete', 0, COUNT(*) FROM orders WHERE NOT o_orderkey < 10",
    "lake_files": "SELECT CASE WHEN o_orderkey <= 500 THEN 1 ELSE 2 END::BIGINT AS snapshot_id, 'PARQUET' AS file_format, COUNT(*) AS record_count, true AS sized FROM orders GROUP BY 1",
    "lake_join": "SELECT c_mktsegment, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "lake_schema_evolution": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'poor' END AS note FROM customer",
    "dml_insert_select": "SELECT c_custkey, c_name, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS c_nationkey FROM customer",
    "dml_upsert_nothing": "SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_acctbal ELSE 1.0 END AS c_acctbal FROM customer",
    "dml_upsert_update": "SELECT c_custkey, round(CASE WHEN c_nationkey BETWEEN 17 AND 19 THEN c_acctbal + 1 WHEN c_nationkey < 20 THEN c_acctbal ELSE 1.0 END, 2) AS c_acctbal FROM customer",
    "dml_update": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_acctbal > 0 THEN c_name || c_nationkey ELSE c_name END AS c_name FROM customer",
    "dml_update_from": "SELECT c_custkey, coalesce(n_name, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey",
    "dml_delete": "SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0",
    "dml_delete_using": "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "dml_merge": "SELECT c_custkey, round(CASE WHEN c_nationkey < 15 THEN c_acctbal WHEN c_nationkey < 20 THEN c_acctbal + 1 ELSE 1.0 END, 2) AS c_acctbal FROM customer WHERE c_nationkey NOT IN (15, 16, 20, 21)",
    "dml_returning": "SELECT c_custkey, 0 AS c_nationkey FROM customer WHERE c_acctbal < 0",
    "dml_truncate": "SELECT 0::BIGINT AS n",
    "fk_cascade": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 3 <> 0",
    "fk_set_null": "SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS o_custkey FROM orders",
    "unique_guard": "SELECT COUNT(*) AS n, 'refused' AS said FROM customer",
    "transaction_rollback": "SELECT COUNT(*) AS n FROM customer",
    "queue_receive": f"SELECT off AS _offset, event_id FROM {_EV} WHERE off BETWEEN 40 AND 64",
    "queue_seek_ts": f"SELECT min(off) AS first_offset, (SELECT COUNT(*) FROM {_EV}) - min(off) AS n FROM {_EV} WHERE ts >= (SELECT ts FROM {_EV} WHERE off = 100)",
    "queue_groups": "SELECT 'a' AS consumer, 30::BIGINT AS position UNION ALL SELECT 'b', 0",
    "queue_retention_age": f"SELECT min(off) AS first_offset, (SELECT COUNT(*) FROM {_EV}) - min(off) AS n FROM {_EV} WHERE ts >= (SELECT max(ts) FROM {_EV}) - INTERVAL 5 DAY",
    "queue_retention_bytes": f"SELECT min(off) AS first_offset, COUNT(*) AS n FROM (SELECT off, sum(64 + length(CAST(event_id AS VARCHAR)) + strlen(props)) OVER (ORDER BY off DESC) AS s FROM {_EV}) WHERE s <= 8192",
    "queue_ids": f"SELECT off AS _offset, off AS in_id, event_id FROM {_EV}",
    "cache_ttl": "SELECT c_custkey FROM customer WHERE NOT c_nationkey < 10",
    "cache_touch": "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0 OR NOT c_nationkey < 10",
    "cache_flush": "SELECT c_custkey, 1.0::DOUBLE AS c_acctbal FROM customer WHERE NOT c_nationkey < 10",
    "cache_write_behind": "SELECT c_custkey, CASE WHEN c_nationkey < 15 THEN c_acctbal ELSE 1.0 END AS c_acctbal FROM customer",
    "cache_purge": "SELECT COUNT(*) FILTER (NOT c_nationkey < 10) AS left, COUNT(*) FILTER (c_nationkey < 10) AS gone FROM customer",
    "stream_tumbling": _TUMBLE,
    "stream_sliding": _SLIDE,
    "stream_session": _SESSION,
    "stream_dedup": "SELECT DISTINCT event_type FROM events",
    "graph_nodes": "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_acctbal > 5000",
    "graph_1hop": "SELECT o_custkey AS customer, o_orderkey AS order_key, 'PLACED' AS kind FROM orders WHERE o_orderstatus = 'F'",
    "graph_2hop": "SELECT DISTINCT o_custkey AS customer, p_partkey AS part FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size < 10 AND l_quantity > 20",
    "graph_var_length": "SELECT * FROM (SELECT 'Order' AS label, (SELECT COUNT(*) FROM orders WHERE o_custkey = 4) AS n UNION ALL SELECT 'Part', (SELECT COUNT(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = 4)) WHERE n > 0",
    "graph_optional": "SELECT c_custkey AS customer, o_orderkey AS order_key FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey",
    "graph_agg": "SELECT o_custkey AS customer, COUNT(*) AS n, MAX(o_totalprice) AS top FROM orders GROUP BY o_custkey ORDER BY n DESC, customer LIMIT 10",
    "graph_merge": "SELECT 'known' AS a, 'new' AS b, 2020 AS since",
    "graph_delete": "SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus",
    "graph_sql_join": "SELECT n_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "graph_virtual_tables": "SELECT 'Customer' AS label, (SELECT COUNT(*) FROM customer) AS n, 0::BIGINT AS priced UNION ALL SELECT 'Order', (SELECT COUNT(*) FROM orders), (SELECT COUNT(*) FROM orders) UNION ALL SELECT 'Part', (SELECT COUNT(*) FROM part), 0",
    "lake_partitions": "SELECT '{\"o_orderstatus\": \"' || o_orderstatus || '\"}' AS partition, COUNT(*) AS record_count FROM orders GROUP BY 1",
    "lake_compaction_report": "SELECT true AS compacted, true AS several_before, COUNT(*) AS total_records, 1::BIGINT AS delete_files_removed FROM orders WHERE o_orderstatus <> 'P'",
    "lake_backup_verify": "SELECT COUNT(*) AS n, 0::BIGINT AS broken FROM orders WHERE NOT o_orderpriority LIKE '1%'",
    "lake_prune_types": (
        "WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice END AS d, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 2 = 0 END AS b, o_orderdate AS moment, "
        "o_orderkey + 1152921504606846976 AS big, CAST(o_totalprice AS DECIMAL(18,2)) AS dec, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS s FROM orders) "
        "SELECT unnest(['nan_above', 'equal', 'true', 'not_true', 'before', 'since', 'big', 'decimal', 'text', 'date_of_time']) AS test, unnest([COUNT(*) FILTER (d > 1e9), COUNT(*) FILTER (k = 7), COUNT(*) FILTER (b), COUNT(*) FILTER (NOT b), "
        "COUNT(*) FILTER (moment < TIMESTAMP '1995-06-01'), COUNT(*) FILTER (moment >= TIMESTAMP '1995-06-01'), COUNT(*) FILTER (big <= 1152921504606847977), COUNT(*) FILTER (dec > 150000.25), COUNT(*) FILTER (s >= '3'), "
        "COUNT(*) FILTER (moment > TIMESTAMP '1995-06-01')]) AS n FROM r"
    ),
    "sql_on_conflict": "SELECT c_custkey, CASE WHEN c_nationkey BETWEEN 17 AND 19 THEN c_name || ', again' ELSE c_name END AS c_name, round(CASE WHEN c_nationkey BETWEEN 17 AND 19 THEN c_acctbal + 1 WHEN c_nationkey < 20 THEN c_acctbal ELSE 1.0 END, 2) AS c_acctbal FROM customer",
    "sql_on_conflict_nothing": "SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_acctbal ELSE 1.0 END AS c_acctbal FROM customer",
    "sql_on_duplicate_key": "SELECT c_custkey, CASE WHEN c_nationkey < 15 THEN c_nationkey WHEN c_nationkey < 20 THEN c_nationkey + 1 END AS c_nationkey, CASE WHEN c_nationkey < 15 THEN c_acctbal WHEN c_nationkey < 20 THEN 10.0 ELSE 5.0 END AS c_acctbal FROM customer",
    "sql_update_from": "SELECT c_custkey, CASE WHEN n_name IS NULL THEN c_mktsegment ELSE n_name || ', ' || c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey",
    "sql_delete_using": "SELECT CASE WHEN n_regionkey = 2 THEN c_custkey END AS gone, CASE WHEN n_regionkey <> 2 THEN c_custkey END AS c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "sql_merge": "SELECT c_custkey, round(CASE WHEN c_nationkey < 15 THEN c_acctbal WHEN c_nationkey < 20 THEN c_acctbal + 1 ELSE 1.0 END, 2) AS c_acctbal FROM customer WHERE c_nationkey NOT IN (15, 16, 20, 21)",
    "sql_foreign_key": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 3 <> 0",
    "sql_foreign_key_restrict": "SELECT COUNT(*) AS n, 'refused' AS said FROM customer",
    "sql_sequence": "SELECT COUNT(*) + 1 AS n, 100::BIGINT AS least, 100 + 5 * COUNT(*) AS most, 100 + 5 * COUNT(*) AS now, 100 + 5 * COUNT(*) AS last FROM customer",
    "sql_transaction": "SELECT c_acctbal < 0 AS poor, COUNT(*) AS n FROM customer GROUP BY 1",
    "sql_information_schema": "SELECT 'cust' AS table_name, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS column_name, unnest(['bigint', 'string', 'int', 'double', 'string']) AS data_type, unnest([false, true, true, true, true]) AS is_nullable, 5 AS columns_count, (SELECT COUNT(*) FROM customer) AS table_rows",
    "sql_pg_proc": "SELECT * FROM (VALUES ('twice', 'f', 1, 'x'), ('nothing', 'p', 0, '')) t(proname, prokind, pronargs, proargnames)",
    "sql_match": "SELECT doc_id, contains(t, 'th') AND contains(t, 'he') AND contains(t, 'ee') AND contains(t, 'er') AS hit FROM (SELECT doc_id, lower(regexp_replace(text, '[\\s!-/:-@\\[-`{-~]', '', 'g')) AS t FROM documents)",
    "sql_script_roundtrip": "SELECT o_orderkey, CASE WHEN NOT c_acctbal < 0 THEN o_custkey END AS o_custkey FROM orders JOIN customer ON o_custkey = c_custkey",
    "sql_backup_restore": "SELECT c_custkey, c_acctbal, 0 AS broken FROM customer",
    "sql_external_table": "SELECT p_partkey, p_name, p_size, 2::BIGINT AS snapshots FROM part",
    "sql_views": "SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey",
    "sql_show_columns": "SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS column_name, unnest(['bigint', 'string', 'int', 'double', 'string']) AS data_type, unnest([false, true, true, true, true]) AS is_nullable",
    "sql_copy": "SELECT c_custkey, c_name, NULL::VARCHAR AS note FROM customer WHERE c_acctbal > 0",
    "sql_alter_table": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'poor' END AS note FROM customer",
    "sql_unique_index": "SELECT 'refused done refused done done' AS said",
    "sql_routines": "SELECT COUNT(*) AS rows, COUNT(*) FILTER (c_acctbal < 0) AS n FROM customer",
    "sql_bound": "SELECT c_custkey, '?' AS mark FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey > 10",
    "sql_query_stats": "SELECT 'select c_custkey from customer where c_nationkey = ?' AS query, 3::BIGINT AS calls, COUNT(*) AS rows FROM customer WHERE c_nationkey IN (3, 4, 5)",
    "sql_show_stats": "SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS column_name, COUNT(*) AS row_count, unnest([COUNT(DISTINCT c_custkey), COUNT(DISTINCT c_name), COUNT(DISTINCT c_nationkey), COUNT(DISTINCT c_acctbal), COUNT(DISTINCT c_mktsegment)]) AS distinct_values FROM customer",
    "sql_explain": "SELECT COUNT(*) AS n FROM customer WHERE c_acctbal > 0",
    "maintenance": "SELECT COUNT(*) AS n, true AS first, false AS second FROM orders WHERE o_orderstatus <> 'F'",
    "read_only": "SELECT COUNT(*) AS n, 'refused' AS said FROM customer",
    "session_values": "SELECT 'ORACLE' AS mode, true AS now, true AS today, true AS version, 'default' AS db, true AS capped",
    "first_of_group": "SELECT o_custkey, min(c_name) AS c_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey",
    "json_cast": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_type(props) = 'OBJECT' AS object, user_id AS second FROM events",
    "queue_scan": f"SELECT off AS _offset, event_id, 5 AS refused FROM {_EV} WHERE off BETWEEN 100 AND 299",
    "queue_outbox": "SELECT c_custkey, CASE WHEN c_nationkey >= 20 THEN c_custkey::VARCHAR END AS correlation, CASE WHEN c_nationkey >= 20 THEN c_name END AS name FROM customer",
    "graph_path_functions": "SELECT o_custkey AS customer, 2 AS nodes, 1 AS edges, 1 AS hops FROM orders WHERE o_orderstatus = 'P'",
    "graph_counters": "SELECT 0::BIGINT AS nodes_created, COUNT(*) AS properties_set FROM customer WHERE c_acctbal < 0",
    "graph_shortest": (
        "WITH RECURSIVE e(a, b) AS (SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem), "
        "u(a, b) AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, hops) AS (SELECT 'c7', 0 UNION SELECT b, hops + 1 FROM r JOIN u ON node = a WHERE hops < 8) "
        "SELECT CAST(substr(node, 2) AS BIGINT) AS customer, min(hops) AS hops FROM r WHERE node LIKE 'c%' AND node <> 'c7' GROUP BY node"
    ),
    "cte_recursive_distinct": "WITH RECURSIVE r(k) AS (SELECT CAST(r_regionkey AS BIGINT) FROM region UNION SELECT (k * 7 + 3) % 50 FROM r) SELECT k FROM r",
    "udf_scalar": "SELECT p_partkey, round(p_retailprice * (1 + 0.1::DOUBLE), 2) AS v FROM part",
    "routine_loop": "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT), (10, 25), (99, 2500)) t(n, s)",
    "routine_exception": "SELECT * FROM (VALUES (5::BIGINT, 'ok'), (-5, 'caught')) t(n, said)",
    "routine_sql": "SELECT COUNT(*) AS n, MAX(p_retailprice) AS top FROM part WHERE p_size >= 40",
    "table_udf": "SELECT p_partkey, p_name FROM part WHERE p_size = 7",
    "analyze_stats": "SELECT * FROM (SELECT 'o_orderstatus' AS column_name, COUNT(*) AS row_count, COUNT(DISTINCT o_orderstatus) AS distinct_values, 0.0::DOUBLE AS null_fraction FROM orders UNION ALL SELECT 'o_orderpriority', COUNT(*), COUNT(DISTINCT o_orderpriority), 0 FROM orders UNION ALL SELECT 'o_custkey', COUNT(*), COUNT(DISTINCT o_custkey), 0 FROM orders)",
    "copy_csv_roundtrip": "SELECT p_partkey, p_name, p_size, p_retailprice FROM part",
    "system_tables": "SELECT * FROM (VALUES ('n_nationkey', 1::BIGINT), ('n_name', 2), ('n_regionkey', 3)) t(column_name, ordinal_position)",
    "cursor_fetch": "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, COUNT(*) OVER () AS n FROM orders) JOIN (VALUES (11), (12), (13), (14), (15), (14), (13), (-1)) v(p) ON r = CASE WHEN p < 0 THEN n ELSE p END",
    "script_run": "SELECT * FROM (VALUES (1, 'Ann; a', 10), (2, 'Bob', 21)) t(id, name, score)",
    "dialect_modes": "SELECT p_partkey, CAST(length(p_name) AS INT) AS n FROM part WHERE regexp_matches(p_brand, '^Brand') ORDER BY p_partkey LIMIT 5",
    "join_range": "SELECT c_custkey, CAST(band AS INT) AS band FROM customer JOIN (SELECT unnest(range(-1, 10)) AS band) ON c_acctbal BETWEEN band * 1000.0 AND band * 1000.0 + 1500",
    "agg_distinct_salted": "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderpriority",
    "distinct_on": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1",
    "fts_inverted_index": "SELECT doc_id FROM documents WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'the') AND list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'of')",
}
