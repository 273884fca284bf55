"""Lake, mutable, queue and cache tables; guards; properties of set operations and upserts."""

import datetime
import decimal
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basalt.operators.recursive import RecursionLimit, recursive
from basalt.plans.dialect import Database
from basalt.plans.text import assignments, bracketed, clauses, literal, qualify, split_top
from basalt.sources import tables
from basalt.sources.lake import CommitConflict, LakeTable
from basalt.sources.mutable import ConstraintError, ForeignKey, MutableTable, Sequence
from basalt.sources.queues import CacheTable, Consumer, OffsetTruncated, QueueTable, parse_bytes, parse_duration


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_lake_prunes_by_partition_and_range(spark, tmp_path):
    lake = LakeTable.create(spark, str(tmp_path / "t"), "id long, name string, category string, at timestamp", ["category", "year(at)", "bucket(4, id)", "truncate(2, name)"])
    rows = [(1, "Apple", "Fruit", "2024-05-10"), (2, "Banana", "Fruit", "2024-06-15"), (3, "Carrot", "Vegetable", "2025-01-20")]
    lake.append(spark.createDataFrame(rows, "id long, name string, category string, at string"))
    assert len(lake.pruned_files()) == 3
    assert len(lake.pruned_files({"category": ("=", "Vegetable")})) == 1
    assert len(lake.pruned_files({"id": (">", 2)})) == 1
    assert values(lake.read(where={"name": ("=", "Banana")}).select("id")) == [(2,)]


TYPED = "k long, d double, f float, b boolean, s string, t timestamp, n timestamp_ntz, day date, dec decimal(12,2), small int"


def typed_rows(rng, n):
    moment = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=rng.choice([0, 1, 500_000, rng.randrange(10**13)]))
    maybe = lambda v: None if rng.random() < 0.15 else v
    number = lambda: rng.choice([float("nan"), float("inf"), -0.0, 0.0, 5.0, rng.uniform(-10, 10)])
    return [
        (maybe(rng.choice([0, 5, (1 << 53) + 1, (1 << 62) + rng.randrange(4), -(1 << 63)])), maybe(number()), maybe(number()), maybe(rng.random() < 0.5), maybe(rng.choice(["", "a", "B", "é", "05", "5", "日本"])),
         maybe(moment()), maybe(moment()), maybe(moment().date()), maybe(decimal.Decimal(rng.randrange(-500, 500)) / 100), maybe(rng.randrange(-3, 9)))
        for _ in range(n)
    ]


@pytest.mark.parametrize("by", [[], ["bucket(3, k)", "b"], ["bucket(2, s)", "month(n)"]])
def test_pruned_reads_are_filtered_reads(spark, tmp_path, by):
    """Whatever the column's type, the operator and the value: files are left out only if no row of theirs would be found."""
    rng = random.Random(len(by))
    lake = LakeTable.create(spark, str(tmp_path / "t"), TYPED, by)
    for n in (1, 1, 2, 6):
        lake.append(spark.createDataFrame(typed_rows(rng, n), TYPED).coalesce(1))
    lake.append(spark.createDataFrame([(None,) * 10, (None,) * 10], TYPED).coalesce(1))
    every = lake.read()
    tests = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
    names = [f.name for f in lake.schema()]
    probes = [(c, v) for row in typed_rows(rng, 3) for c, v in zip(names, row, strict=True) if v is not None]
    probes += [("d", 5), ("d", float("nan")), ("k", 5.0), ("k", 4.5), ("k", decimal.Decimal(5)), ("n", datetime.date(2024, 1, 1)), ("day", datetime.datetime(2024, 1, 1, 12)), ("small", 1 << 40), ("k", None), ("dec", 1.25)]
    for k, (c, v) in enumerate(probes):
        for op in tests if k % 3 == 0 else ["=", rng.choice(["<", ">", "<>"])]:
            where = {c: (op, v)}
            assert lake.read(where=where).count() == every.filter(getattr(F.col(c), tests[op])(v)).count(), where
    assert len(lake.pruned_files({"small": (">", 100)})) == 0 and len(lake.pruned_files({"s": ("=", "\uffff")})) == 0


def test_commits_list_only_what_they_add(spark, tmp_path):
    lake = LakeTable.create(spark, str(tmp_path / "t"), "id long")
    for k in range(4):
        lake.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    assert [m["files"] for m in lake.current().manifests] == [1, 1, 1, 1] and lake.files().count() == 4
    assert [r["added_records"] for r in lake.snapshots().orderBy("snapshot_id").collect()] == [0, 10, 10, 10, 10]
    lake.delete_where("id < 15")
    assert lake.snapshots().orderBy(F.desc("snapshot_id")).first()["total_records"] == 25
    lake.compact()
    assert len(lake.current().manifests) == 1 and lake.verify().count() == 0
    import shutil

    shutil.rmtree(tmp_path / "t" / "data" / lake.files().first()["file_path"].split("/data/")[1].split("/")[0])
    assert lake.verify().count() >= 1


def test_a_writer_in_between_is_a_conflict(spark, tmp_path, monkeypatch):
    t = MutableTable.create(spark, str(tmp_path / "t"), "id long, v long", primary_key=["id"])
    other = MutableTable(spark, str(tmp_path / "t"), primary_key=["id"])
    check = MutableTable._check_unique

    def meanwhile(self, new, old):
        check(self, new, old)
        if self is t:
            other.insert(spark.createDataFrame([(1, 2)], "id long, v long"))

    monkeypatch.setattr(MutableTable, "_check_unique", meanwhile)
    with pytest.raises(CommitConflict):
        t.insert(spark.createDataFrame([(1, 1)], "id long, v long"))
    assert values(t.read()) == [(1, 2)]


def test_retention_keeps_the_next_offset(spark, tmp_path):
    q = QueueTable.create(spark, str(tmp_path / "q"), "payload string", retention_time="1 DAYS")
    q.send(spark.createDataFrame([("a",), ("b",)], "payload string"), at=F.lit("2020-01-01").cast("timestamp"))
    before = len(q.lake._numbers())
    assert q.purge() == 2 and len(q.lake._numbers()) == before + 1
    q.send(spark.createDataFrame([("c",)], "payload string"))
    assert [r["_offset"] for r in q.read().collect()] == [2]


def test_rows_that_become_dirty_meanwhile_stay_dirty(spark, tmp_path, monkeypatch):
    target = MutableTable.create(spark, str(tmp_path / "t"), "id long, v long", primary_key=["id"])
    cache = CacheTable.create(spark, str(tmp_path / "c"), "id long, v long", ["id"], target=target)
    row = lambda *r: spark.createDataFrame(list(r), "id long, v long")
    cache.insert(row((1, 1), (2, 2)))
    upsert = target.upsert

    def meanwhile(*args, **kwargs):
        out = upsert(*args, **kwargs)
        cache.insert(row((2, 20)))
        return out

    monkeypatch.setattr(target, "upsert", meanwhile)
    assert cache.flush()[0] == 2
    assert values(cache.read(system=True).filter("_dirty").select("id", "v")) == [(2, 20)]


def test_text_is_split_outside_quotes_and_brackets():
    assert split_top("a = 'x, y', b = f(1, 2), c") == ["a = 'x, y'", "b = f(1, 2)", "c"]
    assert assignments("t.a = 'x = y', b = CASE WHEN c = 1 THEN 'it''s' END") == {"a": "'x = y'", "b": "CASE WHEN c = 1 THEN 'it''s' END"}
    sides = [("t", "a"), ("t", "b"), ("s", "b"), ("s", "c")]
    assert qualify("x.a + b = c and f(b) = 'b.c' and other", {"x": "t"}, sides) == "t.a + t.b = s.c and f(t.b) = 'b.c' and other"
    told = clauses("a = EXTRACT(YEAR FROM d), b = ' FROM x', c = (SELECT 1 FROM y WHERE z) from s, u  where t.from_id = 1 RETURNING *", "FROM", "WHERE", "RETURNING")
    assert told == {"": "a = EXTRACT(YEAR FROM d), b = ' FROM x', c = (SELECT 1 FROM y WHERE z)", "FROM": "s, u", "WHERE": "t.from_id = 1", "RETURNING": "*"}
    assert clauses("x ON  CONFLICT do", "ON CONFLICT", "RETURNING") == {"": "x", "ON CONFLICT": "do", "RETURNING": None}
    assert bracketed("(a, f(b), ')') rest") == "a, f(b), ')'"
    assert literal("it's \\ x") == "'it\\u0027s \\u005c x'"


def test_statements_take_values_as_literals(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT)")
    db.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    db.execute("UPDATE t SET name = :n WHERE id = :i", {"n": "x', id = 9 --", "i": 2})
    assert values(db.execute("SELECT * FROM t")) == [(1, "a"), (2, "x', id = 9 --")]
    assert db.execute("SELECT name FROM t WHERE name = :n", {"n": "x', id = 9 --"}).count() == 1
    db.execute("UPDATE t SET name = concat(' from ', CAST(EXTRACT(YEAR FROM DATE '2024-02-03') AS STRING)) WHERE id = 1 RETURNING id")
    db.execute("MERGE INTO t USING (SELECT a.id AS k FROM t a JOIN t b ON a.id = b.id) s ON t.id = s.k WHEN MATCHED AND s.k = 2 THEN DELETE")
    assert values(db.execute("SELECT * FROM t")) == [(1, " from 2024")]


def test_lake_snapshots_do_not_change(spark, tmp_path):
    lake = LakeTable.create(spark, str(tmp_path / "t"), "id long, title string")
    lake.append(spark.createDataFrame([(k, f"p{k}") for k in range(4)], "id long, title string"))
    assert lake.delete_where("id = 2") == 1
    assert values(lake.read().select("id")) == [(0,), (1,), (3,)]
    assert lake.read(snapshot_id=1).count() == 4
    assert lake.compact().first()["total_records"] == 3
    assert lake.read(snapshot_id=1).count() == 4
    lake.restore(1)
    assert lake.read().count() == 4


def test_second_writer_of_a_snapshot_fails(spark, tmp_path):
    lake = LakeTable.create(spark, str(tmp_path / "t"), "id long")
    base = lake.current()
    lake.append(spark.range(3))
    with pytest.raises(CommitConflict):
        lake.commit("append", base, [], [])


def test_constraints(spark, tmp_path):
    parent = MutableTable.create(spark, str(tmp_path / "p"), "id long, name string", primary_key=["id"])
    parent.insert(spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string"))
    with pytest.raises(ConstraintError):
        parent.insert(spark.createDataFrame([(1, "again")], "id long, name string"))
    with pytest.raises(ConstraintError):
        parent.insert(spark.createDataFrame([(None, "null key")], "id long, name string"))
    child = MutableTable.create(spark, str(tmp_path / "c"), "id long, pid long", foreign_keys=[ForeignKey("pid", parent, "id")])
    with pytest.raises(ConstraintError):
        child.insert(spark.createDataFrame([(1, 9)], "id long, pid long"))
    child.insert(spark.createDataFrame([(1, 1), (2, None)], "id long, pid long"))
    with pytest.raises(ConstraintError):
        parent.delete(F.col("id") == 1)
    with pytest.raises(ConstraintError):
        parent.truncate()
    parent.delete(F.col("id") == 2)
    assert values(parent.read().select("id")) == [(1,)]


def test_merge_refuses_two_matches(spark, tmp_path):
    t = MutableTable.create(spark, str(tmp_path / "t"), "id long, stock long", primary_key=["id"])
    t.insert(spark.createDataFrame([(101, 10), (102, 20)], "id long, stock long"))
    source = spark.createDataFrame([(102, 5), (103, 50)], "id long, q long")
    on = F.col("t.id") == F.col("s.id")
    t.merge(source, on, [(None, {"stock": F.col("t.stock") + F.col("s.q")})], [(None, {"id": F.col("s.id"), "stock": F.col("s.q")})])
    assert values(t.read()) == [(101, 10), (102, 25), (103, 50)]
    with pytest.raises(ConstraintError):
        t.merge(source.unionAll(source), on, [(None, "delete")])


def test_sequences_fill_and_end(spark, tmp_path):
    t = MutableTable.create(spark, str(tmp_path / "t"), "id long, name string", primary_key=["id"], sequences={"id": Sequence()})
    t.insert(spark.createDataFrame([("a",), ("b",)], "name string"))
    t.insert(spark.createDataFrame([("c",)], "name string"))
    assert sorted(r["id"] for r in t.read().collect()) == [1, 2, 3]
    s = Sequence(start=1, maximum=2)
    s.nextval()
    s.nextval()
    with pytest.raises(ConstraintError):
        s.nextval()


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=8))
def test_upsert_twice_is_once(spark, tmp_path_factory, rows):
    t = MutableTable.create(spark, str(tmp_path_factory.mktemp("u") / "t"), "k long, v long", primary_key=["k"])
    df = spark.createDataFrame(rows, "k long, v long")
    update = {"v": F.col("excluded.v")}
    t.upsert(df, update=update)
    once = values(t.read())
    t.upsert(df, update=update)
    assert values(t.read()) == once


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 3), max_size=6), st.lists(st.integers(0, 3), max_size=6))
def test_bag_algebra(spark, a, b):
    x, y = (spark.createDataFrame([(v,) for v in z], "v long") for z in (a, b))
    assert x.exceptAll(y).count() + x.intersectAll(y).count() == len(a)


def test_queue_guards_groups_and_retention(spark, tmp_path):
    q = QueueTable.create(spark, str(tmp_path / "q"), "payload string", "7 DAYS", "10GB")
    q.send(spark.createDataFrame([(f"m{k}",) for k in range(10)], "payload string"), order=["payload"])
    with pytest.raises(ValueError):
        q.update()
    with pytest.raises(ValueError):
        q.read("payload = 'm1'")
    a = Consumer(q, "a", auto=False)
    assert [r["payload"] for r in a.receive(3).collect()] == ["m0", "m1", "m2"]
    a.rollback()
    assert a.position == 0
    q.retention_ms = 0
    assert q.purge(now_ms=10**13) == 10
    q.send(spark.createDataFrame([("late",)], "payload string"))
    assert values(q.read().select("_offset")) == [(10,)]
    with pytest.raises(OffsetTruncated):
        a.receive()


def test_durations_and_sizes():
    assert parse_duration("7 DAYS") == 604_800_000
    assert parse_duration("10s") == 10_000
    assert parse_bytes("10GB") == 10 << 30


def test_cache_expires(spark, tmp_path):
    cache = CacheTable.create(spark, str(tmp_path / "c"), "id string, v long", ["id"], "10s")
    cache.clock.append(0)
    cache.insert(spark.createDataFrame([("s1", 1), ("s2", 2)], "id string, v long"))
    cache.touch(F.col("id") == "s1", "1 MINUTE")
    cache.clock.append(15_000)
    assert values(cache.read()) == [("s1", 1)]
    assert cache.purge_expired() == 1


def test_recursion_ends_or_says_so(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "s long, d long")
    step = lambda w: w.join(edges, w["n"] == edges["s"]).select("d")
    assert values(recursive(spark.createDataFrame([(1,)], "n long"), step)) == [(1,), (2,), (3,)]
    with pytest.raises(RecursionLimit):
        recursive(spark.createDataFrame([(1,)], "n long"), step, distinct=False, limit=3)


def test_scripts_and_binding():
    assert tables.split_statements("SELECT ';'; -- a; b\nDO $$ x; y $$; SELECT 2") == ["SELECT ';'", "DO $$ x; y $$", "SELECT 2"]
    assert tables.bind("SELECT ? + $2, '?'", [1, 2]) == ("SELECT :p1 + :p2, '?'", {"p1": 1, "p2": 2})


def test_row_cap(spark):
    with pytest.raises(ValueError):
        tables.with_row_cap(spark.range(11), 10)
