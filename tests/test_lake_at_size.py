"""Lake tables as they must be for large tables: what is joined, sorted and compacted."""

from pyspark.sql import functions as F

from basalt.plans import statistics
from basalt.sources.lake import LakeTable


def _plans(spark, after):
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [found.apply(k).physicalPlanDescription() for k in range(found.size()) if found.apply(k).executionId() > after]


def _last(spark):
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((found.apply(k).executionId() for k in range(found.size())), default=-1)


def test_deletes_are_joined_by_numbers(spark, tmp_path):
    """Paths as keys took 520 bytes a deleted row in each executor."""
    lake = LakeTable.create(spark, f"{tmp_path}/a", "k long, s string", ["s"])
    rows = spark.range(300).select(F.col("id").alias("k"), F.element_at(F.array(*map(F.lit, ["ab", "50", "xy", "z"])), (F.col("id") % 4 + 1).cast("int")).alias("s"))
    for part in ("k < 100", "k >= 100"):
        lake.append(rows.filter(part))
    assert lake.delete_where("k % 5 = 0") == 60
    assert lake.delete_where("k % 5 = 1 AND s = '50'") == 15
    assert sorted(r["k"] for r in lake.read().collect()) == [k for k in range(300) if k % 5 and not (k % 5 == 1 and k % 4 == 1)]
    assert sorted(r["k"] for r in lake.read(where={"k": (">=", 100)}).collect()) == [k for k in range(100, 300) if k % 5 and not (k % 5 == 1 and k % 4 == 1)]
    plan = lake.read()._jdf.queryExecution().optimizedPlan().toString()
    anti = [line for line in plan.split("\n") if "LeftAnti" in line]
    assert anti and "_file" not in anti[0]


def test_large_deletes_are_not_broadcast(spark, tmp_path, monkeypatch):
    from basalt.sources import lake as module

    lake = LakeTable.create(spark, f"{tmp_path}/a", "k long")
    lake.append(spark.range(200).select(F.col("id").alias("k")))
    lake.delete_where("k % 3 = 0")
    monkeypatch.setattr(module, "BROADCAST_DELETES", 10)
    assert sorted(r["k"] for r in lake.read().collect()) == [k for k in range(200) if k % 3]


def test_column_ranges_are_found_without_a_sort(spark, tmp_path):
    lake = LakeTable.create(spark, f"{tmp_path}/a", "k long, s string", ["k"])
    before = _last(spark)
    lake.append(spark.range(6).select((F.col("id") % 2).alias("k"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("s")))
    plans = _plans(spark, before)
    assert any("min(" in p for p in plans) and not any("SortAggregate" in p for p in plans)
    assert sorted((f["partition"]["k"], f["min"]["s"], f["max"]["s"], f["rows"]) for f in lake.files_of(lake.current())) == [("0", "v0", "v4", 3), ("1", "v1", "v5", 3)]


def test_a_compacted_table_is_left_alone(spark, tmp_path):
    """Also one of many partitions, whose files are many after compaction as well."""
    lake = LakeTable.create(spark, f"{tmp_path}/a", "k long, p long", ["p"])
    rows = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 12).alias("p"))
    lake.append(rows)
    assert statistics.maintain(lake) is not None
    assert statistics.maintain(lake) is None
    lake.append(rows.filter("p = 1"))
    assert statistics.maintain(lake) is None
    lake.append(rows)
    assert statistics.maintain(lake) is not None
    assert lake.read().count() == 125


def test_compaction_makes_few_files(spark, tmp_path):
    lake = LakeTable.create(spark, f"{tmp_path}/a", "k long")
    lake.append(spark.range(400, numPartitions=20).select(F.col("id").alias("k")))
    assert lake.current().n_files == 20
    assert statistics.maintain(lake).first()["files_after"] == 1
    assert sorted(r["k"] for r in lake.read().collect()) == list(range(400))
