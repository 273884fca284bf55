"""Mutable tables over lake tables: constraints, DML with returned changes, sequences.

Every change is one commit: positions of the rows that go, and files of the rows that come.  A statement
pins a snapshot first, reads and checks against it, and commits on top of it, so a writer in between is a
conflict, never a duplicate.  Checks look at new keys and references only, by semi joins, and are left out
where a statement doesn't touch them.  The engine's right-hand sides all see the old row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from basalt.operators.recursive import round_table

from .lake import LakeTable


class ConstraintError(ValueError):
    """A key, reference or null rule would be broken."""


@dataclass
class ForeignKey:
    column: str
    parent: MutableTable
    parent_column: str
    on_delete: str = "restrict"  # restrict, cascade, set null
    on_update: str = "restrict"


@dataclass
class Sequence:
    """A counter on the driver; a bulk of values is taken at once."""

    start: int = 1
    increment: int = 1
    minimum: int | None = None
    maximum: int | None = None
    cycle: bool = False
    value: int | None = None

    def nextval(self, count: int = 1) -> int:
        """The first of ``count`` values."""
        first = self.start if self.value is None else self.value + self.increment
        last = first + (count - 1) * self.increment
        if (self.maximum is not None and last > self.maximum) or (self.minimum is not None and last < self.minimum):
            if not self.cycle or count > 1:
                raise ConstraintError("the sequence is exhausted")
            first = last = (self.minimum if self.minimum is not None else 1) if self.increment > 0 else self.maximum
        self.value = last
        return first

    def currval(self) -> int:
        if self.value is None:
            raise ConstraintError("the sequence has no current value")
        return self.value

    def setval(self, value: int) -> int:
        self.value = value
        return value


@dataclass
class Changes:
    """What a statement did: ``count`` rows, given back as ``rows`` where they are asked for."""

    count: int
    rows: DataFrame | None = None


def number_rows(df: DataFrame, name: str, first: int, step: int, *order) -> DataFrame:
    """Gap-free numbers in an order, without one task for all rows: partitions are counted, then numbered.

    The rows are written with their partitions first: a plan that runs twice may deal them out anew.
    """
    ordered = df.orderBy(*order) if order else df
    tagged = round_table(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    counts = sorted((r["_p"], r["n"]) for r in tagged.groupBy("_p").agg(F.count("*").alias("n")).collect())  # a row a partition
    base, starts = 0, []
    for p, n in counts:
        starts.append((p, base))
        base += n
    at = df.sparkSession.createDataFrame(starts, "_p int, _b long")
    within = F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)
    out = tagged.join(F.broadcast(at), "_p").withColumn(name, (F.col("_b") + within) * step + first)
    return out.drop("_p", "_m", "_b")


@dataclass
class MutableTable:
    spark: SparkSession
    path: str
    primary_key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    sequences: dict[str, Sequence] = field(default_factory=dict)
    children: list[tuple[MutableTable, ForeignKey]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.lake = LakeTable(self.spark, self.path)
        for fk in self.foreign_keys:
            fk.parent.children.append((self, fk))

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, **rules) -> MutableTable:
        LakeTable.create(spark, path, schema, if_not_exists=rules.pop("if_not_exists", False))
        return cls(spark, path, **rules)

    def read(self) -> DataFrame:
        return self.lake.read()

    @property
    def schema(self) -> StructType:
        return self.lake.schema()

    # checks --------------------------------------------------------------------------------------

    def keys(self) -> list[list[str]]:
        return ([self.primary_key] if self.primary_key else []) + self.unique

    def _check_unique(self, new: DataFrame, old: DataFrame | None) -> None:
        """New rows against each other and against the rows that stay."""
        for key in self.keys():
            full = new.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in key))  # a null in a key exempts the row
            if not full.groupBy(*key).count().filter("count > 1").isEmpty():
                raise ConstraintError(f"rows share the key {key}")
            if old is not None and not full.select(*key).join(old.select(*key), key, "left_semi").isEmpty():
                raise ConstraintError(f"rows share the key {key}")

    def _check_rows(self, new: DataFrame, touched: set[str] | None = None) -> None:
        """Nulls and references of new rows, in the columns that a statement sets (all by default)."""
        needed = [c for c in dict.fromkeys([*self.primary_key, *self.not_null]) if touched is None or c in touched]
        if needed and not new.filter(" OR ".join(f"`{c}` IS NULL" for c in needed)).isEmpty():
            raise ConstraintError(f"a null in {needed}")
        for fk in self.foreign_keys:
            if touched is not None and fk.column not in touched:
                continue
            parents = fk.parent.read().select(F.col(fk.parent_column).alias(fk.column))
            if not new.filter(F.col(fk.column).isNotNull()).join(parents, fk.column, "left_anti").isEmpty():
                raise ConstraintError(f"{fk.column} refers to a missing row")

    def _conform(self, df: DataFrame) -> DataFrame:
        """Declared columns in order, cast; sequences fill what is missing."""
        for c, s in self.sequences.items():
            if c not in df.columns:
                n = df.count()
                df = number_rows(df, c, s.nextval(n), s.increment) if n else df.withColumn(c, F.lit(None))
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema])

    # statements ----------------------------------------------------------------------------------

    def insert(self, df: DataFrame) -> Changes:
        base = self.lake.current()
        new = round_table(self._conform(df))  # checked, written and returned: one and the same rows
        self._check_rows(new)
        self._check_unique(new, self.lake.read(base.id))
        self.lake.change(base, None, new, "insert")
        return Changes(new.count(), new)

    def upsert(self, df: DataFrame, on: list[str] | None = None, update: dict[str, Column] | None = None, where: Column | None = None) -> Changes:
        """INSERT ... ON CONFLICT: ``update`` sees ``old.`` and ``excluded.`` columns; without it conflicts are left alone.

        Of several incoming rows with one key the first (in an order of all columns) counts.
        """
        key = on or self.primary_key
        from .tables import first_per_key

        base = self.lake.current()
        incoming = first_per_key(self._conform(df), key, *[F.col(c) for c in self.schema.names])
        self._check_rows(incoming)
        old = self.lake.read(base.id, with_position=True)
        both = old.alias("old").join(incoming.alias("excluded"), [F.col(f"old.{c}") == F.col(f"excluded.{c}") for c in key])
        fresh = round_table(incoming.join(old.select(*key), key, "left_anti").select(*self.schema.names))
        if update is None:
            self._check_unique(fresh, old)
            self.lake.change(base, None, fresh, "insert")
            return Changes(fresh.count(), fresh)
        hit = both.filter(where) if where is not None else both
        changed = hit.select(*[update.get(c, F.col(f"old.{c}")).cast(self.schema[c].dataType).alias(c) for c in self.schema.names], "old._file", "old._pos")
        return self._apply(base, changed, fresh, "upsert", set(update))

    def _apply(self, base, changed: DataFrame, fresh: DataFrame | None, operation: str, touched: set[str]) -> Changes:
        """Commit changed rows (with the positions of the old ones) and new ones, after the checks that ``touched`` columns ask for."""
        changed = round_table(changed)
        new = changed.drop("_file", "_pos")
        self._check_rows(new, touched)
        if any(c in touched for key in self.keys() for c in key):
            stays = self.lake.read(base.id, with_position=True).join(changed.select("_file", "_pos"), ["_file", "_pos"], "left_anti")
            self._check_unique(new.unionByName(fresh) if fresh is not None else new, stays)
        elif fresh is not None:
            self._check_unique(fresh, self.lake.read(base.id))
        new = new.unionByName(fresh) if fresh is not None else new
        self.lake.change(base, changed.select("_file", "_pos"), new, operation)
        if any(fk.parent_column in touched for _, fk in self.children):
            self._after_key_update(self.lake.read(base.id))
        return Changes(new.count(), new)

    def update(self, assignments: dict[str, Column], where: Column | None = None, source: DataFrame | None = None, on: Column | None = None) -> Changes:
        """UPDATE [FROM source]: of several source rows for a row one counts, the least in an order of all columns."""
        base = self.lake.current()
        rows = self.lake.read(base.id, with_position=True).alias("t")
        if source is not None:
            rows = rows.join(source.alias("s"), on)
        rows = rows.filter(where) if where is not None else rows
        values = [assignments.get(c, F.col(f"t.{c}")).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]
        changed = rows.select(*values, "t._file", "t._pos")
        if source is not None:
            from .tables import first_per_key

            changed = first_per_key(changed, ["_file", "_pos"], *[F.col(c) for c in self.schema.names])
        return self._apply(base, changed, None, "update", set(assignments))

    def delete(self, where: Column | None = None, using: DataFrame | None = None, on: Column | None = None) -> Changes:
        """DELETE [USING source]."""
        base = self.lake.current()
        rows = self.lake.read(base.id, with_position=True).alias("t")
        if using is not None:
            rows = rows.join(using.alias("s"), on, "left_semi")
        gone = rows.filter(where) if where is not None else rows
        deleted = gone.select(*self.schema.names)
        self._before_delete(deleted)
        n = self.lake.change(base, gone.select("_file", "_pos"), None, "delete")
        return Changes(n, deleted)

    def merge(self, source: DataFrame, on: Column, matched: list[tuple[Column | None, dict[str, Column] | str]] = (), not_matched: list[tuple[Column | None, dict[str, Column]]] = ()) -> Changes:
        """MERGE: the first fitting clause acts.  ``matched`` actions are assignments or "delete".

        Conditions and values see ``t.`` and ``s.`` columns.  Two source rows for one target row are an error.
        """
        base = self.lake.current()
        target = self.lake.read(base.id, with_position=True).alias("t")
        joined = target.join(source.alias("s"), on)
        if matched and not joined.groupBy("t._file", "t._pos").count().filter("count > 1").isEmpty():
            raise ConstraintError("several source rows match one target row")
        action = F.lit(-1)
        for k, (condition, _) in reversed(list(enumerate(matched))):
            action = F.when(F.lit(True) if condition is None else condition, k).otherwise(action)
        acted = joined.withColumn("_action", action).filter("_action >= 0") if matched else joined.withColumn("_action", F.lit(-1)).filter("false")
        values = []
        for c in self.schema.names:
            v = F.col(f"t.{c}")
            for k, (_, what) in enumerate(matched):
                if what != "delete" and c in what:
                    v = F.when(F.col("_action") == k, what[c].cast(self.schema[c].dataType)).otherwise(v)
            values.append(v.alias(c))
        acted = round_table(acted.select(*values, F.col("t._file").alias("_file"), F.col("t._pos").alias("_pos"), "_action"))
        removing = [k for k, (_, what) in enumerate(matched) if what == "delete"]
        removed = F.col("_action").isin(removing) if removing else F.lit(False)
        missing = source.alias("s").join(target, on, "left_anti")
        left, fresh = missing, self.spark.createDataFrame([], self.schema)
        for condition, what in not_matched:
            fits = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
            fresh = fresh.unionByName(left.filter(fits).select(*[what.get(c, F.lit(None)).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]))
            left = left.filter(~fits)
        fresh = round_table(fresh)
        kept = acted.filter(~removed).select(*self.schema.names)
        touched = {c for _, what in matched if what != "delete" for c in what}
        if removing:
            gone_rows = self.lake.read(base.id, with_position=True).join(acted.filter(removed).select("_file", "_pos"), ["_file", "_pos"], "left_semi")
            self._before_delete(gone_rows.select(*self.schema.names))
        self._check_rows(kept, touched)
        self._check_rows(fresh)
        stays = self.lake.read(base.id, with_position=True).join(acted.select("_file", "_pos"), ["_file", "_pos"], "left_anti")
        if any(c in touched for key in self.keys() for c in key):
            self._check_unique(kept.unionByName(fresh), stays)
        else:
            self._check_unique(fresh, stays.select(*self.schema.names).unionByName(kept))
        new = kept.unionByName(fresh)
        count = acted.count() + fresh.count()
        self.lake.change(base, acted.select("_file", "_pos"), new, "merge")
        if any(fk.parent_column in touched for _, fk in self.children):
            self._after_key_update(self.lake.read(base.id))
        return Changes(count, new)

    def truncate(self) -> None:
        if any(not child.read().filter(F.col(fk.column).isNotNull()).isEmpty() for child, fk in self.children):
            raise ConstraintError("other tables refer to rows of this one")
        self.lake.truncate()

    # references ----------------------------------------------------------------------------------

    def _before_delete(self, deleted: DataFrame) -> None:
        for child, fk in self.children:
            keys = deleted.select(F.col(fk.parent_column).alias("_k")).distinct()
            hit = F.col(f"t.{fk.column}") == F.col("s._k")
            if fk.on_delete == "cascade":
                child.delete(using=keys, on=hit)
            elif fk.on_delete == "set null":
                child.update({fk.column: F.lit(None)}, source=keys, on=hit)
            elif not child.read().alias("t").join(keys.alias("s"), hit, "left_semi").isEmpty():
                raise ConstraintError(f"rows refer to what would be deleted ({fk.column})")

    def _after_key_update(self, before: DataFrame) -> None:
        for child, fk in self.children:
            now = self.read().select(F.col(fk.parent_column).alias("_k"))
            gone = before.select(F.col(fk.parent_column).alias("_k")).join(now, "_k", "left_anti")
            hit = F.col(f"t.{fk.column}") == F.col("s._k")
            if child.read().alias("t").join(gone.alias("s"), hit, "left_semi").isEmpty():
                continue
            if fk.on_update == "set null":
                child.update({fk.column: F.lit(None)}, source=gone, on=hit)
            elif fk.on_update == "cascade":
                key = [c for c in self.primary_key if c != fk.parent_column] or None
                if key is None:
                    raise ConstraintError("a cascading key change needs another key to follow rows by")
                pairs = before.select(*key, F.col(fk.parent_column).alias("_k")).join(self.read().select(*key, F.col(fk.parent_column).alias("_new")), key)
                child.update({fk.column: F.col("s._new")}, source=pairs.select("_k", "_new"), on=hit)
            else:
                raise ConstraintError(f"rows refer to a changed key ({fk.column})")

    # columns -------------------------------------------------------------------------------------

    def add_column(self, name: str, kind: str) -> None:
        self.lake.evolve(StructType([*self.schema.fields, StructField(name, _parse_datatype_string(kind))]))

    def drop_column(self, name: str) -> None:
        if any(name in key for key in self.keys()):
            raise ConstraintError(f"{name} is part of a key")
        self.lake.evolve(StructType([f for f in self.schema if f.name != name]))

    def create_unique_index(self, *columns: str) -> None:
        self.unique.append(list(columns))
        try:
            self._check_unique(self.read(), None)
        except ConstraintError:
            self.unique.pop()
            raise


class Transaction:
    """Several tables' changes together: on an error what was done in it is undone, and nothing that others did meanwhile."""

    def __init__(self, *tables):
        """Lake tables, mutable tables, queues."""
        self.lakes = [getattr(t, "lake", t) for t in tables]
        self.begin()

    def begin(self) -> None:
        self.begun = [len(t.made) for t in self.lakes]

    def __enter__(self) -> Transaction:
        self.begin()
        return self

    def __exit__(self, kind, value, trace) -> None:
        if kind is not None:
            self.rollback()

    def rollback(self) -> None:
        for lake, begun in zip(self.lakes, self.begun, strict=True):
            if own := lake.made[begun:]:
                lake.undo(own)
        self.begin()
