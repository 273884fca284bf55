"""Lake tables: Parquet data files, manifests that list them, and a log of JSON snapshots.

A commit writes its files first, lists them in a manifest of its own, and publishes one log entry by
creating a file that must not exist yet, so readers see all of a commit or none, and of two writers one
fails.  A log entry names manifests, not files, so a commit costs what it adds.  Readers pin a snapshot: its
files, pruned by the column ranges and buckets in the manifests, less rows in its position deletes.  All
metadata goes through Hadoop's file systems, so a table can lie wherever Spark can write.
"""

from __future__ import annotations

import datetime
import decimal
import json
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Delete files up to this many rows are broadcast to the scan.
BROADCAST_DELETES = 2_000_000
#: Bytes of a file that a compaction aims at.
COMPACT_BYTES = 64 << 20

_TRANSFORM = re.compile(r"(?:(identity|year|month|day)\((\w+)\)|(bucket|truncate)\((\d+)\s*,\s*(\w+)\)|(\w+))$", re.I)


@dataclass(frozen=True)
class Transform:
    """A partition value: identity, year, month, day, bucket[N] or truncate[W] of a column."""

    kind: str
    column: str
    width: int = 0

    @classmethod
    def parse(cls, text: str) -> Transform:
        m = _TRANSFORM.match(text.strip())
        if not m:
            raise ValueError(f"not a partition transform: {text}")
        if m[6]:
            return cls("identity", m[6])
        return cls(m[1].lower(), m[2]) if m[1] else cls(m[3].lower(), m[5], int(m[4]))

    @property
    def name(self) -> str:
        return self.column if self.kind == "identity" else f"{self.column}_{self.kind}"

    def apply(self, value: Column, data_type: str) -> Column:
        if self.kind == "year":
            return F.date_format(value, "yyyy")
        if self.kind == "month":
            return F.date_format(value, "yyyy-MM")
        if self.kind == "day":
            return F.date_format(value, "yyyy-MM-dd")
        if self.kind == "bucket":
            return F.pmod(F.xxhash64(value), F.lit(self.width)).cast("string")
        if self.kind == "truncate":
            return F.substring(value, 1, self.width) if data_type == "string" else (value - F.pmod(value, F.lit(self.width))).cast("string")
        return value.cast("string")


@dataclass
class Snapshot:
    id: int
    parent: int | None
    timestamp_ms: int
    operation: str
    schema: str
    partition_by: list[str]
    manifests: list[dict] = field(default_factory=list)  # path, files, rows
    deletes: list[dict] = field(default_factory=list)
    summary: dict = field(default_factory=dict)


    @property
    def n_files(self) -> int:
        return sum(m["files"] for m in self.manifests)

    @property
    def n_loose(self) -> int:
        """Files that were not written by the last compaction."""
        return sum(m["files"] for m in self.manifests if m["path"] not in self.summary.get("compacted", []))

    @property
    def n_rows(self) -> int:
        """Rows of the data files, deleted ones included."""
        return sum(m["rows"] for m in self.manifests)

    @property
    def n_deleted(self) -> int:
        return sum(d["rows"] for d in self.deletes)


class CommitConflict(RuntimeError):
    """Another writer has published a snapshot first."""


class LakeTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: dict[str, list[dict]] = {}
        #: snapshots that this object has published
        self.made: list[int] = []

    # files ---------------------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _log(self, number: int) -> str:
        return f"{self.path}/_log/{number:012d}.json"

    def _write_text(self, path: str, text: str) -> None:
        """A new file; an error if there is one."""
        fs, p = self._fs(path)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _read_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, snapshot: Snapshot) -> Snapshot:
        try:
            self._write_text(self._log(snapshot.id), json.dumps(snapshot.__dict__))
        except Exception as e:
            if "already exists" in str(e):
                raise CommitConflict(f"snapshot {snapshot.id} of {self.path} exists") from e
            raise
        self.made.append(snapshot.id)
        return snapshot

    def _read_log(self, number: int) -> Snapshot:
        return Snapshot(**json.loads(self._read_text(self._log(number))))

    def _manifest(self, files: list[dict]) -> list[dict]:
        """The manifest of these files, as a list for a snapshot; manifests never change once they are written."""
        if not files:
            return []
        path = f"{self.path}/_manifests/{uuid.uuid4().hex}.json"
        self._write_text(path, "\n".join(map(json.dumps, files)))
        return [{"path": path, "files": len(files), "rows": sum(f["rows"] for f in files)}]

    def files_of(self, snapshot: Snapshot) -> list[dict]:
        """All data files of a snapshot, with their rows, partition values and column ranges."""
        for m in snapshot.manifests:
            if m["path"] not in self._known:
                self._known[m["path"]] = [json.loads(x) for x in self._read_text(m["path"]).split("\n")]
        return [f for m in snapshot.manifests for f in self._known[m["path"]]]

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/_log")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d{12}\.json", n))

    # metadata ------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType | str, partition_by: list[str] = (), if_not_exists: bool = False) -> LakeTable:
        table = cls(spark, path)
        if table.exists():
            if if_not_exists:
                return table
            raise ValueError(f"there is a table at {path}")
        kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
        for t in map(Transform.parse, partition_by):
            kind[t.column]  # noqa: B018  an unknown column is an error
        table._publish(Snapshot(0, None, int(time.time() * 1000), "create", kind.json(), list(partition_by)))
        return table

    def exists(self) -> bool:
        return bool(self._numbers())

    def current(self) -> Snapshot:
        numbers = self._numbers()
        if not numbers:
            raise ValueError(f"there is no table at {self.path}")
        return self._read_log(numbers[-1])

    def snapshot(self, snapshot_id: int | None = None) -> Snapshot:
        return self.current() if snapshot_id is None else self._read_log(snapshot_id)

    def as_of(self, timestamp_ms: int) -> Snapshot:
        """The last snapshot not after a time."""
        for n in reversed(self._numbers()):
            if (s := self._read_log(n)).timestamp_ms <= timestamp_ms:
                return s
        raise ValueError("no snapshot is that old")

    def schema(self, snapshot_id: int | None = None) -> StructType:
        return StructType.fromJson(json.loads(self.snapshot(snapshot_id).schema))

    def snapshots(self) -> DataFrame:
        """snapshot_id, parent_snapshot_id, timestamp_ms, operation, added_records, total_records (live ones), manifest_list."""
        rows = []
        for s in map(self._read_log, self._numbers()):
            rows.append((s.id, s.parent, s.timestamp_ms, s.operation, s.summary.get("added", 0), s.n_rows - s.n_deleted, self._log(s.id)))
        names = "snapshot_id long, parent_snapshot_id long, timestamp_ms long, operation string, added_records long, total_records long, manifest_list string"
        return self.spark.createDataFrame(rows, names)

    def files(self, snapshot_id: int | None = None) -> DataFrame:
        """snapshot_id (that added the file), file_path, file_format, record_count, file_size_in_bytes, lower_bounds, upper_bounds."""
        rows = [(f["snapshot"], f["path"], "PARQUET", f["rows"], f["size"], json.dumps(f["min"]), json.dumps(f["max"])) for f in self.files_of(self.snapshot(snapshot_id))]
        names = "snapshot_id long, file_path string, file_format string, record_count long, file_size_in_bytes long, lower_bounds string, upper_bounds string"
        return self.spark.createDataFrame(rows, names)

    def partitions(self, snapshot_id: int | None = None) -> DataFrame:
        """partition, record_count, file_count of a snapshot."""
        rows = [(json.dumps(f["partition"]), f["rows"]) for f in self.files_of(self.snapshot(snapshot_id))]
        return self.spark.createDataFrame(rows, "partition string, n long").groupBy("partition").agg(F.sum("n").alias("record_count"), F.count("*").alias("file_count"))

    # writing -------------------------------------------------------------------------------------

    def _write_files(self, df: DataFrame, base: Snapshot) -> list[dict]:
        """Data files of ``df`` with their rows, partition values and column ranges."""
        schema = StructType.fromJson(json.loads(base.schema))
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        df = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        transforms = [Transform.parse(t) for t in base.partition_by]
        parts = [f"_part_{t.name}" for t in transforms]
        if transforms:
            df = df.withColumns({p: t.apply(F.col(t.column), kinds[t.column]) for p, t in zip(parts, transforms, strict=True)})
            # rows of a partition meet, and a large partition is split by adaptive execution
            df = df.hint("rebalance", *parts)
            df.write.partitionBy(*parts).parquet(folder)
        else:
            df.write.parquet(folder)
        written = self.spark.read.schema(StructType([*schema.fields, *_parse_datatype_string(", ".join(f"{p} string" for p in parts) or "_x int").fields[: len(parts)]]))
        written = written.parquet(folder)
        ranged = [f.name for f in schema if _comparable(kinds[f.name])]
        real = [c for c in ranged if kinds[c] in ("float", "double")]
        own = {c: F.when(~F.isnan(c), F.col(c)) if c in real else F.col(c) for c in ranged}
        text = lambda c, v: (F.unix_micros(v) if kinds[c] == "timestamp" else v).cast("string")
        found = written.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), *parts).agg(
            F.count("*").alias("rows"),
            *[text(c, F.min(own[c])).alias(f"min_{c}") for c in ranged], *[text(c, F.max(own[c])).alias(f"max_{c}") for c in ranged],
            *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"nulls_{c}") for c in ranged], *[F.sum(F.isnan(c).cast("long")).alias(f"nans_{c}") for c in real],
            # always empty: with a collecting aggregate Spark keeps a hash table of the task's files, where bounds of texts make it sort all rows
            F.collect_set(F.lit(None).cast("int")).alias("_none"),
        )
        out = []
        for r in found.toLocalIterator():  # a row a file
            partition = {t.name: r[p] for t, p in zip(transforms, parts, strict=True)}
            bounds = {k: {c: r[f"{k}_{c}"] for c in ranged} for k in ("min", "max", "nulls")} | {"nans": {c: r[f"nans_{c}"] or 0 for c in real}}
            out.append({"path": r["path"], "size": r["size"], "rows": r["rows"], "snapshot": base.id + 1, "partition": partition} | bounds)
        return out

    def commit(self, operation: str, base: Snapshot, manifests: list[dict], deletes: list[dict], schema: str | None = None, **summary) -> Snapshot:
        before = {m["path"] for m in base.manifests}
        added = {"added": sum(m["rows"] for m in manifests if m["path"] not in before)}
        return self._publish(Snapshot(base.id + 1, base.id, int(time.time() * 1000), operation, schema or base.schema, base.partition_by, manifests, deletes, _carried(base) | added | summary))

    def append(self, df: DataFrame) -> Snapshot:
        base = self.current()
        return self.commit("append", base, base.manifests + self._manifest(self._write_files(df, base)), base.deletes)

    def overwrite(self, df: DataFrame) -> Snapshot:
        base = self.current()
        return self.commit("overwrite", base, self._manifest(self._write_files(df, base)), [])

    def truncate(self) -> Snapshot:
        base = self.current()
        return self.commit("truncate", base, [], [])

    def delete_where(self, condition: Column | str) -> int:
        """Merge-on-read: the rows' positions go to a delete file; the number of rows deleted."""
        base = self.current()
        gone = self.read(with_position=True).filter(condition).select("_file", "_pos")
        return self.change(base, gone, None, "delete", once=True)

    def change(self, base: Snapshot, gone: DataFrame | None, new: DataFrame | None, operation: str, once: bool = False, **summary) -> int:
        """One commit that deletes positions (each is there ``once``, or they are made distinct) and appends rows; the number of rows deleted."""
        manifests, deletes, n = list(base.manifests), list(base.deletes), 0
        if gone is not None:
            path = f"{self.path}/deletes/{uuid.uuid4().hex}"
            gone = gone.select("_file", "_pos")
            (gone if once else gone.distinct()).write.parquet(path)
            n = self.spark.read.schema("_file string, _pos long").parquet(path).count()
            deletes += [{"path": path, "rows": n}] if n else []
        if new is not None:
            manifests += self._manifest(self._write_files(new, base))
        self.commit(operation, base, manifests, deletes, deleted=n, **summary)
        return n

    def compact(self) -> DataFrame:
        """Rewrite live rows into few files: table_name, compacted, files_before, files_after, total_records, delete_files_removed."""
        base = self.current()
        name = self.path.rsplit("/", 1)[-1]
        after = base
        if base.deletes or base.n_files > 1:
            live = self.read(base.id)
            if not base.partition_by:  # else rows of a partition meet as they are written
                size = sum(f["size"] for f in self.files_of(base)) * (1 - base.n_deleted / max(base.n_rows, 1))
                live = live.repartition(max(1, -int(-size // COMPACT_BYTES)))
            made = self._manifest(self._write_files(live, base))
            after = self.commit("replace", base, made, [], compacted=[m["path"] for m in made])
        row = (name, after is not base, base.n_files, after.n_files, after.n_rows, len(base.deletes))
        names = "table_name string, compacted boolean, files_before long, files_after long, total_records long, delete_files_removed long"
        return self.spark.createDataFrame([row], names)

    def evolve(self, schema: StructType) -> Snapshot:
        """A metadata-only change of columns; files are read by name, missing columns are null."""
        base = self.current()
        return self.commit("schema", base, base.manifests, base.deletes, schema.json())

    def undo(self, snapshot_ids: list[int]) -> Snapshot:
        """The table as it is, without what these snapshots did: their files and deletes go, what they took away comes back."""
        now = self.current()
        new: dict[str, list[dict]] = {}
        for kind in ("manifests", "deletes"):
            came, went = {}, {}
            for n in snapshot_ids:
                s = self._read_log(n)
                own, before = ({x["path"]: x for x in getattr(y, kind)} for y in (s, self._read_log(s.parent)))
                came |= {k: x for k, x in own.items() if k not in before}
                went |= {k: x for k, x in before.items() if k not in own}
            left = {x["path"]: x for x in getattr(now, kind) if x["path"] not in came}
            new[kind] = [*left.values(), *(x for k, x in went.items() if k not in left and k not in came)]
        return self.commit("undo", now, new["manifests"], new["deletes"])

    def restore(self, snapshot_id: int) -> Snapshot:
        """The table as it was, as a new snapshot."""
        base, old = self.current(), self._read_log(snapshot_id)
        return self.commit("restore", base, old.manifests, old.deletes, old.schema)

    def backup(self, path: str, snapshot_id: int | None = None) -> LakeTable:
        """A copy of one snapshot's live rows as a table of its own, with the schema and partitions."""
        s = self.snapshot(snapshot_id)
        copy = LakeTable.create(self.spark, path, self.schema(s.id), s.partition_by)
        copy.append(self.read(s.id))
        return copy

    def verify(self) -> DataFrame:
        """file_path, expected, found of data files that are missing or have other rows than their manifest says; none if all is well."""
        own = self.files_of(self.current())
        expected = self.spark.createDataFrame([(f["path"], f["rows"]) for f in own], "file_path string, expected long")
        there = [f["path"] for f in own if (p := self._fs(f["path"])) and p[0].exists(p[1])]
        if there:
            found = self.spark.read.schema(self.schema()).parquet(*there).groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count("*").alias("found"))
        else:
            found = self.spark.createDataFrame([], "file_path string, found long")
        return expected.join(found, "file_path", "left").filter("found IS NULL OR found <> expected")

    # reading -------------------------------------------------------------------------------------

    def pruned_files(self, where: dict[str, tuple] | None = None, snapshot_id: int | None = None) -> list[dict]:
        """Files that may hold rows with ``{column: (operator, value)}``; operators = <> < <= > >=.

        Spark compares the bounds as it compares the rows: in the column's type, with its casts.
        """
        s = self.snapshot(snapshot_id)
        files = self.files_of(s)
        kinds = {f.name: f.dataType.simpleString() for f in StructType.fromJson(json.loads(s.schema))}
        tests = [(c, op, v) for c, (op, v) in (where or {}).items() if _comparable(kinds[c]) and _alike(kinds[c], v)]
        if not files or not tests:
            return files
        buckets = {t.column: t for t in map(Transform.parse, s.partition_by) if t.kind == "bucket"}
        rows, kept = [], F.lit(True)
        for k, f in enumerate(files):
            row: list = [k]
            for c, _, _ in tests:
                nans, nulls = f["nans"].get(c, 0), f["nulls"].get(c)
                row += [f["min"].get(c), f["max"].get(c), nans > 0 or nulls is None, f["partition"].get(buckets[c].name) if c in buckets else None]
            rows.append(tuple(row))
        for i, (c, op, v) in enumerate(tests):
            low, high = (_typed(F.col(f"{x}{i}"), kinds[c]) for x in ("low", "high"))
            value = F.lit(v)
            may = {"=": (low <= value) & (high >= value), "<>": ~((low == value) & (high == value)), "<": low < value, "<=": low <= value, ">": high > value, ">=": high >= value}[op]
            if c in buckets and op == "=" and kinds[c] not in ("float", "double"):
                may = may & F.coalesce(F.col(f"bucket{i}") == buckets[c].apply(value.cast(kinds[c]), kinds[c]), F.lit(True))
            kept = kept & (F.col(f"doubt{i}") | F.coalesce(may, F.lit(False)))
        names = "k long" + "".join(f", low{i} string, high{i} string, doubt{i} boolean, bucket{i} string" for i in range(len(tests)))
        wanted = {r["k"] for r in self.spark.createDataFrame(rows, names).filter(kept).select("k").collect()}
        return [f for k, f in enumerate(files) if k in wanted]

    def read(self, snapshot_id: int | None = None, where: dict[str, tuple] | None = None, with_position: bool = False) -> DataFrame:
        """Rows of a snapshot; ``where`` prunes files first and is applied to rows as well."""
        s = self.snapshot(snapshot_id)
        schema = StructType.fromJson(json.loads(s.schema))
        files = [f["path"] for f in self.pruned_files(where, s.id)]
        if not files:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumns({"_file": F.lit(""), "_pos": F.lit(0).cast("long")}) if with_position else empty
        rows = self.spark.read.schema(schema).parquet(*files)
        for c, (op, v) in (where or {}).items():
            test = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}[op]
            rows = rows.filter(getattr(F.col(c), test)(v))
        if not s.deletes and not with_position:
            return rows
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_pos"))
        if s.deletes:
            # a row is one long, its file's number before its position: paths would take most of the join's memory
            numbers = F.broadcast(self.spark.createDataFrame([(f, k << 40) for k, f in enumerate(files)], "_file string, _first long"))
            unknown = F.raise_error(F.lit(f"a file of {self.path} is not in its manifests")).cast("long")
            gone = self.spark.read.schema("_file string, _pos long").parquet(*[d["path"] for d in s.deletes])
            gone = gone.join(numbers, "_file").select((F.col("_first") + F.col("_pos")).alias("_row"))
            small = sum(d["rows"] for d in s.deletes) <= BROADCAST_DELETES
            rows = rows.join(numbers, "_file", "left").withColumn("_row", F.coalesce("_first", unknown) + F.col("_pos"))
            rows = rows.join(F.broadcast(gone) if small else gone, "_row", "left_anti")
        return rows.select(*schema.names, "_file", "_pos") if with_position else rows.select(*schema.names)


def _carried(snapshot: Snapshot) -> dict:
    """What a queue notes in a snapshot and later snapshots must keep."""
    return {k: v for k, v in snapshot.summary.items() if k not in ("added", "deleted")}


def _comparable(kind: str) -> bool:
    return kind not in ("binary", "variant", "interval") and not kind.startswith(("array", "map", "struct", "interval"))


def _typed(text: Column, kind: str) -> Column:
    return F.timestamp_micros(text.cast("long")) if kind == "timestamp" else text.cast(kind)


def _alike(kind: str, value) -> bool:
    """Whether ranges of the column's type say something about comparisons with the value; None compares with nothing."""
    if value is None:
        return True
    if kind == "string":
        return isinstance(value, str)
    if kind == "boolean":
        return isinstance(value, bool)
    if kind.startswith(("timestamp", "date")):
        return isinstance(value, (str, datetime.date))
    return isinstance(value, (int, float, decimal.Decimal)) and not isinstance(value, bool)
