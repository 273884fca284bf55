"""Queue tables: append-only logs with offsets, consumer groups, seeking and retention; and TTL caches."""

from __future__ import annotations

import re
import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from basalt.operators.recursive import round_table

from .lake import LakeTable
from .mutable import Changes, MutableTable, number_rows

SYSTEM = "_offset long, _timestamp timestamp, _msg_id string, _correlation_id string"
_UNITS = {"MS": 1, "S": 1000, "SECOND": 1000, "M": 60_000, "MIN": 60_000, "MINUTE": 60_000, "H": 3_600_000, "HOUR": 3_600_000, "D": 86_400_000, "DAY": 86_400_000, "WEEK": 604_800_000}
_BYTES = {"B": 1, "KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}


def parse_duration(text: str) -> int:
    """Milliseconds of '7 DAYS', '10s', '2 HOURS'."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]+)\s*", text)
    unit = m and (m[2].upper() if m[2].upper() in _UNITS else m[2].upper().removesuffix("S"))
    if not m or unit not in _UNITS:
        raise ValueError(f"not a duration: {text}")
    return int(m[1]) * _UNITS[unit]


def parse_bytes(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([KMGT]?B)\s*", text.upper())
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(m[1]) * _BYTES[m[2]]


class OffsetTruncated(ValueError):
    """Retention has removed the messages a consumer would go on with."""


class QueueTable:
    def __init__(self, spark: SparkSession, path: str, retention_ms: int | None = None, max_bytes: int | None = None):
        self.spark, self.path = spark, path
        self.lake = LakeTable(spark, f"{path}/log")
        self.commits = LakeTable(spark, f"{path}/consumers")
        self.retention_ms, self.max_bytes = retention_ms, max_bytes

    @classmethod
    def create(cls, spark: SparkSession, path: str, columns: str, retention_time: str | None = None, max_bytes: str | None = None) -> QueueTable:
        fields = _parse_datatype_string(SYSTEM).fields + _parse_datatype_string(columns).fields
        LakeTable.create(spark, f"{path}/log", StructType(fields))
        LakeTable.create(spark, f"{path}/consumers", "consumer string, offset long, at timestamp")
        return cls(spark, path, retention_time and parse_duration(retention_time), max_bytes and parse_bytes(max_bytes))

    def _next_offset(self) -> int:
        return int(self.lake.current().summary.get("next_offset", 0))

    def send(self, df: DataFrame, order: list[str] = (), correlation_id: Column | None = None, at: Column | None = None) -> Changes:
        """Append messages with rising offsets in an order; times and ids are the system's."""
        base = self.lake.current()
        first = int(base.summary.get("next_offset", 0))
        own = self.lake.schema().names[4:]
        rows = df.withColumns({c: F.lit(None).cast(self.lake.schema()[c].dataType) for c in own if c not in df.columns})
        rows = rows.withColumns({"_timestamp": at if at is not None else F.current_timestamp(), "_correlation_id": correlation_id if correlation_id is not None else F.lit(None).cast("string")})
        numbered = number_rows(rows, "_offset", first, 1, *order)
        numbered = numbered.withColumn("_msg_id", F.format_string("ID:%s-%d-%08x", F.lit(self.path.rsplit("/", 1)[-1]), F.col("_offset"), F.abs(F.hash("_offset", *own))))
        files = self.lake._write_files(numbered, base)
        n = sum(f["rows"] for f in files)
        self.lake.commit("append", base, base.manifests + self.lake._manifest(files), base.deletes, next_offset=first + n)
        return Changes(n)

    def read(self, where: str | None = None) -> DataFrame:
        """The log; a condition may only speak of ``_offset``, which prunes files and row groups."""
        if where is not None and set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", where))) - {"_offset", "AND", "OR", "NOT", "BETWEEN", "IN", "and", "or", "not", "between", "in"}:
            raise ValueError("a queue is filtered by _offset only")
        rows = self.lake.read()
        return rows.filter(where) if where else rows

    def update(self, *_, **__):
        raise ValueError("messages of a queue can't be changed")

    delete = truncate = create_index = update

    def bounds(self) -> tuple[int, int]:
        """The first offset that is still there, and the next one."""
        first = self.read().agg(F.min("_offset")).first()[0]
        return (self._next_offset() if first is None else first), self._next_offset()

    def purge(self, now_ms: int | None = None) -> int:
        """Retention: first by age, then the oldest beyond the size; the number of messages removed."""
        now_ms = now_ms or int(time.time() * 1000)
        base = self.lake.current()
        rows = self.lake.read(base.id, with_position=True)
        keep_from = 0
        if self.retention_ms is not None:
            live = rows.filter(F.unix_millis("_timestamp") >= now_ms - self.retention_ms)
            least = live.agg(F.min("_offset")).first()[0]
            keep_from = int(base.summary.get("next_offset", 0)) if least is None else least
        if self.max_bytes is not None:
            own = self.lake.schema().names[4:]
            size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in own), F.lit(64))
            # sums of runs of offsets, then of the rows in the one run where the limit falls
            run = F.floor(F.col("_offset") / 10_000)
            live = rows.filter(F.col("_offset") >= keep_from).withColumns({"_run": run, "_size": size})
            total, cut = 0, None
            for r in live.groupBy("_run").agg(F.sum("_size").alias("s")).orderBy(F.desc("_run")).toLocalIterator():
                if total + r["s"] > self.max_bytes:
                    cut = r["_run"]
                    break
                total += r["s"]
            if cut is not None:
                w = Window.orderBy(F.desc("_offset")).rowsBetween(Window.unboundedPreceding, 0)
                fits = live.filter(F.col("_run") == cut).withColumn("_sum", F.sum("_size").over(w)).filter(F.col("_sum") <= self.max_bytes - total)
                least = fits.agg(F.min("_offset")).first()[0]
                keep_from = max(keep_from, (cut + 1) * 10_000 if least is None else least)
        gone = rows.filter(F.col("_offset") < keep_from).select("_file", "_pos")
        if gone.isEmpty():
            return 0
        return self.lake.change(base, gone, None, "retention", once=True)  # one commit; the next offset goes on with it

    def committed(self, consumer: str) -> int | None:
        return self.commits.read(where={"consumer": ("=", consumer)}).agg(F.max_by("offset", "at")).first()[0]

    def commit_offset(self, consumer: str, offset: int) -> None:
        self.commits.append(self.spark.createDataFrame([(consumer, offset)], "consumer string, offset long").withColumn("at", F.current_timestamp()))

    def stream(self) -> DataFrame:
        """The log as a stream of its files, for consumers that Structured Streaming checkpoints."""
        return self.spark.readStream.schema(self.lake.schema()).option("recursiveFileLookup", "true").parquet(f"{self.lake.path}/data")


@dataclass
class Consumer:
    """A reader with its own place; ``auto`` commits with each receipt, otherwise ``acknowledge`` does."""

    queue: QueueTable
    name: str
    auto: bool = True
    position: int | None = None

    def __post_init__(self) -> None:
        if self.position is None:
            self.position = self.queue.committed(self.name)
        if self.position is None:
            self.position = self.queue.bounds()[0]

    def receive(self, count: int = 1) -> DataFrame:
        """The next messages in offset order."""
        first, end = self.queue.bounds()
        if self.position < first and first <= end:
            raise OffsetTruncated(f"offset {self.position} is gone; the log begins at {first}")
        batch = self.queue.read(f"_offset >= {self.position}").orderBy("_offset").limit(count)
        last = batch.agg(F.max("_offset")).first()[0]
        if last is not None:
            self.position = last + 1
            if self.auto:
                self.acknowledge()
        return batch

    def acknowledge(self) -> None:
        self.queue.commit_offset(self.name, self.position)

    def rollback(self) -> None:
        """Back to what was committed last."""
        place = self.queue.committed(self.name)
        self.position = self.queue.bounds()[0] if place is None else place

    def seek(self, offset: int) -> None:
        self.position = offset

    def seek_to_beginning(self) -> None:
        self.position = self.queue.bounds()[0]

    def seek_to_end(self) -> None:
        self.position = self.queue.bounds()[1]

    def seek_to_timestamp(self, at) -> None:
        found = self.queue.read().filter(F.col("_timestamp") >= F.lit(at)).agg(F.min("_offset")).first()[0]
        self.position = self.queue.bounds()[1] if found is None else found

    def rewind(self, count: int) -> None:
        self.position = max(self.queue.bounds()[0], self.position - count)


@dataclass
class CacheTable:
    """Rows that expire: ``_expires_at`` and ``_created_at`` in milliseconds, ``_dirty`` until written back."""

    table: MutableTable
    ttl_ms: int = 3_600_000
    target: MutableTable | None = None
    mode: str = "upsert"  # upsert, delete, both
    clock: list = field(default_factory=list)

    @classmethod
    def create(cls, spark: SparkSession, path: str, columns: str, primary_key: list[str], ttl: str = "1 HOUR", target: MutableTable | None = None, mode: str = "upsert") -> CacheTable:
        schema = StructType(_parse_datatype_string(columns).fields + _parse_datatype_string("_expires_at long, _created_at long, _dirty boolean").fields)
        return cls(MutableTable.create(spark, path, schema, primary_key=primary_key), parse_duration(ttl), target, mode.lower())

    def now(self) -> int:
        return self.clock[-1] if self.clock else int(time.time() * 1000)

    def insert(self, df: DataFrame) -> Changes:
        now = self.now()
        rows = df.withColumns({"_expires_at": F.lit(now + self.ttl_ms).cast("long"), "_created_at": F.lit(now).cast("long"), "_dirty": F.lit(True)})
        new = {c: F.col(f"excluded.{c}") for c in self.table.schema.names if c not in self.table.primary_key}
        return self.table.upsert(rows, update=new)

    def read(self, system: bool = False) -> DataFrame:
        rows = self.table.read().filter(F.col("_expires_at") > self.now())
        return rows if system else rows.drop("_expires_at", "_created_at", "_dirty")

    def update(self, assignments: dict[str, Column], where: Column | None = None) -> Changes:
        return self.table.update(assignments | {"_dirty": F.lit(True)}, where)

    def touch(self, where: Column, extend: str | None = None) -> int:
        """Live rows live on, for the extension or the table's time, from now."""
        until = self.now() + (parse_duration(extend) if extend else self.ttl_ms)
        return self.table.update({"_expires_at": F.lit(until)}, where & (F.col("_expires_at") > self.now())).count

    def purge_expired(self) -> int:
        return self.table.delete(F.col("_expires_at") <= self.now()).count

    def flush(self) -> tuple[int, int]:
        """Write dirty rows to the target by its key and take expired rows away: (written, expired).

        Rows that become dirty while this runs stay dirty.  A dirty row that has expired is not written: it is
        gone for readers as well, and goes with the other expired rows.
        """
        if self.target is None:
            raise ValueError("the cache has no table to write back to")
        written = 0
        if self.mode in ("upsert", "both"):
            live = self.table.lake.read(with_position=True).filter(F.col("_dirty") & (F.col("_expires_at") > self.now()))
            dirty = round_table(live.select(*self.target.schema.names, "_file", "_pos"))
            written = dirty.count()
            self.target.upsert(dirty.drop("_file", "_pos"), update={c: F.col(f"excluded.{c}") for c in self.target.schema.names if c not in self.target.primary_key})
            same = (F.col("t._file") == F.col("s._file")) & (F.col("t._pos") == F.col("s._pos"))  # rows as they were written
            self.table.update({"_dirty": F.lit(False)}, source=dirty.select("_file", "_pos"), on=same)
        expired = self.table.read().filter(F.col("_expires_at") <= self.now())
        if self.mode in ("delete", "both"):
            keys = expired.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(self.target.primary_key)])
            on = None
            for i, c in enumerate(self.target.primary_key):
                same = F.col(f"t.{c}") == F.col(f"s._k{i}")
                on = same if on is None else on & same
            self.target.delete(using=keys, on=on)
        return written, self.purge_expired()

    def write_behind(self, every: str) -> WriteBehind:
        """Flush in the background, again and again, until it is stopped."""
        return WriteBehind(self, parse_duration(every) / 1000)


class WriteBehind(threading.Thread):
    """A thread that flushes a cache; what goes wrong is kept in ``errors`` and tried again at the next turn."""

    def __init__(self, cache: CacheTable, seconds: float):
        super().__init__(daemon=True)
        self.cache, self.seconds = cache, seconds
        self.stopping = threading.Event()
        self.flushes, self.errors = 0, []
        self.start()

    def run(self) -> None:
        while not self.stopping.wait(self.seconds):
            self._turn()

    def _turn(self) -> None:
        try:
            self.cache.flush()
            self.flushes += 1
        except Exception as e:  # another writer's commit, most likely
            self.errors.append(e)

    def stop(self) -> None:
        """End the thread after a last flush."""
        self.stopping.set()
        self.join()
        self._turn()
