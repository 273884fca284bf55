"""Shared-folder tables and code shipping for operators that run Python on executors."""

from __future__ import annotations

import ctypes
import os
import sys
import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset (local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="basalt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts lineage and survives lost executors: a task that is run again reads files, it does not
    recompute what led to them.
    """
    path = f"{shared_folder(df.sparkSession)}/basalt/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out, lambda _, k=id(out): _written.pop(k, None)), path)
    release_freed(df.sparkSession)
    return out


def release_freed(spark: SparkSession) -> None:
    """Give back to the system what the driver's Python and JVM have freed outside the Java heap.

    glibc keeps freed memory in arenas of each thread; planning and compiling many queries on many threads lets them
    grow by hundreds of megabytes. Where the C library or the JVM can't do it, nothing happens.
    """
    if not sys.platform.startswith("linux"):
        return
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(ctypes.c_size_t(0))
    try:
        _jvm_command(spark, "systemTrimNativeHeap")
    except Py4JError:  # a JVM without that command
        pass


def _jvm_command(spark: SparkSession, name: str) -> str:
    """A diagnostic command of the driver's JVM; py4j finds the server's methods only by its interface."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array

    def array(kind: str, *values: object) -> object:
        out = new_array(getattr(jvm.java.lang, kind), len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    of = jvm.java.lang.Class.forName
    kinds = [of(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    invoke = of("javax.management.MBeanServerConnection").getMethod("invoke", array("Class", *kinds))
    where = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    return invoke.invoke(server, array("Object", where, name, array("Object"), array("String")))


_written: dict[int, tuple] = {}


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written and nothing will read again, its own lost tasks included."""
    for df in tables:
        known = _written.pop(id(df), None)
        if known:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(known[1])
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sample_limit(wanted: float, total: int) -> int:
    """The limit for ``sampled`` under which about ``wanted`` of ``total`` different hashes lie, however many there are."""
    return (1 << 63) - 1 if wanted >= total else int((1 << 63) * wanted / total)


def sampled(seed: Column, limit: Column) -> Column:
    """Whether a row's 64-bit hash falls under a limit, of 63 bits."""
    return seed.bitwiseAND(F.lit((1 << 63) - 1)) <= limit


#: Bounds of an Arrow batch that goes to Python: a task holds several at once, whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def ship_package(spark: SparkSession) -> None:
    """Give executors this package once per application, wherever they run, and bound their Arrow batches."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(key)) or 0) <= most:
            spark.conf.set(key, str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="basalt-code-"), "basalt_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
