"""Hilbert-curve sharding: files that are narrow in several metadata dimensions at once.

Each dimension is quantised at its quantiles (strings by the bytes after their common prefix), the bins
give a cell of a Hilbert curve, and the rows in curve order are cut into runs of equal counts.  The grid
grows with the table, from ``2 ** LEAST_BITS`` to ``2 ** MOST_BITS`` cells.  Rows are ranked without a global
sort: counts of cells fix where each cell begins, and a cell with many rows is dealt out by numbers of the
rows (never by their content) before it is ranked.

The law that holds is ``rows``: shards' counts are at most one apart.

Defined results: null values of a dimension come first; a null text has no bytes and the crc of the
empty string; very long texts count whole; equal rows take places of their own, and within a part of a cell
rows of one size and crc (a tie) are ranked by ``doc_id``, null first; an empty table gives no rows; other
columns are ignored by ``hilbert_shards`` and written as they are by ``write_shards``, whatever their names
but ``shard``.
"""

from __future__ import annotations

import math
import os.path
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .storage import materialize

#: Bits of a cell's number: as many as give about ``RANKED_TOGETHER`` rows a cell, within these bounds.
LEAST_BITS, MOST_BITS = 12, 18
#: Bits of one dimension, at most.
SIDE_BITS = 8
RANKED_TOGETHER = 20_000
LAW = "rows"


def hilbert_indexes(points: np.ndarray, bits: int) -> np.ndarray:
    """Where points (rows) of a grid with ``2 ** bits`` steps a side lie on the curve (Gray code of rotated axes)."""
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            turn = (x[i] & q) > 0
            t = np.where(turn, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(turn, x[0] ^ (q - 1), x[0] ^ t)
            x[i] = x[i] ^ t if i else x[0]
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip, q = np.zeros(len(points), dtype=np.int64), 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[-1] & q, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros(len(points), dtype=np.int64)
    for b in reversed(range(bits)):
        for v in x:
            out = out << 1 | ((v ^ flip) >> b & 1)
    return out


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """The same of one point."""
    return int(hilbert_indexes(np.array([point]), bits)[0])


def _numbers(docs: DataFrame, dimensions: tuple[str, ...]) -> list[Column]:
    """Each dimension as an order-preserving number."""
    texts = [d for d in dimensions if isinstance(docs.schema[d].dataType, StringType)]
    ends = docs.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in texts for f in (F.min, F.max)]).first() if texts else {}
    out = []
    for d in dimensions:
        if d in texts:
            least, most = ends[f"min_{d}"] or "", ends[f"max_{d}"] or ""
            skip = len(os.path.commonprefix([least.encode(), most.encode()]))
            digits = F.rpad(F.hex(F.substring(F.col(d).cast("binary"), skip + 1, 7)), 14, "0")
            out.append(F.conv(digits, 16, 10).cast("double"))
        else:
            out.append(F.col(d).cast("double"))
    return out


def curve_positions(docs: DataFrame, dimensions: tuple[str, ...], rows: int) -> tuple[Column, DataFrame]:
    """The grid cell of a row, as a Column, and the table (cell, curve) of all cells."""
    if not 0 < len(dimensions) <= MOST_BITS:
        raise ValueError(f"1 to {MOST_BITS} dimensions")
    total = min(max(math.ceil(math.log2(max(rows, 1) / RANKED_TOGETHER)), LEAST_BITS), MOST_BITS)
    bits = min(max(total // len(dimensions), 1), SIDE_BITS)
    steps = 1 << bits
    numbers = _numbers(docs, dimensions)
    shares = [k / steps for k in range(1, steps)]
    cuts = docs.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"c{k}") for k, x in enumerate(numbers)]).first()
    cell = F.lit(0)
    for k, x in enumerate(numbers):
        step = sum((F.when(x > c, 1).otherwise(0) for c in sorted(set(cuts[k] or []))), F.lit(0))
        cell = cell * steps + step
    grid = np.arange(steps ** len(dimensions))
    points = np.stack([grid // steps ** (len(dimensions) - 1 - k) % steps for k in range(len(dimensions))], axis=1)
    table = list(zip(grid.tolist(), hilbert_indexes(points, bits).tolist(), strict=True))
    return cell.cast("int"), docs.sparkSession.createDataFrame(table, "_cell int, curve int")


def _places(docs: DataFrame, shards: int, dimensions: tuple[str, ...], carried: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and curve of every row, and the columns that are carried along.

    The rows are numbered and written first: counting and ranking read one dealing of them.
    """
    spark = docs.sparkSession
    total = docs.count()
    cell, curve = curve_positions(docs, dimensions, total)
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), cell.alias("_cell"), F.monotonically_increasing_id().alias("_deal"), *carried,
    )
    slim = materialize(slim, "placed").join(F.broadcast(curve), "_cell")
    counted = sorted((r["curve"], r["n"]) for r in slim.groupBy("curve").agg(F.count("*").alias("n")).collect())  # a row a cell
    at, rows = 0, []
    for c, n in counted:
        rows.append((c, at, math.ceil(n / RANKED_TOGETHER)))
        at += n
    begins = spark.createDataFrame(rows, "curve int, _begin long, _salts long")
    salted = slim.join(F.broadcast(begins), "curve").withColumn("_salt", F.pmod(F.xxhash64("_deal"), "_salts"))
    sizes = salted.groupBy("curve", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("curve").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("curve", "_salt", F.coalesce(before, F.lit(0)).alias("_base"))
    within = Window.partitionBy("curve", "_salt").orderBy("size", "text_crc32", "doc_id")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["curve", "_salt"])
    rank = (F.col("_begin") + F.col("_base") + F.col("_rank")).cast("long")
    out = ranked.withColumn("_rank_all", rank).withColumn("shard", F.expr(f"CAST((_rank_all * {shards}) DIV {max(at, 1)} AS INT)"))
    first = F.expr(f"(shard * {at}L + {shards - 1}) DIV {shards}")
    return out.withColumn("slot", (F.col("_rank_all") - first).cast("long"))


def hilbert_shards(docs: DataFrame, shards: int = 8, dimensions: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law isn't by key), curve."""
    return _places(docs, shards, dimensions).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, dimensions: tuple[str, ...] = ("lang", "source", "n_chars"), rows_per_file: int = 1_000_000) -> None:
    """Write the documents as Parquet: a folder a shard, rows in curve order, runs of ``rows_per_file`` to a file.

    Every row goes with all its columns to the place that ``hilbert_shards`` gives it; nothing is joined.
    """
    if "shard" in docs.columns:
        raise ValueError("a column named shard would clash with the folders' names")
    held, slot, run = (f"_{x}_{uuid.uuid4().hex}" for x in ("held", "slot", "run"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(held)
    placed = _places(docs, shards, dimensions, (row,)).select(f"{held}.*", "shard", F.col("slot").alias(slot))
    dealt = placed.withColumn(run, (F.col(slot) / rows_per_file).cast("long")).repartition("shard", run).sortWithinPartitions("shard", slot)
    dealt.drop(run, slot).write.partitionBy("shard").parquet(path)
