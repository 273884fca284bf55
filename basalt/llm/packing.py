"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are integers from 1 to ``capacity``, so the whole instance is a histogram of at most
``capacity`` counts.  Executors count lengths and rank the pieces of each length; the driver packs
counts, never pieces: it fixes dominating sets with their multiplicities, best-fits what is left, and
ships back at most a few runs per length.  A piece finds its place from its length and rank.

Pieces of one length are dealt out by a number of their own (``_deal``), never by their content, so that
ranking stays in parts of about ``RANKED_TOGETHER`` also where one document repeats without end.

Defined results: a null text is empty; an empty text is its end id alone; very long texts are encoded whole,
then cut; equal rows are packed as separate pieces, and pieces of one length (a tie) may take each other's
places; ``doc_id`` may be null or repeat; an empty table gives no rows; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import materialize, ship_package
from .tokenization import default_path, encoder

CAPACITY = 4096
#: Pieces of one length that are ranked together; a commoner length is split by a hash of the piece.
RANKED_TOGETHER = 20_000
#: Bytes of ids that are ranked together, where pieces bring them along.
BYTES_TOGETHER = 16 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # how many sequences, and their (length, count) in order


def token_pieces(
    docs: DataFrame, end_id: int = 1, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document; ``keep_ids`` adds them as little-endian 32-bit binary."""
    ship_package(docs.sparkSession)
    path = tokenizer or default_path()
    schema = PIECES + (", ids binary" if keep_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            doc_ids = batch.column(0)
            for first, end, data, bounds in K.blocks(batch, "text"):
                ids, at = enc.encode_block(data, bounds)
                rows, out = [], {k: [] for k in ("piece", "start", "length", "crc", "ids")}
                for r in range(end - first):
                    own = np.append(ids[at[r] : at[r + 1]], np.uint32(end_id)).astype("<u4")
                    for k, a in enumerate(range(0, len(own), capacity)):
                        part = own[a : a + capacity].tobytes()
                        rows.append(first + r)
                        out["piece"].append(k)
                        out["start"].append(a)
                        out["length"].append(len(part) // 4)
                        out["crc"].append(zlib.crc32(part))
                        if keep_ids:
                            out["ids"].append(part)
                arrays = [doc_ids.take(pa.array(rows, pa.int64())), pa.array(out["piece"], pa.int32())]
                arrays += [pa.array(out[k], pa.int64()) for k in ("start", "length", "crc")]
                arrays += [pa.array(out["ids"], pa.binary())] if keep_ids else []
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(cut, schema)


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences that some best packing holds, and the counts that remain.

    For a piece of length x, a set with x that dominates every other set with x can be fixed:
    x alone if nothing fits beside it; x and its largest partner y if x + y fills the sequence, if no
    two further pieces fit beside x, or if at most two fit and no such two are together longer than y.
    """
    left = {x: n for x, n in counts.items() if n}
    order = sorted(left)
    fixed: list[Pattern] = []

    def take(*lengths: int) -> None:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        m = min(left[x] // k for x, k in need.items())
        fixed.append((m, tuple(sorted(need.items(), reverse=True))))
        for x, k in need.items():
            left[x] -= m * k
            if not left[x]:
                del left[x]
                order.remove(x)

    def smallest(x: int, k: int) -> list[int]:
        found: list[int] = []
        for y in order:
            found += [y] * min(left[y] - (y == x), k - len(found))
            if len(found) == k:
                break
        return found

    def longest_two(x: int, room: int) -> int:
        best, lo, hi = 0, 0, bisect_right(order, room) - 1
        while lo <= hi:
            a, b = order[lo], order[hi]
            enough = left[a] - (a == x) >= (2 if a == b else 1) and left[b] - (b == x) >= 1
            if a + b > room:
                hi -= 1
            else:
                if enough:
                    best = max(best, a + b)
                lo += 1
        return best

    for x in sorted(left, reverse=True):
        while x in left:
            room = capacity - x
            at = bisect_right(order, room) - 1
            while at >= 0 and order[at] == x and left[x] < 2:
                at -= 1
            if at < 0:
                take(x)
                continue
            y, few = order[at], smallest(x, 3)
            if y == room or sum(few[:2]) > room or len(few) < 2:
                take(x, y)
            elif (len(few) < 3 or sum(few) > room) and longest_two(x, room) <= y:
                take(x, y)
            else:
                break
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on counts: equal sequences are kept as one pattern with a multiplicity."""
    by_room: dict[int, list[Pattern]] = defaultdict(list)
    rooms: list[int] = []

    def add(room: int, pattern: Pattern) -> None:
        if room not in by_room or not by_room[room]:
            insort(rooms, room)
        by_room[room].append(pattern)

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_right(rooms, x - 1)
            if at < len(rooms):
                room = rooms[at]
                m, inside = by_room[room].pop()
                if not by_room[room]:
                    del rooms[at]
            else:
                room, m, inside = capacity, n, ()
            each = room // x
            whole = min(m, n // each)
            if whole:
                add(room - each * x, (whole, (*inside, (x, each))))
                n -= whole * each
                m -= whole
            if m and n:  # fewer than ``each`` are left: they go to one sequence
                add(room - n * x, (1, (*inside, (x, n))))
                m, n = m - 1, 0
            if m and inside:
                add(room, (m, inside))
    return [p for room in rooms for p in by_room[room]]


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, pieces of a sequence, first sequence, offset), sorted by length and rank."""
    fixed, left = reduce_by_dominance(counts, capacity)
    taken: dict[int, int] = defaultdict(int)
    runs, sequence = [], 0
    for m, inside in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for x, k in inside:
            runs.append((x, taken[x], k, sequence, offset))
            taken[x] += m * k
            offset += k * x
        sequence += m
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``.

    ``pieces`` should be a table that is read again alike (see ``materialize``), as it is counted
    first and placed afterwards; a column ``_deal``, if there, numbers its rows and is left out of the result.
    """
    ship_package(pieces.sparkSession)
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counted, capacity)
    columns = [c for c in pieces.columns if c != "_deal"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_deal")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            table = pa.table(batch) if not isinstance(batch, pa.Table) else batch
            x, rank = table["length"].to_numpy(), table["_rank"].to_numpy()
            run = runs[np.searchsorted(keys, (x << 44) + rank, side="right") - 1]
            i = rank - run[:, 1]
            out = table.select(columns)
            out = out.append_column("sequence_id", pa.array(run[:, 3] + i // run[:, 2], pa.int64()))
            out = out.append_column("offset", pa.array(run[:, 4] + i % run[:, 2] * x, pa.int64()))
            yield from out.to_batches()

    together = lambda x: max(1, min(RANKED_TOGETHER, BYTES_TOGETHER // (4 * x))) if "ids" in columns else RANKED_TOGETHER
    salts = pieces.sparkSession.createDataFrame([(x, math.ceil(n / together(x))) for x, n in counted.items()], "length long, _salts long")
    deal = F.xxhash64("_deal") if "_deal" in pieces.columns else F.xxhash64("doc_id", "piece")
    keyed = pieces.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(deal, "_salts"))
    sizes = keyed.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(within) - 1).join(bases, ["length", "_salt"])
    ranked = ranked.select(*columns, (F.col("_base") + F.col("_rank")).cast("long").alias("_rank"))
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, end_id: int = 1, capacity: int = CAPACITY, tokenizer: str | None = None, keep_ids: bool = False
) -> DataFrame:
    """Tokenize, cut and pack documents: one row per piece with its sequence and the offset in it."""
    pieces = token_pieces(docs, end_id, capacity, tokenizer, keep_ids).withColumn("_deal", F.monotonically_increasing_id())
    return pack(materialize(pieces, "pieces"), capacity)
