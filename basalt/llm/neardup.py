"""Near-duplicate classes: banded MinHash, odd sketches, exact confirmation, connected components.

1. Every document gets the set of its word shingles, ``HASHES`` MinHash samples, band keys, and an odd
   sketch: a parity bitmap into which the samples are folded.  Two sketches differ in at most twice as
   many bits as samples differ, so the population count of their XOR bounds how unlike two sets are.
2. Documents of equal sets (copies) are one class at once; one row of each set goes on.
3. Sets that share a band key meet in a bucket.  There, pairs of different classes whose sketches are
   near enough are confirmed on the full sets; a bucket gives a spanning forest of its links, never all
   pairs.  The first bands join most near copies; later bands only open buckets that still hold two classes.
4. A bucket of over ``BUCKET`` sets (or ``BUCKET_HASHES`` hashes in them) is first cut into chunks that all hold the bucket's first set.  What is
   then outside the bucket's largest class asks all of the bucket, block against block: a task holds at most
   about ``BUCKET`` askers and ``BUCKET`` others, of sizes that can be alike.  A first round compares sketches
   alone; only sets with a partner near enough by sketch bring their full sets to a second one.  So no link
   is lost, no task grows with the bucket, and what clouds of unlike sets cost is sketches.
5. Links become components by alternating large-star and small-star steps on written tables.

With 24 bands of 5 rows a pair shares no band with probability 8e-7 at similarity 0.85, 7e-5 at 0.80.
Sets are told apart by a 128-bit digest of their sorted shingle hashes, shingles by 64-bit hashes.

Defined results: documents without words (null, empty, white space) have an empty set, are linked with
nothing and are their own component; very long texts give their whole set; equal rows share all values; of a
class (a tie) the smallest id is kept, and rows without an id are all kept; an empty table gives no rows; other columns are
ignored, but pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import discard, materialize, ship_package

SHINGLE = 5
BANDS, ROWS = 24, 5
HASHES = BANDS * ROWS
FIRST_BANDS = 6
SKETCH_BITS = 1024
#: Sets, and shingle hashes in them, that one task holds against each other, about.
BUCKET, BUCKET_HASHES = 2048, 1 << 21
#: Ids that may be broadcast (16 MB); beyond it the join shuffles.
BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 64, HASHES, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1)
_ROUND = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document of a block."""
    low = K.LOWER[data]
    starts, ends, first = K.words(low, bounds, K.SPACE)
    hashes = K.hash_words(low, starts, ends)
    runs = K.windows(hashes, SHINGLE)
    for d in range(len(bounds) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= SHINGLE:
            yield np.unique(runs[a : b - SHINGLE + 1])
        elif b > a:
            yield K.windows(hashes[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield np.zeros(0, dtype=np.uint64)


def fingerprint(own: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def samples(own: np.ndarray) -> np.ndarray:
    """MinHash samples of a set; long sets go in pieces."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(own), 4096):
        part = own[a : a + 4096, None]
        np.minimum(least, ((part ^ _XOR) * _ODD).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.zeros((len(least), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        key = K.mix(key + least[:, r::ROWS])
    return key.view(np.int64)


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """Parity bitmaps, a row of 128 bytes for each row of samples."""
    bit = (K.mix(least ^ _ROUND) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flat = bit + np.arange(len(least))[:, None] * SKETCH_BITS
    odd = np.bincount(flat.ravel(), minlength=len(least) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).reshape(len(least), -1)


def most_differing(percent: int) -> int:
    """Samples in which two sets of that similarity may differ: six standard deviations over the mean."""
    share = 1 - percent / 100
    return int(np.ceil(HASHES * share + 6 * np.sqrt(HASHES * share * (1 - share))))


def sketch_similarity(a: bytes, b: bytes) -> float:
    """Similarity estimated from two odd sketches: n bits, k samples, d differing bits."""
    d = int(np.bitwise_count(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).sum())
    if 2 * d >= SKETCH_BITS:
        return 0.0
    return max(0.0, 1 + SKETCH_BITS / (4 * HASHES) * np.log(1 - 2 * d / SKETCH_BITS))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (null for empty sets), bands, sketch of each document."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in K.blocks(batch, "text"):
                sets = list(shingle_sets(data, bounds))
                least = np.array([samples(x) for x in sets])
                sketch = odd_sketches(least)
                full = [len(x) > 0 for x in sets]
                keys = band_keys(least)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array([len(x) for x in sets], pa.int64()),
                     pa.array([fingerprint(x) if f else None for x, f in zip(sets, full, strict=True)], pa.binary()),
                     pa.array([k if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                     pa.array([s.tobytes() if f else None for s, f in zip(sketch, full, strict=True)], pa.binary())],
                    ["doc_id", "n_shingles", "fp", "bands", "sketch"],
                )

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, fp binary, bands array<long>, sketch binary")


def full_sets(docs: DataFrame) -> DataFrame:
    """fp and the sorted 64-bit shingle hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in K.blocks(batch, "text"):
                sets = list(shingle_sets(data, bounds))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fingerprint(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                    ["fp", "hashes"],
                )

    return _texts(docs).mapInArrow(run, "fp binary, hashes binary")


def _views(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Binary values as 64-bit words, where they lie."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        words = np.frombuffer(data, dtype=np.uint64, count=int(at[-1]) // 8) if data is not None else np.zeros(0, dtype=np.uint64)
        out += [words[a:b] for a, b in zip((at[:-1] // 8).tolist(), (at[1:] // 8).tolist(), strict=True)]
    return out


def link_bucket(table: pa.Table, percent: int) -> pa.Table:
    """A spanning forest of the confirmed links between the classes in one bucket.

    Rows: node, class, asks, sketch, hashes.  Only pairs with a row that asks are held against each other.
    """
    node = table["node"].to_numpy()
    order = np.argsort(node, kind="stable")
    node = node[order]
    _, group = np.unique(table["class"].to_numpy()[order], return_inverse=True)
    asks = table["asks"].to_numpy(zero_copy_only=False)[order]
    sketches, hashes = _views(table["sketch"]), _views(table["hashes"])
    sketch = np.stack([sketches[i] for i in order])
    sets = [hashes[i] for i in order]
    size = np.array([len(x) for x in sets])
    links: list[tuple[int, int]] = []
    most = 2 * most_differing(percent)
    for i in range(1, len(node)):
        other = group[:i] != group[i]
        if not asks[i]:
            other &= asks[:i]
        near = np.flatnonzero(other & (100 * np.minimum(size[:i], size[i]) >= percent * np.maximum(size[:i], size[i])))
        if not len(near):
            continue
        differ = np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1)
        near, differ = near[differ <= most], differ[differ <= most]
        for j in near[np.argsort(differ, kind="stable")].tolist():
            if group[i] == group[j]:
                continue
            at = np.minimum(np.searchsorted(sets[j], sets[i]), size[j] - 1)
            both = int((sets[j][at] == sets[i]).sum())
            if 100 * both >= percent * (size[i] + size[j] - both):
                links.append((int(node[i]), int(node[j])))
                group[group == group[j]] = group[i]
    a, b = ([x[k] for x in links] for k in (0, 1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_by_sketch(table: pa.Table, percent: int) -> pa.Table:
    """The nodes of one block (node, class, asks, size, sketch) that an asker of another class may be alike to, and these askers."""
    group, size, asks = (table[c].to_numpy(zero_copy_only=False) for c in ("class", "size", "asks"))
    sketch = np.stack(_views(table["sketch"]))
    found = np.zeros(len(group), dtype=bool)
    most = 2 * most_differing(percent)
    for i in np.flatnonzero(asks):
        others = np.flatnonzero((group != group[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
        near = others[np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1) <= most]
        found[near] = True
        found[i] |= len(near) > 0
    rows = table.filter(pa.array(found))
    return pa.table({c: rows[c] for c in ("band", "key", "node")})


def components(links: DataFrame) -> DataFrame:
    """node, class (least node of its component) of all nodes with a link, by large-star and small-star steps."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        last, edges = edges, materialize(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")
        discard(last)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == state:
            break
        before = state
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("class", F.col("node"))
    out = materialize(edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(roots), "classes")
    discard(edges)
    return out


def _semi(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` by a table of distinct ids; it is broadcast only if it is small."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", how)


def _in_buckets(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of rows (band, key, chunk, node, fp, class, asks)."""

    def run(table: pa.Table) -> pa.Table:
        return link_bucket(table, percent)

    return rows.join(sets, "fp").groupBy("band", "key", "chunk").applyInArrow(run, "a long, b long")


def _with_classes(members: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        return members.withColumn("class", F.col("node"))
    return members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))


def _parts(n: Column, hashes: Column) -> Column:
    """Into how many parts so many sets with so many hashes go."""
    return F.greatest(F.ceil(n / BUCKET), F.ceil(hashes / BUCKET_HASHES)).cast("long")


def _in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (band, key, node, size, asks and others) dealt to blocks (band, key, chunk) in which askers meet all that can be alike.

    Sizes fall into cells so that alike sets lie in one cell or in neighbours; askers and others of a cell are each
    dealt to parts of about ``BUCKET``, and every part of askers meets every part of others of the cells around.
    """
    # a little wide, so that rounding never puts alike sizes two cells apart
    cell = F.floor(F.log("size") / float(1.0001 * np.log(100 / percent))).cast("int") if percent < 100 else F.col("size").cast("int")
    celled = rows.withColumn("_cell", cell)
    asking = F.col("asks").cast("long")
    cells = celled.groupBy("band", "key", "_cell").agg(
        _parts(F.count("*"), F.sum("size")).alias("_others"), _parts(F.sum(asking), F.sum(asking * F.col("size"))).alias("_askers")
    )
    beside = F.explode(F.array(*[F.col("_cell") + d for d in (-1, 0, 1)]))
    here = ["band", "key", "_cell"]

    def meeting(own: DataFrame, mine: str, theirs: str, asks: bool) -> DataFrame:
        numbered = own.join(cells.select(*here, F.col(mine).alias("_n")), here).withColumn("_i", F.pmod(F.xxhash64("node"), "_n")).drop("_n")
        there = cells.filter(F.col(theirs) > 0).select("band", "key", F.col("_cell").alias("_there"), F.col(theirs).alias("_m"))
        met = numbered.withColumn("_there", beside).join(there, ["band", "key", "_there"])
        met = met.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
        side = [F.col(c) for c in (("_cell", "_i", "_there", "_j") if asks else ("_there", "_j", "_cell", "_i"))]
        return met.select(*rows.drop("asks").columns, F.lit(asks).alias("asks"), F.xxhash64(*side).alias("chunk"))

    askers = meeting(celled.filter("asks"), "_askers", "_others", True)
    return askers.unionByName(meeting(celled, "_others", "_askers", False))


def _asked(large: DataFrame, sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of oversized buckets that are alike, by sketch, to a member of another class, with what asks."""
    now = _with_classes(large, classes)
    per = now.groupBy("band", "key", "class").agg(F.count("*").alias("c"))
    main = per.groupBy("band", "key").agg(F.max_by("class", F.struct("c", "class")).alias("main"))
    return now.join(main, ["band", "key"]).withColumn("asks", F.col("class") != F.col("main")).drop("main").join(sketches, "fp")


def _confirmed(members: DataFrame, sets: DataFrame, classes: DataFrame | None, percent: int) -> tuple[DataFrame, DataFrame]:
    """All links so far found within the buckets of ``members``, and the classes they make with ``classes``."""
    known = _with_classes(members, classes)
    two = known.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("class").alias("x"), F.max("class").alias("y"), F.min("node").alias("first"), _parts(F.count("*"), F.sum("size")).alias("parts"))
    live = known.join(two.filter("x <> y").select("band", "key", "parts", "first"), ["band", "key"])
    chunks = F.col("parts")
    dealt = live.withColumn("chunk", F.when(chunks > 1, F.pmod(F.xxhash64("node"), chunks)).otherwise(F.lit(0).cast("long")))
    head = live.filter((chunks > 1) & (F.col("node") == F.col("first"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1)))
    columns = ["band", "key", "chunk", "node", "fp", "class"]
    rows = dealt.select(columns).unionByName(head.select(columns)).distinct().withColumn("asks", F.lit(True))
    found = materialize(_in_buckets(rows, sets, percent).distinct(), "links")
    old = None if classes is None else classes.filter("node <> class").select(F.col("node").alias("a"), F.col("class").alias("b"))
    all_links = lambda x: x if old is None else x.unionByName(old)
    made = components(all_links(found))
    large = live.filter(chunks > 1).select("band", "key", "node", "fp", "size")
    if large.isEmpty():
        return found, made

    def near(table: pa.Table) -> pa.Table:
        return near_by_sketch(table, percent)

    asked = materialize(_asked(large, sets.select("fp", "sketch"), made), "asked")
    blocks = _in_blocks(asked.drop("fp"), percent).groupBy("band", "key", "chunk")
    alike = materialize(blocks.applyInArrow(near, "band int, key long, node long").distinct(), "alike")
    left = asked.drop("sketch").join(alike, ["band", "key", "node"])
    late = materialize(found.unionByName(_in_buckets(_in_blocks(left, percent).select(*columns, "asks"), sets, percent)).distinct(), "links")
    both = components(all_links(late))
    discard(found, made, asked, alike)
    return late, both


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    signed = materialize(signatures(docs), "signatures")
    sets_of = signed.filter("fp is not null").groupBy("fp")
    distinct = materialize(sets_of.agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size")).filter("node is not null"), "distinct")
    keys = distinct.select("node", "fp", "size", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(keys.join(shared.drop("n"), ["band", "key"]).select("band", "key", "node", "fp", "size").hint("rebalance"), "members")
    wanted = members.select(F.col("node").alias("doc_id"), "fp").distinct()
    ids = materialize(wanted.select("doc_id").distinct(), "wanted")
    texts = _semi(docs.select("doc_id", "text"), ids)
    own = full_sets(texts).dropDuplicates(["fp"]).join(distinct.select("fp", "sketch"), "fp")
    sets = materialize(own, "sets")
    first, early = _confirmed(members.filter(F.col("band") < FIRST_BANDS), sets, None, percent)
    rest, classes = _confirmed(members.filter(F.col("band") >= FIRST_BANDS), sets, early, percent)
    discard(members, ids, sets, first, rest, early)  # the result reads signatures, distinct sets and classes
    final = _with_classes(distinct.select("fp", "node"), classes).select("fp", F.col("class").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "fp").join(final, "fp", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One document of each class, with the input's columns; rows of one id that repeat stay once."""
    judged = materialize(near_duplicates(docs, percent), "judged")
    gone = judged.filter("not kept").select("doc_id").distinct()
    left = _semi(docs, gone, "left_anti")
    again = judged.filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if again.isEmpty():
        return left
    order = Window.partitionBy("doc_id").orderBy(F.col("text").desc_nulls_last())
    n = f"_n_{uuid.uuid4().hex}"
    once = _semi(left, again).withColumn(n, F.row_number().over(order)).filter(F.col(n) == 1).drop(n)
    return _semi(left, again, "left_anti").unionByName(once.select(left.columns))
