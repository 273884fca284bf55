"""Token-id files: zstandard frames per document with a shared trained dictionary.

A shard is one self-contained byte string: magic, id width, dictionary hash, the documents' ids and
lengths, the offset index, then one frame per document.  Shards are written by Spark as rows of a
Parquet table (any store, commits and retries as for other tables), in ascending ``doc_id`` order over
the whole table; ``export_shards`` gives them out as plain files.

Rows are dealt to buckets by cut points of ``doc_id``, one bucket for about ``BUCKET_BYTES`` of text, each a
task that sorts and writes; an id that repeats past a cut point is dealt out over the buckets that it fills.

Defined results: a null text is empty; an empty text holds the end id alone; very long texts are encoded
whole, a frame each; rows of equal ``doc_id`` (a tie; nulls come first) follow each other, in the order of
their compressed bytes within a bucket; an id that doesn't fit into ``id_bytes`` is an error; an empty table
gives an empty file set; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import sample_limit, sampled, shared_folder, ship_package
from .tokenization import default_path, encoder

MAGIC = b"IDZ1"
_HEAD = struct.Struct("<4sBxxxQII")  # magic, bytes an id, dictionary hash, documents, how many of them (the first) have no id
SHARD_BYTES = 4 << 20
#: Text of one bucket, about; there are at most ``MOST_BUCKETS``, so beyond 3 TB they grow.
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 100_000
#: The dictionary is trained on about this many documents, of at most ``SAMPLE_IDS`` ids each.
SAMPLE_DOCUMENTS = 1_000
SAMPLE_IDS = 16_384
DICTIONARY_BYTES = 64 << 10
_LEAST = int(np.iinfo(np.int64).min)


@dataclass(frozen=True)
class TokenFiles:
    """Where a file set lies and what its frames need."""

    path: str
    dictionary: bytes

    @property
    def dictionary_hash(self) -> int:
        return xxhash.xxh64_intdigest(self.dictionary) if self.dictionary else 0


def _zdict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _encode(end_id: int, width: str, path: str, wanted):
    """A mapInArrow function over (doc_id, text): what ``wanted(ids)`` makes of each document's serialized ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list, list[int]]]:
        enc = encoder(path)
        tail = np.array([end_id & np.iinfo(width).max], dtype=width)
        for batch in batches:
            for first, end, data, bounds in K.blocks(batch, "text"):
                ids, at = enc.encode_block(data, bounds)
                if max(int(ids.max(initial=0)), end_id) > np.iinfo(width).max:
                    raise ValueError(f"id {max(int(ids.max(initial=0)), end_id)} does not fit into {tail.itemsize} bytes; take id_bytes=4")
                ids = ids.astype(width)
                made, counts = [], []
                for r in range(end - first):
                    own = ids[at[r] : at[r + 1]].tobytes() + tail.tobytes()
                    made.append(wanted(own))
                    counts.append(len(own) // tail.itemsize)
                yield batch.column(0).slice(first, end - first), made, counts

    return run


def train_dictionary(docs: DataFrame, total: int, end_id: int, width: str, path: str) -> bytes:
    """A dictionary from a bounded sample, picked by a hash; empty where there is too little to learn from."""
    most = SAMPLE_IDS * np.dtype(width).itemsize
    read = _encode(end_id, width, path, lambda own: own if len(own) <= most else None)

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, made, _ in read(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x for x in made if x], pa.binary())], ["ids"])

    seeded = docs.withColumn("seed", F.xxhash64("doc_id", F.octet_length("text")))
    picked = seeded.filter(sampled(F.col("seed"), F.lit(sample_limit(SAMPLE_DOCUMENTS, total)))).dropDuplicates(["seed"]).select("doc_id", "text")
    samples = sorted(bytes(r["ids"]) for r in picked.mapInArrow(serialized, "ids binary").collect())
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if size >= 1024 else b""
    except zstandard.ZstdError:
        return b""


def build_shard(doc_ids: list[int | None], counts: list[int], frames: list[bytes], width: int, dictionary_hash: int) -> bytes:
    """The bytes of one shard; documents without an id come first and are counted in the head."""
    n = len(frames)
    ids = np.array([_LEAST if d is None else d for d in doc_ids], dtype="<i8")
    offsets = np.zeros(n + 1, dtype="<u8")
    offsets[1:] = np.cumsum([len(x) for x in frames])
    head = _HEAD.pack(MAGIC, width, dictionary_hash, n, sum(d is None for d in doc_ids))
    return b"".join([head, ids.tobytes(), np.array(counts, dtype="<u8").tobytes(), offsets.tobytes(), *frames])


class Shard:
    """Reads one shard; a document costs one index probe and one frame."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, self.width, own_hash, n, self.nameless = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token-id shard")
        if own_hash != (xxhash.xxh64_intdigest(dictionary) if dictionary else 0):
            raise ValueError("the shard was written with another dictionary")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(blob, "<i8", n, at)
        self.counts = np.frombuffer(blob, "<u8", n, at + 8 * n)
        self.offsets = np.frombuffer(blob, "<u8", n + 1, at + 16 * n)
        self.payload = memoryview(blob)[at + 16 * n + 8 * (n + 1) :]
        self.reader = zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids_at(self, i: int) -> np.ndarray:
        frame = self.payload[int(self.offsets[i]) : int(self.offsets[i + 1])]
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.width}")

    def document(self, doc_id: int) -> np.ndarray | None:
        i = self.nameless + int(np.searchsorted(self.doc_ids[self.nameless :], doc_id))
        return self.ids_at(i) if i < len(self) and self.doc_ids[i] == doc_id else None


def write_token_files(
    docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, folder: str | None = None, id_bytes: int = 2, level: int = 3
) -> TokenFiles:
    """Encode all documents and write their shards; ``id_bytes`` is 2 for vocabularies under 65,536 ids, else 4."""
    spark = docs.sparkSession
    ship_package(spark)
    path, width = tokenizer or default_path(), f"<u{id_bytes}"
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    total, size = source.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    dictionary = train_dictionary(source, total, end_id, width, path)
    n = min(MOST_BUCKETS, -(-size // BUCKET_BYTES), max(total, 1)) or 1
    shares = [i / n for i in range(1, n)]
    cut = F.percentile_approx(F.coalesce("doc_id", F.lit(_LEAST)), shares, max(10_000, 20 * n))
    edges = np.array((source.agg(cut).first()[0] if n > 1 else None) or [], dtype=np.int64)  # an id that fills buckets repeats
    files = TokenFiles(folder or f"{shared_folder(spark)}/basalt/ids-{uuid.uuid4().hex}", dictionary)
    known, buckets = files.dictionary_hash, len(edges) + 1

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = zstandard.ZstdCompressor(level=level, dict_data=_zdict(dictionary))
        before = 0
        for doc_ids, frames, counts in _encode(end_id, width, path, writer.compress)(batches):
            own = doc_ids.fill_null(_LEAST).to_numpy()
            first, end = (np.searchsorted(edges, own, side=side) for side in ("left", "right"))
            bucket = first + (before + np.arange(len(own))) % np.maximum(end - first, 1)
            before += len(own)
            arrays = [pa.array(bucket, pa.int32()), doc_ids, pa.array(counts, pa.int64()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["bucket", "doc_id", "n_tokens", "frame"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "shard", "first_doc", "last_doc", "n_docs", "first_token", "n_tokens", "blob"]
        kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
        bucket, part, before, size = None, 0, 0, 0
        ids: list = []
        counts: list[int] = []
        frames: list[bytes] = []

        def flush() -> pa.RecordBatch:
            blob = build_shard(ids, counts, frames, id_bytes, known)
            row = [bucket, part, ids[0], ids[-1], len(ids), before, sum(counts), blob]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for b, d, c, f in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if frames and (b != bucket or size >= SHARD_BYTES):
                    yield flush()
                    part, before = (part + 1, before + sum(counts)) if b == bucket else (0, 0)
                    ids, counts, frames, size = [], [], [], 0
                bucket = b
                ids.append(d)
                counts.append(c)
                frames.append(f)
                size += len(f)
        if frames:
            yield flush()

    schema = "bucket int, shard long, first_doc long, last_doc long, n_docs long, first_token long, n_tokens long, blob binary"
    made = source.mapInArrow(compressed, "bucket int, doc_id long, n_tokens long, frame binary")
    placed = made.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "frame")
    placed.mapInArrow(shards, schema).write.parquet(files.path)
    return files


def _shards(spark: SparkSession, files: TokenFiles) -> DataFrame:
    return spark.read.parquet(files.path)


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Each document read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (32-bit)."""
    ship_package(spark)
    dictionary = files.dictionary
    table = _shards(spark, files)
    totals = table.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("bucket", F.coalesce(before, F.lit(0)).alias("base"))  # a row for each bucket: at most ``MOST_BUCKETS``
    opened = table.join(F.broadcast(bases), "bucket").select((F.col("base") + F.col("first_token")).alias("first_token"), "blob")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(blob, dictionary)
                starts = first + np.cumsum(shard.counts.astype(np.int64)) - shard.counts.astype(np.int64)
                for a in range(0, len(shard), 256):
                    at = range(a, min(a + 256, len(shard)))
                    ids = [shard.ids_at(i).astype("<u4").tobytes() for i in at]
                    own = [None if i < shard.nameless else x for i, x in zip(at, shard.doc_ids[a : a + 256].tolist(), strict=True)]
                    columns = [own, starts[a : a + 256].tolist(), [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids]]
                    arrays = [pa.array(x, pa.int64()) for x in columns] + [pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return opened.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_document(spark: SparkSession, files: TokenFiles, doc_id: int) -> np.ndarray | None:
    """One document's ids: the table's statistics leave the shards that may hold it, the index finds its frame."""
    reach = (F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id)) & (F.col("last_doc") >= doc_id)  # null ids come first
    near = _shards(spark, files).filter(reach).select("blob")
    for row in near.toLocalIterator():
        if (ids := Shard(bytes(row["blob"]), files.dictionary).document(doc_id)) is not None:
            return ids.astype(np.uint32)
    return None


def export_shards(spark: SparkSession, files: TokenFiles, folder: str | Path) -> list[Path]:
    """Give out the shards, one at a time, as plain files beside the dictionary."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "dictionary.zdict").write_bytes(files.dictionary)
    out = []
    for k, row in enumerate(_shards(spark, files).orderBy("bucket", "shard").select("blob").toLocalIterator()):
        out.append(folder / f"{k:08d}.idz")
        out[-1].write_bytes(bytes(row["blob"]))
    return out
