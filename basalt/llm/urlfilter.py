"""URL rules and block lists in one sorted digest array.

All rule and list strings are stored in a file: sorted 64-bit xxhash keys, an offset index, and the full
strings.  A long list comes as a table (``listed``): Spark hashes and sorts it, and the driver writes the file
from the sorted rows as they come, a partition at a time.  Executors fetch the file once (``SparkContext.addFile``), memory-map it, probe a batch's
candidate keys with one vectorised binary search, and confirm every hit on the stored string, so equal
hashes of different strings do no harm.

A url's candidates are its host's suffixes with as many labels as some rule's host, joined with the
path's prefixes as long as some rule's path: few, whatever the number of rules.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; very
long urls are read whole; of equally long rules that fit (a tie) one that blocks wins, then the one with the
longer host; equal rows have equal results; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import ship_package

ALLOW, BLOCK = "allow", "block"
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)
#: Hosts and whole urls that are blocked where no rule fits.
BLOCKED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com")
BLOCKED_URLS: tuple[str, ...] = ()

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def split_url(url: str | None) -> tuple[bytes, bytes]:
    """Host and path as bytes; the host's A-Z are lower-cased."""
    _, mark, rest = (url or "").encode().partition(b"://")
    if not mark:
        return b"", b""
    end = min((k for k in (rest.find(c) for c in b"/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end].translate(_LOWER), rest[end:]
    end = min((k for k in (rest.find(c) for c in b"?#") if k >= 0), default=len(rest))
    return host, rest[:end]


@dataclass(frozen=True)
class DigestArray:
    """The name of a shipped file and the shapes of its rules."""

    name: str
    labels: tuple[int, ...]
    path_lengths: tuple[int, ...]


def digest(s: bytes) -> int:
    """The 64-bit xxhash that Spark's ``xxhash64`` gives, as a signed number."""
    return int.from_bytes(xxhash.xxh64_digest(s, seed=42), "big", signed=True)


class Digests:
    """A memory-mapped digest array."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, dtype="<u8", count=1)[0])
        self.keys = np.memmap(path, dtype="<i8", mode="r", offset=8, shape=(n,)) if n else np.zeros(0, dtype="<i8")
        self.offsets = np.memmap(path, dtype="<u8", mode="r", offset=8 + 8 * n, shape=(n + 1,))
        size = int(self.offsets[n])
        self.text = np.memmap(path, dtype=np.uint8, mode="r", offset=16 + 16 * n, shape=(size,)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def write(path: str, strings: Iterable[bytes]) -> None:
        Digests.write_sorted(path, sorted({(digest(s), s) for s in strings}))

    @staticmethod
    def write_sorted(path: str, rows: Iterable[tuple[int, bytes]]) -> None:
        """The file from keys and strings in the order of keys, held nowhere as a whole."""
        n = at = 0
        with open(f"{path}.keys", "wb+") as keys, open(f"{path}.offsets", "wb+") as offsets, open(f"{path}.text", "wb+") as text:
            for key, s in rows:
                keys.write(key.to_bytes(8, "little", signed=True))
                offsets.write(at.to_bytes(8, "little"))
                text.write(s)
                n, at = n + 1, at + len(s)
            offsets.write(at.to_bytes(8, "little"))
            with open(path, "wb") as f:
                f.write(n.to_bytes(8, "little"))
                for part in (keys, offsets, text):
                    part.seek(0)
                    shutil.copyfileobj(part, f)
        for part in ("keys", "offsets", "text"):
            os.remove(f"{path}.{part}")

    def contains(self, strings: list[bytes]) -> np.ndarray:
        """Whether each string is stored."""
        keys = np.fromiter(map(digest, strings), dtype=np.int64, count=len(strings))
        at = np.searchsorted(self.keys, keys)
        out = np.zeros(len(strings), dtype=bool)
        inside = np.flatnonzero(at < len(self.keys))
        for i in inside[self.keys[at[inside]] == keys[inside]].tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == keys[i] and not out[i]:
                out[i] = self.text[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes() == strings[i]
                k += 1
        return out


def ship_digests(spark: SparkSession, rules=RULES, hosts=BLOCKED_HOSTS, urls=BLOCKED_URLS, listed: DataFrame | None = None) -> DigestArray:
    """Write the digest array and hand it to all executors; ``listed`` (host, url) adds blocked hosts and whole urls."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="basalt-"), name)
    own = [v[0].encode() + b"r" + h.encode() + p.encode() for v, h, p in rules]
    own += [*(b"h" + h.encode() for h in hosts), *(b"u" + u.encode() for u in urls)]
    if listed is None:
        Digests.write(path, own)
    else:
        given = F.explode(F.array(F.concat(F.lit("h"), "host").cast("binary"), F.concat(F.lit("u"), "url").cast("binary"))).alias("s")
        every = listed.select(given).filter("s IS NOT NULL").unionByName(spark.createDataFrame([(bytearray(x),) for x in own], "s binary")).distinct()
        rows = every.select(F.xxhash64("s").alias("k"), "s").orderBy("k", "s").toLocalIterator()
        Digests.write_sorted(path, ((r["k"], bytes(r["s"])) for r in rows))
    spark.sparkContext.addFile(path)
    labels = tuple(sorted({h.count(".") + 1 for _, h, _ in rules}))
    return DigestArray(name, labels, tuple(sorted({len(p.encode()) for _, _, p in rules})))


_open: dict[str, Digests] = {}


def _digests(name: str) -> Digests:
    if name not in _open:
        _open.clear()
        _open[name] = Digests(SparkFiles.get(name))
    return _open[name]


def judge_urls(pages: DataFrame, rules=RULES, hosts=BLOCKED_HOSTS, urls=BLOCKED_URLS, key: str = "page_id", listed: DataFrame | None = None) -> DataFrame:
    """key, host, path, rule (the longest that fits, else null) and verdict of every url."""
    ship_package(pages.sparkSession)
    array = ship_digests(pages.sparkSession, rules, hosts, urls, listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = _digests(array.name)
        for batch in batches:
            probes: list[bytes] = []
            owner: list[tuple[int, bytes, str, int]] = []
            parts = []
            for i, url in enumerate(batch.column(1).to_pylist()):
                host, path = split_url(url)
                parts.append((host, path))
                names = host.split(b".")
                for n in array.labels:
                    if host and n <= len(names):
                        suffix = b".".join(names[-n:])
                        for m in array.path_lengths:
                            if m <= len(path):
                                for verdict in (ALLOW, BLOCK):
                                    probes.append(verdict[0].encode() + b"r" + suffix + path[:m])
                                    owner.append((i, suffix + path[:m], verdict, len(suffix)))
                if host:
                    probes += [b"h" + host, b"u" + url.encode()]
                    owner += [(i, b"", BLOCK, 0)] * 2
            rule: list[bytes | None] = [None] * len(parts)
            verdict = [ALLOW] * len(parts)
            rank = [(0, False, 0)] * len(parts)
            for k in np.flatnonzero(digests.contains(probes)).tolist():
                i, name, said, labels = owner[k]
                if (own := (len(name), said == BLOCK, labels)) > rank[i]:  # a listed host or url ranks below every rule
                    rank[i], rule[i], verdict[i] = own, name or None, said
            texts = [[x.decode() for x in column] for column in zip(*parts, strict=True)] or [[], []]
            arrays = [pa.array(x, pa.string()) for x in (*texts, [None if x is None else x.decode() for x in rule], verdict)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [key, "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "url").mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string")
