"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Words of items are numbered; the automaton of a block of items (built item by item, so no match runs
across two items) is written as plain arrays to a file, which every executor maps into memory.  Training
text is mapped to word numbers by numpy.  Runs of words that items know, at least as long as the shortest
window, are cut into segments that overlap by a window less one word; all segments of a block of text
walk the automaton in step, which gives the longest matching length at every word.

Items are taken in blocks of ``BLOCK_WORDS`` words: the driver and the builder hold one block at a time, and a
worker reads a batch of documents once and holds it against block after block.  What all blocks hit is
laid together before a document is judged, so results do not depend on the blocks, and memory does not
grow with the number of items; disk does (the files), and time.

Defined results: null and empty texts have no words and no hits; very long texts are read whole; items
without words match nothing; equal items all count; spans that overlap or touch (a tie of items) become
one; an empty table of items leaves every document clean; an empty table of documents gives no rows; other columns pass
through ``decontaminate`` unread, but for ``n_chars``, which follows the text.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import ship_package

WINDOW = 10
#: Words of items in one automaton; it has at most twice as many states.
BLOCK_WORDS = 200_000
#: A document is dropped if more of its words than this are hit; else the hit spans are cut out.
MAX_COVERAGE = 0.5
#: Words of a run that one segment walks, besides the overlap.
SEGMENT = 32


def item_words(text: bytes) -> list[bytes]:
    """The words of a normalised text: ASCII lower case, runs of digits, letters and non-ASCII bytes."""
    data = np.frombuffer(text, dtype=np.uint8)
    low = K.LOWER[data]
    low = np.where(K.NOT_ALNUM[low], np.uint8(0x20), low)
    return low.tobytes().split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows that each state ends: the builder."""

    def __init__(self, items: list[tuple[str, list[int]]], size: int = WINDOW):
        self.size = size
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, own in items:
            last = 0
            for w in own:
                last = self._extend(last, w)
        #: state of a window -> items that hold it; short items are windows of their own length
        self.items: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.names = [name for name, _ in items]
        self.least = min([size, *(len(own) for _, own in items if own)])
        for k, (_, own) in enumerate(items):
            if own and len(own) < size:
                state = 0
                for w in own:
                    state = self.next[state][w]
                self.short.setdefault(state, []).append((len(own), k))
            else:
                state, n = 0, 0
                for w in own:
                    state, n = self.step(state, n, w)
                    if n >= size:
                        held = self.items.setdefault(self.window_state(state), [])
                        if not held or held[-1] != k:
                            held.append(k)
        # nearest state up the links, itself included, that ends a short item
        self.shorter = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.shorter[s] = s if s in self.short else self.shorter[self.link[s]]

    def _extend(self, last: int, w: int) -> int:
        follow, link, length = self.next, self.link, self.length
        if w in follow[last]:
            q = follow[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(link)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in follow[p]:
            follow[p][w] = new
            p = link[p]
        if p >= 0:
            q = follow[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """The longest suffix of what was read, with w, that occurs in an item: its state and length."""
        while state and w not in self.next[state]:
            state = self.link[state]
            n = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], n + 1
        return 0, 0

    def window_state(self, state: int) -> int:
        """The state of the last ``size`` words of a match that is at least so long."""
        while self.length[self.link[state]] >= self.size:
            state = self.link[state]
        return state


def _spread(lists: dict[int, list], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists by state as sorted states, where each one's rows begin (+ the total), and all rows."""
    states = sorted(lists)
    begins = np.cumsum([0, *(len(lists[s]) for s in states)])
    rows = np.array([x for s in states for x in lists[s]], dtype=np.int64).reshape(-1, width)
    return np.array(states, dtype=np.int64), begins.astype(np.int64), rows


def write_automaton(path: str, items: list[tuple[str, bytes]], size: int = WINDOW) -> None:
    """Build one block's automaton and write it: a line that tells where each array lies, then the arrays."""
    split = [(name, item_words(text)) for name, text in items]
    split = [(name, own) for name, own in split if own]
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for _, own in split for w in own))}
    made = Automaton([(name, [vocabulary[w] for w in own]) for name, own in split], size)
    joined = np.frombuffer(b" ".join(vocabulary), dtype=np.uint8)
    starts, ends, _ = K.words(joined, np.array([0, len(joined)]), K.SPACE)
    hashes = K.hash_words(joined, starts, ends)
    order = np.argsort(hashes)
    edges = np.array([(s * len(vocabulary) + w, to) for s, follow in enumerate(made.next) for w, to in follow.items()], dtype=np.int64).reshape(-1, 2)
    edges = edges[np.argsort(edges[:, 0])]
    top = [made.window_state(s) if made.length[s] >= size else -1 for s in range(len(made.link))]
    arrays = {"hashes": hashes[order], "numbers": order.astype(np.int64), "text": joined, "starts": starts.astype(np.int64), "ends": ends.astype(np.int64)}
    arrays |= {"edge": edges[:, 0].copy(), "to": edges[:, 1].copy(), "link": np.array(made.link), "length": np.array(made.length), "top": np.array(top), "shorter": np.array(made.shorter)}
    arrays |= dict(zip(("win_state", "win_at", "win_item"), _spread({s: [(k,) for k in own] for s, own in made.items.items()}, 1), strict=True))
    arrays |= dict(zip(("short_state", "short_at", "short_item"), _spread(made.short, 2), strict=True))
    arrays["names"] = np.frombuffer(json.dumps(made.names).encode(), dtype=np.uint8)
    at, places = 0, {}
    for name, x in arrays.items():
        places[name] = (at, str(x.dtype), x.shape)
        at += -(-x.nbytes // 8) * 8
    line = json.dumps({"size": size, "least": made.least, "places": places}).encode()
    with open(path, "wb") as f:
        f.write(len(line).to_bytes(8, "little") + line + b" " * (-len(line) % 8))
        for x in arrays.values():
            f.write(x.tobytes() + bytes(-x.nbytes % 8))


class Matcher:
    """One block's automaton, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            n = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(n))
        raw = np.memmap(path, dtype=np.uint8, mode="r", offset=0)
        base = 8 + n + (-n % 8)
        for name, (at, kind, shape) in head["places"].items():
            own = np.dtype(kind)
            setattr(self, name, raw[base + at : base + at + own.itemsize * int(np.prod(shape))].view(own).reshape(shape))
        self.size, self.least = head["size"], head["least"]
        self.item_names = json.loads(self.names.tobytes())

    def _step(self, state: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest suffixes of what was read, with words w, that occur in an item: their states and lengths."""
        out, reach = np.zeros_like(state), np.zeros_like(n)
        v = len(self.numbers)
        open_ = np.arange(len(state))
        while len(open_):
            key = state[open_] * v + w[open_]
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[at] == key
            done = open_[hit]
            out[done], reach[done] = self.to[at[hit]], n[done] + 1
            open_ = open_[~hit & (state[open_] > 0)]
            state[open_] = self.link[state[open_]]
            n[open_] = self.length[state[open_]]
        return out, reach

    def _same(self, number: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> bool:
        """Whether words a to b are the items' words that their hashes stand for."""
        for k in range(a, b):
            w = number[k]
            if text[starts[k] : ends[k]] != self.text[self.starts[w] : self.ends[w]].tobytes():
                return False
        return True

    def hits(self, low: np.ndarray, text: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
        """Document, first and end word of a hit, and the items whose windows it is; words of a block as ``K.words`` gives them."""
        if not len(self.hashes) or not len(starts):
            return
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        number = np.where(self.hashes[at] == hashes, self.numbers[at], -1)
        # runs of known words within one document, cut into segments
        known = number >= 0
        opens = known.copy()
        opens[1:] &= ~known[:-1]
        inner = first[:-1][first[:-1] < len(known)]
        opens[inner] |= known[inner]
        begin = np.flatnonzero(opens)
        breaks = np.sort(np.concatenate([np.flatnonzero(~known), first, [len(known)]]))
        end = breaks[np.searchsorted(breaks, begin, side="right")]
        long_ = end - begin >= self.least
        begin, end = begin[long_], end[long_]
        parts = -(-(end - begin) // SEGMENT)
        which = np.repeat(np.arange(len(begin)), parts)
        part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        stop = np.minimum(begin[which] + (part + 1) * SEGMENT, end[which])
        pos = np.maximum(begin[which] + part * SEGMENT - (self.size - 1), begin[which])
        state, n = np.zeros(len(pos), dtype=np.int64), np.zeros(len(pos), dtype=np.int64)
        while len(pos):
            state, n = self._step(state, n, number[pos])
            for i in np.flatnonzero((n >= self.size) | (self.shorter[state] > 0)).tolist():
                yield from self._at(int(state[i]), int(n[i]), int(pos[i]) + 1, number, text, starts, ends, first)
            pos += 1
            on = pos < stop
            pos, stop, state, n = pos[on], stop[on], state[on], n[on]

    def _at(self, state: int, n: int, end: int, number, text, starts, ends, first) -> Iterator[tuple[int, int, int, list[int]]]:
        found: list[tuple[int, list[int]]] = []
        if n >= self.size:
            k = int(np.searchsorted(self.win_state, self.top[state]))
            found.append((self.size, self.win_item[self.win_at[k] : self.win_at[k + 1], 0].tolist()))
        s = int(self.shorter[state])
        while s > 0:
            k = int(np.searchsorted(self.short_state, s))
            for m, item in self.short_item[self.short_at[k] : self.short_at[k + 1]].tolist():
                if m <= n:
                    found.append((m, [item]))
            s = int(self.shorter[self.link[s]])
        if found:
            d = int(np.searchsorted(first, end - 1, side="right")) - 1
            for m, items in found:
                if self._same(number, text, starts, ends, end - m, end):
                    yield d, end - m, end, items


def item_blocks(items: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """(item_id, text) in blocks of bounded size, streamed through the driver."""
    block: list[tuple[str, bytes]] = []
    words = 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t")).toLocalIterator():
        text = bytes(r["t"] or b"")
        block.append((r["i"] or "", text))
        words += len(text) // 5 + 1
        if words >= BLOCK_WORDS:
            yield block
            block, words = [], 0
    if block:
        yield block


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals in order; overlapping or touching ones become one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def ship_automata(items: DataFrame, size: int = WINDOW) -> list[str]:
    """Write each block's automaton and hand the files to all executors: their names."""
    folder, names = tempfile.mkdtemp(prefix="basalt-"), []
    for block in item_blocks(items):
        names.append(f"automaton-{uuid.uuid4().hex}.bin")
        path = os.path.join(folder, names[-1])
        write_automaton(path, block, size)
        items.sparkSession.sparkContext.addFile(path)
    return names


def judged(names: list[str], data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], list[str], np.ndarray, np.ndarray]]:
    """Per document of a block of text: words, merged hit word intervals, items, starts and ends of its words."""
    low = K.LOWER[data]
    starts, ends, first = K.words(low, bounds, K.NOT_ALNUM)
    hashes, text = K.hash_words(low, starts, ends), low.tobytes()
    spans: list[list[tuple[int, int]]] = [[] for _ in range(len(bounds) - 1)]
    found: list[set[str]] = [set() for _ in range(len(bounds) - 1)]
    for name in names:
        matcher = Matcher(SparkFiles.get(name))
        for d, a, b, items in matcher.hits(low, text, starts, ends, first, hashes):
            a, b = a - int(first[d]), b - int(first[d])
            if spans[d] and spans[d][-1][0] <= a <= spans[d][-1][1]:
                spans[d][-1] = (spans[d][-1][0], max(b, spans[d][-1][1]))
            else:
                spans[d].append((a, b))
            found[d].update(matcher.item_names[k] for k in items)
    for d in range(len(bounds) - 1):
        yield int(first[d + 1] - first[d]), merged_spans(spans[d]), sorted(found[d]), starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]]


def find_contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, spans (byte intervals that hits cover), n_hit, items (sorted item ids)."""
    ship_package(docs.sparkSession)
    names = ship_automata(items, size)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, n_words long, spans array<struct<a:long,b:long>>, n_hit long, items array<string>"
    pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in K.blocks(batch, "text"):
                n_words, spans, n_hit, items_ = [], [], [], []
                for d, (n, got, found, starts, ends) in enumerate(judged(names, data, bounds)):
                    n_words.append(n)
                    spans.append([{"a": int(starts[a] - bounds[d]), "b": int(ends[b - 1] - bounds[d])} for a, b in got])
                    n_hit.append(sum(b - a for a, b in got))
                    items_.append(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(n_words, pa.int64()), pa.array(spans, pair), pa.array(n_hit, pa.int64()), pa.array(items_, pa.list_(pa.string()))],
                    ["doc_id", "n_words", "spans", "n_hit", "items"],
                )

    return source.mapInArrow(run, schema)


def contamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest of each document: n_words, n_hit, n_items, items_sha256, contaminated."""
    return find_contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """Documents without benchmark passages, with the input's columns.

    A document with more than ``max_coverage`` of its words hit is dropped; from others the hit spans
    are cut out.  Clean documents are not changed.  ``n_chars``, if there, follows the text.
    """
    ship_package(docs.sparkSession)
    names = ship_automata(items, size)
    schema = docs.schema
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in K.blocks(batch, "text"):
                keep, changed = [], {}
                for d, (n, got, _, starts, ends) in enumerate(judged(names, data, bounds)):
                    if got and sum(b - a for a, b in got) > max_coverage * n:
                        continue
                    keep.append(d)
                    if got:
                        parts, since = [], int(bounds[d])
                        for a, b in got:
                            parts.append(data[since : starts[a]].tobytes())
                            since = int(ends[b - 1])
                        parts.append(data[since : bounds[d + 1]].tobytes())
                        changed[len(keep) - 1] = b"".join(parts).decode()
                part = batch.slice(first, end - first).take(pa.array(keep, pa.int64()))
                if changed:
                    columns = list(part.columns)
                    columns[at] = pa.array([changed.get(i, x) for i, x in enumerate(columns[at].to_pylist())], columns[at].type)
                    if counted is not None:
                        old = columns[counted].to_pylist()
                        columns[counted] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(old)], columns[counted].type)
                    part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
                yield part

    return docs.mapInArrow(run, schema) if names else docs


def items_digest(names: list[str]) -> str:
    """The digest column for a list of item ids, for tests and readers."""
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
