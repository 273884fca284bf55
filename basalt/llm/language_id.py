"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's features are its words and the 3- and 4-byte subwords of its words (with word borders), hashed
into ``BUCKETS``.  The model averages their embeddings and applies a linear softmax; both are learned by
stochastic gradient descent in numpy on the driver, from a bounded sample of labelled rows (as many of
each language) that executors reduce to bucket counts.  As the average is linear, prediction adds one
integer per class and feature: exact, so a text's result doesn't depend on its batch.

Beside the languages the softmax has a class for everything else.  It learns from noise: pieces of the
sampled texts with their letters shuffled, and random buckets, so that subwords which no learned language
has speak for it.  A temperature and, for each class of text length, a rejection threshold are fitted on
labelled rows and noise that training didn't see.  The score is the calibrated probability of the best
language; a text is rejected if that of all languages together is below its length's threshold (so a text
in two known languages stays) or if it has no letter.

Defined results: null texts and texts without a letter are ``und`` with score 0 and rejected; equal rows
have equal results; very long texts are read whole and judged as the longest class; of languages with one
probability (a tie) the first by name is taken; an empty table gives no rows; other columns are never
read for a prediction, but pass through ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import release_freed, sample_limit, sampled, ship_package

BUCKETS = 1 << 15
DIMENSIONS = 16
#: Labelled rows that are learned from, about; each gives ``PIECES`` runs of 1 to ``PIECE_WORDS`` of its words.
SAMPLE_ROWS = 3_000
PIECES = 4
PIECE_WORDS = 256
EPOCHS = 6
#: Lengths (features) at which the next class of texts begins; each class has a rejection threshold of its own.
LENGTHS = (24, 96, 384)
#: Of calibration texts and of noise, the shares that are left out of account; a threshold lies ``SLACK`` of the way from
#: the texts towards the noise (and so above languages that nobody labelled, which lie between the two).
MOST_REJECTED, MOST_ACCEPTED, SLACK = 0.002, 0.02, 0.1
UNDETERMINED = "und"

_SPACE = np.uint8(0x20)
_LETTERS = np.full(256, _SPACE, dtype=np.uint8)
_LETTERS[0x80:] = np.arange(0x80, 0x100)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[0x20] = True
_FIXED = 1 << 20


def features(data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 3-byte subwords, 4-byte subwords and words: buckets, and where each document's begin (+ the total)."""
    low = _LETTERS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, dtype=np.int64)
    upper = lead[(data[lead + 1] >= 0x80) & (data[lead + 1] <= 0x9E) & (data[lead + 1] != 0x97)] + 1
    low[upper] += 0x20
    starts, ends, first = K.words(low, bounds, _BLANK)
    if not len(starts):
        return [(np.zeros(0, dtype=np.int64), np.zeros(len(bounds), dtype=np.int64))]
    # the words, each between single borders
    length = ends - starts + 1
    to = np.cumsum(length) - length + 1
    packed = np.full(int(length.sum()) + 1, _SPACE, dtype=np.uint8)
    packed[np.repeat(to - starts, ends - starts) + np.flatnonzero(low != _SPACE)] = low[low != _SPACE]
    letters = packed != _SPACE
    b = packed.astype(np.uint32)
    three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    four = three[:-1] | b[3:] << np.uint32(24)
    at3 = np.flatnonzero(letters[1:-1])
    at4 = np.flatnonzero(letters[1:-2] & letters[2:-1])
    shift = np.uint32(32 - 15)
    h3 = ((three[at3] ^ np.uint32(0x9E3779B9)) * np.uint32(0x85EBCA6B)) >> shift
    h4 = ((four[at4] ^ (four[at4] >> np.uint32(15))) * np.uint32(0xC2B2AE35)) >> shift
    hw = K.hash_words(low, starts, ends) >> np.uint64(64 - 15)
    borders = np.append(to, len(packed))[first] - 1
    parts = [(h3, np.searchsorted(at3, borders)), (h4, np.searchsorted(at4, borders)), (hw, first)]
    return [(h.astype(np.int64), at) for h, at in parts]


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x (languages and noise), fixed point
    bias: np.ndarray
    temperature: float
    thresholds: tuple[float, ...]  # one a length class

    def logits(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        rows = len(parts[0][1]) - 1
        n = np.maximum(_lengths(parts), 1)
        out = np.empty((rows, len(self.bias)))
        for k in range(len(self.bias)):
            own = np.ascontiguousarray(self.table[:, k])
            total = np.zeros(rows, dtype=np.int64)
            for buckets, at in parts:
                sums = np.zeros(len(buckets) + 1, dtype=np.int64)
                np.cumsum(own[buckets], out=sums[1:])
                total += sums[at[1:]] - sums[at[:-1]]
            out[:, k] = total / n / _FIXED + self.bias[k]
        return out

    def counted_logits(self, examples: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The same from (buckets, counts) of each text."""
        sums = [(self.table[b] * n[:, None]).sum(axis=0) / n.sum() for b, n in examples]
        return np.array(sums).reshape(-1, len(self.bias)) / _FIXED + self.bias

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Each document's language, score, and whether it is kept."""
        parts = features(data, bounds)
        chance = _softmax(self.logits(parts) / self.temperature)[:, : len(self.languages)]
        best = chance.argmax(axis=1)
        lang = [self.languages[k] for k in best]
        score = chance[np.arange(len(best)), best]
        keep = chance.sum(axis=1) >= np.array(self.thresholds)[np.searchsorted(LENGTHS, _lengths(parts), side="right")]
        ascii_letters = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((_LETTERS[data] != _SPACE) & (data < 0x80), out=ascii_letters[1:])
        for d in np.flatnonzero(ascii_letters[bounds[1:]] == ascii_letters[bounds[:-1]]).tolist():
            text = data[bounds[d] : bounds[d + 1]].tobytes().decode("utf-8", "replace")
            if not any(c.isalpha() for c in text):
                lang[d], score[d], keep[d] = UNDETERMINED, 0.0, False
        return lang, score, keep & (np.array(lang) != UNDETERMINED)


def _lengths(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return sum(np.diff(at) for _, at in parts)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4: fold 2 is held out, fold 3 calibrates, 0 and 1 train."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


@dataclass(frozen=True)
class Example:
    """A piece of a labelled text (or noise: no language) as bucket counts."""

    lang: str | None
    calibrates: bool
    buckets: np.ndarray
    counts: np.ndarray


def _shuffled(piece: str, rng: np.random.Generator) -> str:
    """The same word lengths with the letters dealt out anew."""
    chars = np.array(list(piece))
    letters = np.flatnonzero(~np.char.isspace(chars)) if len(chars) else np.zeros(0, dtype=np.int64)
    chars[letters] = chars[rng.permutation(letters)]
    return "".join(chars)


def _examples(docs: DataFrame, sample_rows: int) -> list[Example]:
    """Pieces of a sample of labelled texts, as many texts of each language, and noise made of them."""
    usable = docs.filter(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2))
    counted = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counted:
        return []
    limits = [(lang, sample_limit(sample_rows / len(counted), n)) for lang, n in counted.items()]
    wanted = docs.sparkSession.createDataFrame(limits, "lang string, _limit long")  # a row a language
    seed = F.xxhash64("doc_id", F.octet_length("text"))
    labelled = usable.select(F.col("lang"), fold(F.col("doc_id")).alias("fold"), seed.alias("seed"), F.col("text").cast("binary").alias("text"))
    picked = labelled.join(F.broadcast(wanted), "lang").filter(sampled(F.col("seed"), F.col("_limit"))).drop("_limit").dropDuplicates(["seed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, f, seed, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = (text or b"").split()
                rng = np.random.default_rng(seed & 0xFFFFFFFF)
                found: list[tuple[bool, tuple[np.ndarray, np.ndarray]]] = []
                for k in range(PIECES if own else 0):
                    n = PIECE_WORDS if k == 0 else int(np.exp(rng.uniform(0, np.log(PIECE_WORDS))))
                    a = int(rng.integers(0, max(len(own) - n, 0) + 1))
                    piece = b" ".join(own[a : a + n])
                    for noise, p in ((False, piece), (True, _shuffled(piece.decode("utf-8", "replace"), rng).encode())):
                        buckets = np.concatenate([h for h, _ in features(np.frombuffer(p, dtype=np.uint8), np.array([0, len(p)]))])
                        if len(buckets) and (not noise or k % 2):
                            found.append((noise, np.unique(buckets, return_counts=True)))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None if noise else lang for noise, _ in found], pa.string())]
                        + [pa.array([x] * len(found), pa.int64()) for x in (f, seed)]
                        + [pa.array([np.minimum(c[k], 65_535).astype("<u2").tobytes() for _, c in found], pa.binary()) for k in (0, 1)],
                        ["lang", "fold", "seed", "buckets", "counts"],
                    )

    pieces = picked.select("lang", "fold", "seed", "text").mapInArrow(run, "lang string, fold long, seed long, buckets binary, counts binary")
    rows = pieces.toArrow().sort_by("seed")  # a text's pieces stay in their order
    out, rng = [], np.random.default_rng(11)
    for lang, f, buckets, counts in zip(*(rows[c] for c in ("lang", "fold", "buckets", "counts")), strict=True):
        own = Example(lang.as_py(), f.as_py() == 3, np.frombuffer(buckets.as_py(), dtype="<u2"), np.frombuffer(counts.as_py(), dtype="<u2"))
        out.append(own)
        if own.lang is None:
            made = np.unique(rng.integers(0, BUCKETS, max(int(own.counts.sum()), 1)), return_counts=True)
            out.append(Example(None, own.calibrates, *(x.astype("<u2") for x in made)))
    return out


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from text and non-null ``lang`` of rows outside fold 2."""
    ship_package(docs.sparkSession)
    model = fit(_examples(docs, sample_rows))
    release_freed(docs.sparkSession)
    return model


def fit(examples: list[Example]) -> LanguageModel:
    """Stochastic gradient descent on the examples that do not calibrate, then calibration on the others."""
    languages = tuple(sorted({e.lang for e in examples if e.lang is not None})) or (UNDETERMINED,)
    number = {x: k for k, x in enumerate((*languages, None))}
    rng = np.random.default_rng(7)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(number))).astype(np.float32)
    bias = np.zeros(len(number), dtype=np.float32)
    learn = [e for e in examples if not e.calibrates]
    for epoch in range(EPOCHS):
        rate = 8.0 * (1 - epoch / EPOCHS)
        order = rng.permutation(len(learn))
        for a in range(0, len(order), 64):
            batch = [learn[i] for i in order[a : a + 64]]
            buckets = np.concatenate([e.buckets for e in batch]).astype(np.int64)
            share = np.concatenate([e.counts / e.counts.sum() for e in batch]).astype(np.float32)
            at = np.cumsum([0, *(len(e.buckets) for e in batch[:-1])])
            mean = np.add.reduceat(table[buckets] * share[:, None], at, axis=0)
            wrong = _softmax(mean @ weights + bias)
            wrong[np.arange(len(batch)), [number[e.lang] for e in batch]] -= 1
            back = wrong @ weights.T
            weights -= rate / len(batch) * mean.T @ wrong
            bias -= 0.1 * rate / len(batch) * wrong.sum(axis=0)
            step = np.repeat(back, [len(e.buckets) for e in batch], axis=0) * share[:, None]
            by = np.argsort(buckets, kind="stable")  # one update a bucket
            opens = np.flatnonzero(np.diff(buckets[by], prepend=-1))
            table[buckets[by[opens]]] -= rate * np.add.reduceat(step[by], opens, axis=0)
    fixed = np.round(table.astype(np.float64) @ weights * _FIXED).astype(np.int64)
    model = LanguageModel(languages, fixed, bias.astype(np.float64), 1.0, (0.0,) * (len(LENGTHS) + 1))
    return calibrate(model, [e for e in examples if e.calibrates])


def calibrate(model: LanguageModel, examples: list[Example]) -> LanguageModel:
    """Fit the temperature by likelihood, then a threshold for each class of lengths.

    Where texts and noise of a length can't be told apart, the threshold is as low as the texts' own values.
    """
    if not examples:
        return model
    number = {x: k for k, x in enumerate((*model.languages, None))}
    logits, known = model.counted_logits([(e.buckets, e.counts) for e in examples]), [number[e.lang] for e in examples]
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 60):
        loss = -np.log(np.maximum(_softmax(logits / t)[np.arange(len(known)), known], 1e-12)).mean()
        if loss < best:
            best, temperature = loss, float(t)
    score = _softmax(logits / temperature)[:, : len(model.languages)].sum(axis=1)
    noise = np.array([e.lang is None for e in examples])
    length = np.searchsorted(LENGTHS, [int(e.counts.sum()) for e in examples], side="right")
    thresholds = []
    for c in range(len(LENGTHS) + 1):
        texts, others = np.sort(score[(length == c) & ~noise]), np.sort(score[(length == c) & noise])
        least = float(texts[int(MOST_REJECTED * len(texts))]) if len(texts) else 0.0
        most = float(others[int((1 - MOST_ACCEPTED) * len(others))]) if len(others) else 0.0
        thresholds.append(least - SLACK * (least - most) if least > most else least * 0.999)
    return LanguageModel(model.languages, model.table, model.bias, temperature, tuple(thresholds))


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score, rejected of every whole text."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in K.blocks(batch, "text"):
                lang, score, keep = model.predict(data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(~keep, pa.bool_())],
                    [key, "lang_pred", "score", "rejected"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col("text").cast("binary").alias("text")).mapInArrow(run, f"{key} {kind}, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows whose language isn't rejected, unchanged."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in K.blocks(batch, "text"):
                yield batch.slice(first, end - first).filter(pa.array(model.predict(data, bounds)[2], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
