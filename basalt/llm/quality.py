"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

On a sample every rule is run on every document and timed; rules are then ordered by how many
documents they reject per second.  Over the table a document leaves at its first failing rule, so the
order changes the cost and ``first_failed``, never the verdict.

Defined results: null, empty and white-space texts have no words and fail ``few_words``; equal rows
have equal results; very long texts are measured whole; rules worth the same (a tie) run in their listed
order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .storage import sample_limit, sampled, ship_package

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
#: Documents on which costs and selectivities are estimated, about.
SAMPLE_DOCUMENTS = 2_000


class Document:
    """Measures of one text, each computed when it is first asked for."""

    def __init__(self, text: bytes):
        self.text = text
        self._known: dict[str, int] = {}

    def __getitem__(self, name: str) -> int:
        if name not in self._known:
            self._known[name] = MEASURES[name](self)
        return self._known[name]

    @property
    def data(self) -> np.ndarray:
        return np.frombuffer(self.text, dtype=np.uint8)


def _n_words(d: Document) -> int:
    return len(d.text.split())


def _word_chars(d: Document) -> int:
    data = d.data
    return int(((data & 0xC0) != 0x80).sum()) - int(K.SPACE[data].sum())


def _n_symbols(d: Document) -> int:
    return len(d.text) - len(d.text.translate(None, SYMBOLS))


def _n_lines(d: Document) -> int:
    return sum(1 for x in d.text.split(b"\n") if x.strip())


def _n_dup_lines(d: Document) -> int:
    lines = [x for x in d.text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _n_repeat_words(d: Document) -> int:
    data = d.data
    starts, ends, _ = K.words(data, np.array([0, len(data)]), K.SPACE)
    runs = K.windows(K.hash_words(data, starts, ends), REPEAT_WINDOW)
    if not len(runs):
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order[1:]] == runs[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(runs), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edge = np.zeros(len(starts) + 1, dtype=np.int64)
    edge[: len(runs)] += again
    edge[REPEAT_WINDOW : REPEAT_WINDOW + len(runs)] -= again
    return int((np.cumsum(edge) > 0).sum())


MEASURES: dict[str, Callable[[Document], int]] = {
    "n_words": _n_words, "word_chars": _word_chars, "n_symbols": _n_symbols,
    "n_lines": _n_lines, "n_dup_lines": _n_dup_lines, "n_repeat_words": _n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """``fails`` is a comparison of integers, so that SQL can state it alike."""

    name: str
    fails: Callable[[Document], bool]
    sql: str


BASE = (
    Rule("few_words", lambda d: d["n_words"] < 20, "n_words < 20"),
    Rule("repetition", lambda d: 100 * d["n_repeat_words"] > 30 * d["n_words"], "100 * n_repeat_words > 30 * n_words"),
)
RULES = (
    *BASE,
    Rule("symbols", lambda d: d["n_symbols"] > d["n_words"], "n_symbols > n_words"),
    Rule("short_words", lambda d: d["word_chars"] < 2 * d["n_words"], "word_chars < 2 * n_words"),
    Rule("long_words", lambda d: d["word_chars"] > 20 * d["n_words"], "word_chars > 20 * n_words"),
    Rule("duplicate_lines", lambda d: 2 * d["n_dup_lines"] > d["n_lines"], "2 * n_dup_lines > n_lines"),
)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> dict[str, tuple[float, float]]:
    """Each rule's mean seconds and rejected share on a sample picked by a hash of the id."""
    ship_package(docs.sparkSession)
    limit = sample_limit(SAMPLE_DOCUMENTS, docs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, float, bool]] = []
            for text in batch.column(1).to_pylist():
                for rule in rules:
                    d = Document(text or b"")
                    began = time.perf_counter()
                    failed = rule.fails(d)
                    rows.append((rule.name, time.perf_counter() - began, failed))
            names, seconds, failed = ([r[k] for r in rows] for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seconds, pa.float64()), pa.array(failed, pa.bool_())], ["rule", "s", "failed"])

    seeded = _texts(docs).withColumn("seed", F.xxhash64("doc_id", F.octet_length("text")))
    picked = seeded.filter(sampled(F.col("seed"), F.lit(limit))).dropDuplicates(["seed"])
    found = picked.select("doc_id", "text").mapInArrow(run, "rule string, s double, failed boolean").groupBy("rule")
    return {r["rule"]: (r["s"], r["f"]) for r in found.agg(F.avg("s").alias("s"), F.avg(F.col("failed").cast("int")).alias("f")).collect()}


def order_rules(rules: tuple[Rule, ...], estimates: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    """Most rejections per second first; unknown rules last, in their order."""
    worth = {k: f / max(s, 1e-9) for k, (s, f) in estimates.items()}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, -1.0)))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept, first_failed, n_run (rules that ran), and the measures asked for.

    Measures that no rule has needed by a document's verdict are computed only if they are asked for.
    """
    ship_package(docs.sparkSession)
    ordered = order_rules(rules, estimate(docs, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, failed, runs = [], [], []
            values: dict[str, list[int]] = {m: [] for m in measures}
            for text in batch.column(1):
                d = Document(text.as_py() or b"")
                at = next((k for k, rule in enumerate(ordered) if rule.fails(d)), None)
                kept.append(at is None)
                failed.append(None if at is None else ordered[at].name)
                runs.append(len(ordered) if at is None else at + 1)
                for m in measures:
                    values[m].append(d[m])
            arrays = [batch.column(0), pa.array(kept, pa.bool_()), pa.array(failed, pa.string()), pa.array(runs, pa.int32())]
            arrays += [pa.array(values[m], pa.int64()) for m in measures]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "kept", "first_failed", "n_run", *measures])

    schema = "doc_id long, kept boolean, first_failed string, n_run int" + "".join(f", {m} long" for m in measures)
    return _texts(docs).mapInArrow(run, schema)
