"""Scrolling cursors: a numbered table, of which each fetch reads a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators.recursive import round_table
from basalt.sources.mutable import number_rows


class Cursor:
    """Rows of a query in its order; positions run from 1, 0 is before the first."""

    def __init__(self, df: DataFrame, *order: Column | str):
        self.columns = df.columns
        self.rows = round_table(number_rows(df, "_row", 1, 1, *order))
        self.size = self.rows.count()
        self.position = 0

    def _range(self, first: int, last: int, down: bool = False) -> DataFrame:
        order = F.desc("_row") if down else F.asc("_row")
        return self.rows.filter(F.col("_row").between(first, last)).orderBy(order).select(*self.columns)

    def _to(self, position: int) -> DataFrame:
        self.position = min(max(position, 0), self.size + 1)
        return self._range(self.position, self.position)

    def next(self) -> DataFrame:
        return self._to(self.position + 1)

    def prior(self) -> DataFrame:
        return self._to(self.position - 1)

    def first(self) -> DataFrame:
        return self._to(1)

    def last(self) -> DataFrame:
        return self._to(self.size)

    def absolute(self, n: int) -> DataFrame:
        return self._to(n if n >= 0 else self.size + 1 + n)

    def relative(self, n: int) -> DataFrame:
        return self._to(self.position + n)

    def forward(self, n: int | None = None) -> DataFrame:
        """The next n rows, or all that are left."""
        first = self.position + 1
        last = self.size if n is None else min(self.position + n, self.size)
        self.position = self.size + 1 if n is None or self.position + n > self.size else last
        return self._range(first, last)

    all = forward

    def backward(self, n: int | None = None) -> DataFrame:
        last = self.position - 1
        first = 1 if n is None else max(self.position - n, 1)
        self.position = 0 if n is None or self.position - n < 1 else first
        return self._range(first, last, down=True)

    def close(self) -> None:
        self.rows = self._empty = self.rows.limit(0)
        self.size = self.position = 0


class Cursors:
    """DECLARE, FETCH and CLOSE by name."""

    def __init__(self) -> None:
        self.open: dict[str, Cursor] = {}

    def declare(self, name: str, df: DataFrame, *order: Column | str) -> Cursor:
        if name in self.open:
            raise ValueError(f"cursor {name} is open")
        self.open[name] = Cursor(df, *order)
        return self.open[name]

    def fetch(self, name: str, how: str = "NEXT") -> DataFrame:
        """NEXT, PRIOR, FIRST, LAST, ABSOLUTE n, RELATIVE n, ALL, n, FORWARD [n|ALL], BACKWARD [n|ALL]."""
        cursor, words = self.open[name], how.upper().split()
        if words[0].lstrip("-").isdigit():
            n = int(words[0])
            return cursor.forward(n) if n >= 0 else cursor.backward(-n)
        if words[0] in ("ABSOLUTE", "RELATIVE"):
            return getattr(cursor, words[0].lower())(int(words[1]))
        if words[0] in ("FORWARD", "BACKWARD"):
            n = 1 if len(words) == 1 else None if words[1] == "ALL" else int(words[1])
            return getattr(cursor, words[0].lower())(n)
        return getattr(cursor, words[0].lower())()

    def close(self, name: str | None = None) -> None:
        for n in [name] if name else list(self.open):
            self.open.pop(n).close()
