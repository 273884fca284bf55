"""Rows that every operator must stand: nulls, empty and long texts, ties, repeated rows, other columns."""

import random

import pytest

LONG = "word " * 60_000 + "x" * 1_200_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    rng = random.Random(3)
    letters = "the of and in an on er re".split()
    text = lambda n: " ".join(rng.choice(letters) + rng.choice("abcdefg") for _ in range(n))
    base = text(120)
    words = base.split()
    near = " ".join([*words[:100], "changed", *words[101:]])
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t ", "en", "s", 4), (4, base, "en", "s", len(base)), (5, base, "en", "s", len(base)),
        (6, near, "en", "s", len(near)), (7, LONG, "en", "hot", len(LONG)), (8, "one two", "en", "hot", 7), (9, "ONE  two", "en", "hot", 8),
        (10, "Ünï · 数据 ☃", "xx", None, 9), (11, text(300), "en", "hot", 9), (11, text(5), "en", "hot", 9), (None, "no id here", "en", "hot", 9),
        (12, base + " " + text(200), "en", "hot", 9),
    ]
    rows += [(4, base, "en", "s", len(base))]  # a repeated row
    out = [(*r, "clash", 1, 2) for r in rows]
    return spark.createDataFrame(out, "doc_id long, text string, lang string, source string, n_chars long, length string, key int, _n int").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
