"""Edges of the function library on literals."""

import datetime

import pytest
from pyspark.sql import functions as F

from basalt.functions import conditional as C
from basalt.functions import dates as T
from basalt.functions import fulltext as FT
from basalt.functions import numbers as M
from basalt.functions import strings as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: S.concat(F.lit("a"), F.lit(None), F.lit("b")), "ab"),
        (lambda: S.concat_ws(F.lit(None).cast("string"), F.lit("a")), None),
        (lambda: S.substr(F.lit("hello"), F.lit(-2), F.lit(3)), "hel"),
        (lambda: S.substr(F.lit("hello"), 9), ""),
        (lambda: S.initcap(F.lit("foo-bar bAZ_q1x")), "Foo-Bar Baz_Q1x"),
        (lambda: S.split_part(F.lit("a,b"), ",", 0), ""),
        (lambda: S.split_part(F.lit("a,b"), ",", 5), ""),
        (lambda: S.repeat(F.lit("a"), -3), ""),
        (lambda: S.chr_(F.lit(0x1F600)), "\U0001f600"),
        (lambda: S.regexp_replace(F.lit("xaab a1"), "a+", "<$0>"), "x<aa>b a1"),
        (lambda: S.regexp_replace(F.lit("none"), "z", "y"), "none"),
        (lambda: S.to_char(F.lit(datetime.datetime(2024, 2, 29, 13, 5, 9)), "DD/MM/YYYY at HH24:MI"), "29/02/2024 at 13:05"),
        (lambda: T.extract("DOW", F.lit("2024-03-03")), 0),
        (lambda: T.date_add(F.lit(datetime.date(2024, 1, 31)), months=1), datetime.date(2024, 2, 29)),
        (lambda: T.datediff("DAY", F.lit(datetime.date(2024, 3, 1)), F.lit(datetime.date(2024, 2, 1))), 29),
        (lambda: M.round_(F.lit("2.345"), 2), 2.34),
        (lambda: M.trunc(F.lit(-2.567), 2), -2.56),
        (lambda: M.mod(F.lit(-7), 3), -1),
        (lambda: M.divide(F.lit(7), F.lit(2), True), 3),
        (lambda: C.decode(F.lit(None).cast("string"), "a", 1, None, 2, 3), 2),
        (lambda: C.json_value(F.lit('{"a": [1, {"b": "x"}]}'), "$.a[1].b"), "x"),
        (lambda: C.json_value(F.lit("{broken"), "$.a"), None),
        (lambda: FT.ft_search(F.lit("分散データベースの設計"), "データベース"), True),
        (lambda: FT.ft_search(F.lit("anything"), ""), False),
        (lambda: FT.script_words(F.lit("Rust言語のデータベースです")), ["rust", "言語", "データベース"]),
    ],
)
def test_value(spark, make, want):
    assert value(spark, make()) == want
