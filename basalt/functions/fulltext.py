"""Full-text predicates and an inverted index, as expressions and one aggregation."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .strings import _col

#: Particles that are not words of their own.
STOP_WORDS = ("の", "に", "は", "を", "た", "が", "で", "て", "と", "し", "れ", "さ", "ある", "いる", "も", "です")

_SCRIPTS = r"[一-鿿㐀-䶿]+|[぀-ゟ]+|[゠-ヿ]+|[\p{L}\p{N}&&[^一-鿿㐀-䶿぀-ヿ]]+"


#: What is no part of a token: white space and ASCII punctuation.
DROPPED = " \t\n\x0b\f\r" + string.punctuation


def _plain(text) -> Column:
    return F.translate(F.lower(_col(text)), DROPPED, "")


def bigrams(text) -> Column:
    """Overlapping pairs of the lower-cased characters without white space and ASCII punctuation; a short text is one token."""
    plain = _plain(text)
    n = F.char_length(plain)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(plain, i, F.lit(2)))
    return F.when(n > 0, F.array_distinct(pairs)).when(n == 0, F.array().cast("array<string>"))


def ft_search(text, query) -> Column:
    """True if the query has tokens and the text has them all."""
    q = bigrams(query if isinstance(query, Column) else F.lit(query))
    # a text has a pair of characters as a token if it contains it: no list of its tokens is built; what stands together
    # in the text does so without what is dropped, too, so most texts are never rewritten
    held = lambda low: F.forall(
        q, lambda t: F.when(F.char_length(t) == 1, F.translate(low, DROPPED, "") == t).otherwise(F.contains(low, t) | F.contains(F.translate(low, DROPPED, ""), t))
    )
    return (F.size(q) > 0) & F.transform(F.array(F.lower(_col(text))), held)[0]


def script_words(text) -> Column:
    """Runs of one script, lower-cased, without particles."""
    found = F.regexp_extract_all(F.lower(_col(text)), F.lit(_SCRIPTS), F.lit(0))
    return F.array_except(found, F.array(*map(F.lit, STOP_WORDS)))


def ft_search_words(text, query) -> Column:
    q = script_words(query if isinstance(query, Column) else F.lit(query))
    return (F.size(q) > 0) & (F.size(F.array_except(q, script_words(text))) == 0)


def inverted_index(df: DataFrame, key: str, text: str, tokens=script_words) -> DataFrame:
    """token, key: one posting a row, so no posting list outgrows a task."""
    return df.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"), F.col(key))


def search_index(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    """Keys whose texts hold all words: postings are counted, lists never built."""
    hits = index.filter(F.col("token").isin([w.lower() for w in words]))
    return hits.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(set(words))).select(key)
