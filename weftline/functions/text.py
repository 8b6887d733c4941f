"""Tokens of page texts, word validity, stop words and query terms, as JVM-side expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.stem import stem

#: White space, what tags and punctuation look like, and which words are indexed.
SPACE = r"[ \t\n\x0B\f\r]+"
TAG = r"<[^>]*>"
PUNCTUATION = r"""[.,:;!?'"()\-]"""
VALID = r"\A(?:[A-Za-z0-9]{1,50}|[\x21-\x7F])\z"
ALNUM = r"\A[A-Za-z0-9]+\z"

#: Words that a query of several words leaves out.
STOP_WORDS = frozenset(
    """a about actually almost also although always am an and any are as at be became become but by can could did do does
    each either else for from had has have hence how i if in is it its just may maybe me might mine must my neither nor not
    of oh ok when where whereas wherever whenever whether which while who whom whoever whose why will with within without
    would yes yet you your""".split()
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_tags(text: str | Column) -> Column:
    return F.regexp_replace(col(text), TAG, " ")


def strip_punctuation(text: str | Column) -> Column:
    return F.regexp_replace(col(text), PUNCTUATION, " ")


def tokens(text: str | Column) -> Column:
    """Lower-case tokens of a text without tags and punctuation.

    A leading blank gives an empty first token, which counts as a position;
    trailing ones are dropped.  Null stays null, an empty text has one empty token.
    """
    clean = F.lower(strip_punctuation(strip_tags(text)))
    return F.split(F.regexp_replace(clean, SPACE + r"\z", ""), SPACE)


def is_valid(word: str | Column) -> Column:
    """Whether a token is indexed: up to 50 ASCII letters and digits, or one visible ASCII character."""
    return col(word).rlike(VALID)


def title_words(title: str | Column) -> Column:
    """Number of parts of a title between single blanks: 1 for an empty title, trailing empty parts left out."""
    bare = F.regexp_replace(col(title), r" +\z", "")
    return F.when(col(title) == "", 1).when(bare == "", 0).otherwise(F.size(F.split(bare, " ")))


def stems(df: DataFrame, word: str, out: str = "stem") -> DataFrame:
    """(word, stem) of the distinct values of a column: each word of the vocabulary is stemmed once, in Arrow batches."""

    def run(batches):
        for batch in batches:
            words = batch.column(0)
            yield pa.record_batch([words, pa.array([None if w is None else stem(w) for w in words.to_pylist()], pa.string())], names=[word, out])

    return df.select(F.col(word).cast("string").alias(word)).distinct().mapInArrow(run, f"`{word}` string, `{out}` string")


def query_terms(query: str, stemmed: bool = True) -> list[str]:
    """Distinct terms of a keyword query in first-seen order.

    Stop words are left out, tested before stemming, but not if the query is one word.
    """
    words = query.strip().lower().split()
    if len(words) > 1:
        words = [w for w in words if w not in STOP_WORDS]
    return list(dict.fromkeys(stem(w) if stemmed else w for w in words))
