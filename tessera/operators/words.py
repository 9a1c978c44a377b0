"""Word counts over lines of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx


def tokens(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row (word) a token: lines split at single blanks, in lower case.

    Empty tokens before and between words count as the word ""; those at a line's end don't.
    """
    return lines.where(F.col(value).isNotNull()).select(F.explode(tx.split_trailing(F.col(value), " ")).alias("word")).select(F.lower("word").alias("word"))


def word_count(lines: DataFrame, value: str = "value") -> DataFrame:
    """word and n, counted partially before the one shuffle."""
    return tokens(lines, value).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_totals(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row: distinct_words and tokens."""
    return word_count(lines, value).agg(F.count(F.lit(1)).alias("distinct_words"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("tokens"))
