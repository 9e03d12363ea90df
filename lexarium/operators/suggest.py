"""Spelling suggestions from the lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(lexicon: DataFrame, word: str, spread: int = 1, least_df: int = 2) -> DataFrame:
    """Terms of the word's length give or take spread, in least_df documents or more, that share its first or last letter."""
    near = F.length("term").between(len(word) - spread, len(word) + spread)
    return lexicon.where(near & (F.col("df") >= least_df) & (F.left("term", F.lit(1)).eqNullSafe(word[:1]) | F.right("term", F.lit(1)).eqNullSafe(word[-1:])))


def suggestions(lexicon: DataFrame, words: list[str]) -> DataFrame:
    """word, term, distance, df: for each word its nearest term of ASCII letters and digits, by distance, length, frequency and spelling.

    One edit is allowed for words of up to four letters, two for longer ones.
    """
    plain = lexicon.where(F.col("term").rlike("^[a-z0-9]+$") & (F.col("df") >= 2) & F.length("term").between(min(map(len, words)) - 1, max(map(len, words)) + 1))
    asked = F.broadcast(lexicon.sparkSession.createDataFrame([(w,) for w in words], "word string"))  # of a query: 64 at most
    size = F.length("word")
    ends = (F.left("term", F.lit(1)) == F.left("word", F.lit(1))) | (F.right("term", F.lit(1)) == F.right("word", F.lit(1)))
    near = plain.join(asked, (F.abs(F.length("term") - size) <= 1) & ends).withColumn("distance", F.levenshtein("term", "word"))
    out = near.where(F.col("distance") <= F.when(size <= 4, 1).otherwise(2))
    order = F.struct("distance", F.abs(F.length("term") - size), -F.col("df"), "term")
    return out.groupBy("word").agg(F.min_by(F.struct("term", "distance", "df"), order).alias("x")).select("word", "x.*")
