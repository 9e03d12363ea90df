"""The inverted index as DataFrames: tokens, postings, lexicon, collection statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.functions import text
from lexarium.sources import shared

#: A token's place is its line times LINE plus its number in the line, so neighbours never reach across lines.
LINE = 1 << 32


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, term, pos for each token of docs (doc_id, text). A null text has none."""
    lines = shared.spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "part"))
    return lines.select("doc_id", "line", F.posexplode(text.tokens("part")).alias("n", "term")).select("doc_id", "term", (F.col("line").cast("long") * LINE + F.col("n")).alias("pos"))


def postings(tok: DataFrame) -> DataFrame:
    """term, doc_id, tf, positions (sorted)."""
    return tok.groupBy("term", "doc_id").agg(F.sort_array(F.collect_set("pos")).alias("positions")).withColumn("tf", F.size("positions").cast("long"))


def lexicon(tok: DataFrame) -> DataFrame:
    """term, df, cf; counted twice by (term, doc) so that each shuffle gets partial sums only."""
    return tok.groupBy("term", "doc_id").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def lengths(tok: DataFrame) -> DataFrame:
    """doc_id, length of the documents that have tokens."""
    return tok.groupBy("doc_id").agg(F.count("*").alias("length"))


def text_lengths(docs: DataFrame) -> DataFrame:
    """lengths() of the documents' tokens, counted in place: only a number a row is shuffled."""
    counted = shared.spread(docs.select("doc_id", "text")).select("doc_id", F.regexp_count("text", F.lit(text.TOKEN)).cast("long").alias("length")).where("length > 0")
    return counted.groupBy("doc_id").agg(F.sum("length").alias("length"))


def statistics(of: DataFrame) -> DataFrame:
    """One row: n documents with tokens, avg_length (0 without any)."""
    return of.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avg_length"))
