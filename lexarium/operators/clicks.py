"""Click statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def statistics(ranks: DataFrame) -> DataFrame:
    """Of ranks (q, rank): clicks, mean and median rank, and buckets of ranks.

    The median comes from counts by rank, so a frequent query's clicks never meet in one task.
    """
    counted = ranks.groupBy("q", "rank").agg(F.count("*").alias("n"))
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    r = F.col("rank")
    return counted.groupBy("q").agg(
        F.sum("n").alias("clicks"), F.round(F.sum(r * F.col("n")) / F.sum("n"), 6).alias("mean_rank"), F.percentile("rank", 0.5, F.col("n")).alias("median_rank"),
        of(r == 1).alias("first"), of(r.between(2, 3)).alias("upper"), of(r.between(4, 10)).alias("page"), of(r > 10).alias("later"),
    )
