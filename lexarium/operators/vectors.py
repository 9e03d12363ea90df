"""Exact vector search with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarium.functions.text import cosine


#: Query vectors of one batch at most.
BATCH = 10_000


def vector_of(vectors: DataFrame, vec_id: int) -> DataFrame:
    """query: the vector of one id (the first, if it recurs)."""
    return vectors.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("query")).limit(1)


def similarities(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """vectors with sim, to 9 places; query is one row."""
    return vectors.crossJoin(F.broadcast(query)).withColumn("sim", F.round(cosine(F.col("embedding"), F.col("query")), 9)).drop("query")


def numbered(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows by order, with rank from 1: a top-k of each partition, then k rows in one."""
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("long"))


def topk(vectors: DataFrame, query: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """The k most similar with sim and rank; the threshold is applied after the limit."""
    found = numbered(similarities(vectors, query).drop("embedding"), [F.col("sim").desc(), F.col("vec_id")], k)
    return found if threshold is None else found.where(F.col("sim") >= threshold)


def batch_topk(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, sim, rank of each of a batch of query vectors (query_id, query), a request's few rows.

    Ranks above k are dropped in each partition before the shuffle (a group limit of the window). A batch of more than
    BATCH queries is refused: it would be sent to every task.
    """
    if queries.limit(BATCH + 1).count() > BATCH:
        raise ValueError(f"a batch has at most {BATCH} queries")
    both = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(queries)).select("query_id", "vec_id", F.round(cosine(F.col("embedding"), F.col("query")), 9).alias("sim"))
    w = W.partitionBy("query_id").orderBy(F.col("sim").desc(), "vec_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def first_per_key(found: DataFrame, key: str) -> DataFrame:
    """Of ranked rows the best of each key."""
    return found.groupBy(key).agg(F.max_by(F.struct("vec_id", "sim"), F.struct("sim", -F.col("vec_id"))).alias("x")).select(key, "x.*")
