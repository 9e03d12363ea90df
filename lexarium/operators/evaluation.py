"""Search and retrieval judged against labels, as plans over all labelled queries at once; and the checks around models."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexarium.functions.text import cosine
from lexarium.sources import shared


def search_quality(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """query, precision, p_at_10, recall, mrr, hit_10, hit_20 of ranked (query, doc_id, rank) against truth (query, doc_id).

    A query of the truth without results has zeros; results of queries without truth aren't judged."""
    queries = truth.groupBy("query").agg(F.countDistinct("doc_id").cast("double").alias("n_truth"))
    hits = ranked.join(truth.select("query", "doc_id").distinct().withColumn("hit", F.lit(1)), ["query", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    by = hits.groupBy("query").agg(
        F.count("*").alias("n"), F.sum("hit").alias("hits"), F.count_if((F.col("hit") == 1) & (F.col("rank") <= 10)).alias("in_10"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    within = lambda k: F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))
    return queries.join(by, "query", "left").select(
        "query", zero(F.col("hits") / F.col("n")).alias("precision"), zero(F.col("in_10") / 10.0).alias("p_at_10"), zero(F.col("hits") / F.col("n_truth")).alias("recall"), zero(1.0 / F.col("first")).alias("mrr"), within(10).alias("hit_10"), within(20).alias("hit_20")
    )


def retriever_recall(found: DataFrame, wanted: DataFrame, ks: list[int]) -> DataFrame:
    """k, recall (mean over queries of the share of wanted ids in the first k), results (mean number of them). found: query, id, rank; wanted: query, id."""
    want = wanted.select("query", "id").distinct()
    n = want.groupBy("query").agg(F.count("*").cast("double").alias("n"))
    at = found.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where(F.col("rank") <= F.col("k"))
    hits = at.join(want, ["query", "id"], "left_semi").groupBy("query", "k").agg(F.countDistinct("id").alias("hits"))
    sizes = at.groupBy("query", "k").agg(F.count("*").alias("size"))
    every = n.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    both = every.join(hits, ["query", "k"], "left").join(sizes, ["query", "k"], "left")
    return both.groupBy("k").agg(F.avg(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0))).alias("recall"), F.avg(F.coalesce("size", F.lit(0))).alias("results"))


def record_run(spark: SparkSession, root: str, run: dict) -> None:
    """Appends a run to a history: one small JSON file each, written under another name and renamed."""
    fs, path = shared.file_system(spark, root)
    hidden, final = f"{root}/_{uuid.uuid4().hex}", f"{root}/run-{uuid.uuid4().hex}.json"
    out = fs.create(path(hidden))
    try:
        out.write(bytearray(json.dumps(run, sort_keys=True).encode()))
    finally:
        out.close()
    if not fs.rename(path(hidden), path(final)):
        raise OSError(final)


def history(spark: SparkSession, root: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{root}/run-*.json")


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], tries: int = 3, batch: int = 64) -> DataFrame:
    """texts (text and more) with embedding, by a model that the caller gives; a batch that fails is tried again."""

    def run(column: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        for k in range(0, len(column), batch):
            part = [t or "" for t in column.iloc[k : k + batch]]
            for left in range(tries - 1, -1, -1):
                try:
                    out += embed(part)
                    break
                except Exception:
                    if not left:
                        raise
        return pd.Series(out)

    return texts.withColumn("embedding", F.pandas_udf(run, T.ArrayType(T.DoubleType()))("text"))


def reranked(results: DataFrame, score: Callable[[list[str]], list[float]], head: int = 10) -> DataFrame:
    """results (doc_id, score, text): the first `head` by 1 + the model's score of their text, the rest behind them as they were. doc_id, score, rank."""
    order = [F.col("score").desc(), F.col("doc_id")]
    first = results.orderBy(*order).limit(head)
    scored = first.withColumn("score", 1.0 + F.pandas_udf(lambda t: pd.Series(score([x or "" for x in t])), T.DoubleType())("text")).select("doc_id", "score", F.lit(0).alias("part"))
    rest = results.join(F.broadcast(first.select("doc_id")), "doc_id", "left_anti").select("doc_id", "score", F.lit(1).alias("part"))
    both = scored.unionByName(rest)  # a page's candidates: a few hundred rows
    return both.select("doc_id", "score", F.row_number().over(W.orderBy("part", F.col("score").desc(), "doc_id")).alias("rank"))


def same_model(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], sample: int = 5, seed: int = 1, least: float = 0.99) -> bool:
    """Whether the model gives a few chunks (chunk_id, text, embedding) the vectors that are stored, by cosine. The sample is drawn by hash, so it is the same each time."""
    drawn = chunks.orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(sample)
    again = embedded(drawn.withColumnRenamed("embedding", "stored"), embed)
    worst = again.agg(F.min(F.coalesce(cosine(F.col("embedding"), F.col("stored")), F.lit(-1.0))).alias("w")).first().w
    return worst is None or worst >= least
