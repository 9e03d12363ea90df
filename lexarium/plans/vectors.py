"""Vector queries over embeddings; the label plays the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions.text import norm
from lexarium.operators import ranking, vectors
from lexarium.plans.base import query, table

SIM = "sims AS (SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS sim FROM embeddings e, embeddings q WHERE q.vec_id = 0)"


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _e(spark, sf_dir)
    return vectors.similarities(e, vectors.vector_of(e, 0)).drop("embedding")


@query(f"WITH {SIM} SELECT vec_id, label, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM sims) WHERE rank <= 10 AND sim >= 0.1")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar, then a threshold."""
    e = _e(spark, sf_dir)
    return vectors.topk(e, vectors.vector_of(e, 0), 10, 0.1).select("vec_id", "label", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {SIM} SELECT vec_id, label, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM sims WHERE label IN (1, 3)) WHERE rank <= 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar of some documents."""
    e = _e(spark, sf_dir)
    return vectors.topk(e.where(F.col("label").isin(1, 3)), vectors.vector_of(e, 0), 10).select("vec_id", "label", F.round("sim", 6).alias("sim"), "rank")


BATCH = """SELECT query_id, vec_id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM
(SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS sim FROM embeddings e, embeddings q WHERE q.vec_id < 5)) WHERE rank <= 10"""


@query(BATCH)
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar to each vector of a request of five."""
    e = _e(spark, sf_dir)
    asked = e.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.batch_topk(e, asked, 10).select("query_id", "vec_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SIM}, best AS (SELECT label, max(sim) AS sim, arg_min(vec_id, (-sim, vec_id)) AS vec_id FROM (SELECT * FROM sims ORDER BY sim DESC, vec_id LIMIT 100) GROUP BY label) SELECT label, vec_id, round(sim, 6) AS sim FROM best WHERE sim >= (SELECT max(sim) FROM best) - 0.8 ORDER BY sim DESC, label LIMIT 30")
def semantic_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 100 most similar the best of each document, within a window of the best."""
    top = _sims(spark, sf_dir).orderBy(F.col("sim").desc(), "vec_id").limit(100)
    best = vectors.first_per_key(top, "label")
    high = best.agg(F.max("sim").alias("high"))
    return best.crossJoin(F.broadcast(high)).where(F.col("sim") >= F.col("high") - 0.8).orderBy(F.col("sim").desc(), "label").limit(30).select("label", "vec_id", F.round("sim", 6).alias("sim"))


TWO = "two AS (SELECT vec_id, q, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, vec_id) AS rank FROM (SELECT e.vec_id, q.vec_id AS q, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS sim FROM embeddings e, embeddings q WHERE q.vec_id IN (1, 2)))"


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _e(spark, sf_dir)
    return vectors.batch_topk(e, e.where("vec_id IN (1, 2)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10)


@query(f"WITH {TWO} SELECT vec_id AS id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM two WHERE rank <= 10 GROUP BY vec_id")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists fused by reciprocal ranks."""
    found = _two(spark, sf_dir).select(F.col("vec_id").alias("id"), "rank")
    return ranking.fused(found).select("id", F.round("score", 9).alias("score"))


@query(f"WITH {TWO} SELECT vec_id, round(max(sim), 6) AS sim FROM two WHERE rank <= 10 GROUP BY vec_id ORDER BY max(sim) DESC, vec_id LIMIT 15")
def chunk_multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of several queries merged: each chunk once, the 15 most similar."""
    return _two(spark, sf_dir).groupBy("vec_id").agg(F.max("sim").alias("sim")).orderBy(F.col("sim").desc(), "vec_id").limit(15).select("vec_id", F.round("sim", 6).alias("sim"))


@query("SELECT label, d::INT AS d, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) GROUP BY ALL")
def split_embedding_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a text's pieces averaged by component."""
    return _e(spark, sf_dir).select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_dim, count(*) FILTER (WHERE list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) = 0) AS zero FROM embeddings")
def vector_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a wrong dimension or without length."""
    return _e(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != 64).alias("wrong_dim"), F.count_if(norm(F.col("embedding")) == 0).alias("zero"))


REUSE = """WITH old AS (SELECT sha256(text) AS h, min(doc_id) AS reuse_from FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
SELECT doc_id, coalesce(reuse_from, -1) AS reuse_from FROM (SELECT doc_id, sha256(text) AS h FROM documents) d LEFT JOIN old USING (h)"""


@query(REUSE)
def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which text's vector each text can take over from an older snapshot (here: rows of other ids), by content hash; -1: to embed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    old = d.where("doc_id % 3 <> 0").groupBy("h").agg(F.min("doc_id").alias("reuse_from"))
    return d.join(old, "h", "left").select("doc_id", F.coalesce("reuse_from", F.lit(-1)).alias("reuse_from"))
