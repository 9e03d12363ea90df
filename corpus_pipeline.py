"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import common, packing, pii, quality, simhash, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"), common.remainder("label_id", 3) == 1)

    def score(texts: list[str]) -> np.ndarray:
        own = toxicity.matcher(model.weights, model.edits)
        return model.score(np.array([own.features(t) for t in texts]).reshape(-1, 7))

    return common.with_result(docs, score, "score", "double", pa.float64()).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def quality_in(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay."""
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, common.table(spark, sf_dir, "labels"), common.remainder("label_id", 5) == 0)

    def score(texts: list[str]) -> np.ndarray:
        return model.score(np.array([quality.statistics(t) for t in texts]).reshape(-1, len(quality.FEATURES)))

    return common.with_result(docs, score, "score", "double", pa.float64()).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.8 or more over five-word shingles, the one of the smallest id stays.

    Rows are told apart by id and text: of unlike rows of one id each is judged by its own text. Rows that repeat the kept one
    count as one (the first by its other columns). Rows without an id stay.
    """
    docs = common.session(spark) and docs.select(*COLUMNS)
    found = common.staged(simhash.similar_documents(docs.where("doc_id IS NOT NULL")))
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("node") == F.col("kept_node"))
    kept = found.where(stays).groupBy("doc_id", "kept_node", "text_key").agg(F.count("*").alias("n")).groupBy("doc_id", "kept_node").agg(F.min(F.struct("text_key", "n")).alias("row")).select("doc_id", "row.*")
    goes = common.staged(found.select("doc_id", "text_key").distinct().join(kept, ["doc_id", "text_key"], "left_anti"))
    twice = common.staged(kept.where("n > 1").select("doc_id", "text_key"))
    judged = goes.select("doc_id").unionAll(twice.select("doc_id")).distinct()
    rows = common.flagged(docs.withColumn("text_key", simhash.text_key()), F.xxhash64("doc_id"), common.id_marks(judged.select(F.xxhash64("doc_id").alias("h"))), "perhaps")
    sure = rows.where("NOT perhaps").select(*COLUMNS)
    left = rows.where("perhaps").join(goes, ["doc_id", "text_key"], "left_anti")
    if twice.isEmpty():
        return sure.unionByName(left.select(*COLUMNS))
    once = left.join(twice, ["doc_id", "text_key"]).groupBy("doc_id", "text_key").agg(F.min(F.struct("text", "lang", "source", "n_chars")).alias("row")).select("doc_id", "row.*")
    return sure.unionByName(left.join(twice, ["doc_id", "text_key"], "left_anti").select(*COLUMNS)).unionByName(once.select(*COLUMNS))


def private_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind in brackets; n_chars is that of the new text. A null text stays null."""
    docs = common.session(spark) and docs.select(*COLUMNS)
    field = pii.train(docs)

    def clean(texts: list[str]) -> list[str]:
        return [pii.redacted(t, pii.all_spans(field, t)) for t in texts]

    found = common.with_result(docs, clean, "clean", "string", pa.string())
    text = F.when(F.col("text").isNotNull(), F.col("clean"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.length(text).cast("long"), F.col("n_chars")).alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    common.session(spark)
    return packing.packed(docs)


STAGES = [("toxicity", toxic_out), ("quality", quality_in), ("near_copies", near_copies_out), ("pii", private_out), ("packing", packed)]

#: SQL can't express these stages; tests/llm hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder before the next reads them."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.staged(docs)
    return docs
