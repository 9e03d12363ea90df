"""Lookups and lists of a snapshot: documents by key, chunks by id with their documents, headings, the newest, the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.functions.text import valid_date


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of one key: an equality that reaches the scan. None is looked for as null."""
    return rows.where(F.col(key).isNull() if value is None else F.col(key) == F.lit(value))


def texts_of(chunks: DataFrame, ids: list[str], most: int = 1000) -> DataFrame:
    """chunk_id, text of a request's ids, those that there are."""
    if len(ids) > most:
        raise ValueError(f"at most {most} ids in one request")
    return chunks.where(F.col("chunk_id").isin(ids)).select("chunk_id", "text")


def with_documents(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their documents' title; one without a document stays, its title null."""
    return chunks.join(documents.select("doc_id", "title"), "doc_id", "left")


def headings(chunks: DataFrame) -> DataFrame:
    """doc_id, heading, heading_anchor, first: each heading's least chunk number."""
    return chunks.where("heading IS NOT NULL").groupBy("doc_id", "heading", "heading_anchor").agg(F.min("chunk_index").alias("first"))


def newest(documents: DataFrame, chunks: DataFrame, k: int = 50) -> DataFrame:
    """doc_id, title, published, headings (in order) of the k newest documents, undated ones last."""
    top = documents.orderBy(F.col("published").desc_nulls_last(), F.col("doc_id").desc()).limit(k).select("doc_id", "title", "published")
    own = headings(chunks.join(F.broadcast(top.select("doc_id")), "doc_id", "left_semi")).groupBy("doc_id")
    lists = own.agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "heading"))), lambda x: x["heading"]).alias("headings"))  # of k documents
    return top.join(lists, "doc_id", "left").select("doc_id", "title", "published", F.coalesce("headings", F.array().cast("array<string>")).alias("headings"))


def archive(documents: DataFrame) -> DataFrame:
    """Documents with a valid date first, the newest first, then by id downwards."""
    day = valid_date("published")
    return documents.orderBy(day.isNotNull().desc(), day.desc_nulls_last(), F.col("doc_id").desc())


def sample(rows: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """n rows drawn by a hash of their key: the same ones each time."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def by_year(results: DataFrame) -> DataFrame:
    """year, n of results (published), the last year first; only dates that begin with four digits."""
    year = F.regexp_extract("published", r"^(\d{4})", 1)
    return results.where(year != "").groupBy(year.alias("year")).agg(F.count("*").alias("n")).orderBy(F.col("year").desc())
