"""Registration of queries, table reading, and SQL that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexarium.operators.store import Stored, build
from lexarium.sources import shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str], Stored] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> Stored:
    """The stored index of a folder's documents, built once in a session and read by all queries that rank."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = build(table(spark, sf_dir, "documents"), shared.folder(spark, "index"))
    return _STORED[key]


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOK = (
    "tok AS (SELECT doc_id, term, line * 4294967296 + n AS pos FROM (SELECT doc_id, line, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS n FROM "
    "(SELECT doc_id, line, regexp_extract_all(" + LOWER.format("part") + r", '[\p{L}\p{N}]+') AS w FROM "
    "(SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents))))"
)
LENGTHS = "lengths AS (SELECT doc_id, count(*) AS length FROM tok GROUP BY doc_id), stats AS (SELECT count(*) AS n, coalesce(avg(length), 0.0) AS avg_length FROM lengths)"
