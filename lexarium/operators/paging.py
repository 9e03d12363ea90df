"""Stable pages of a ranked result, and the cursor that binds the next page to the same snapshot and query."""

from __future__ import annotations

import base64
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VERSION = 5


@dataclass(frozen=True)
class Cursor:
    snapshot: str
    terms: tuple[str, ...]
    sort: str = "relevance"
    channel: str | None = None
    year: int | None = None
    offset: int = 0
    limit: int = 20

    def written(self) -> str:
        return base64.urlsafe_b64encode(json.dumps({"v": VERSION, **asdict(self)}, separators=(",", ":")).encode()).decode().rstrip("=")

    @staticmethod
    def read(text: str) -> Cursor:
        """ValueError if it isn't a cursor of this version."""
        try:
            got = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
            if got.pop("v") != VERSION:
                raise ValueError("another version")
            cursor = Cursor(**(got | {"terms": tuple(got["terms"])}))
        except (KeyError, TypeError, AttributeError, UnicodeDecodeError, ValueError) as e:
            raise ValueError("not a cursor") from e
        if cursor.offset < 0 or not 1 <= cursor.limit <= 50:
            raise ValueError("not a cursor")
        return cursor

    def bound_to(self, other: Cursor) -> bool:
        """Whether both are pages of one search."""
        return (self.snapshot, self.terms, self.sort, self.channel, self.year, self.limit) == (other.snapshot, other.terms, other.sort, other.channel, other.year, other.limit)


def page(results: DataFrame, cursor: Cursor) -> tuple[DataFrame, int, Cursor | None]:
    """The page's rows (of doc_id, score, channel, publication_date), the exact total, and the next cursor if there is more."""
    kept = results
    if cursor.channel is not None:
        kept = kept.where(F.col("channel") == cursor.channel)
    if cursor.year is not None:
        kept = kept.where(F.col("publication_date").startswith(str(cursor.year)))
    relevance = [F.col("score").desc(), F.col("doc_id")]
    order = [F.col("publication_date").desc_nulls_last(), *relevance] if cursor.sort == "date" else relevance
    total = kept.count()
    after = cursor.offset + cursor.limit
    more = Cursor(**(asdict(cursor) | {"offset": after})) if after < total else None
    return kept.orderBy(*order).offset(cursor.offset).limit(cursor.limit), total, more


def numbered_within(rows: DataFrame, key: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """rows with their number (from 1) within the key. bucket must fall along the order, the greatest first: rows are numbered
    inside a bucket, and the rows of greater buckets are added from a table with a row for each bucket."""
    w = W.partitionBy(*key).orderBy(F.col(bucket).desc()).rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(*key, bucket).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy(*key, bucket).orderBy(*order)).cast("long")
    return rows.withColumn("_in", place).join(before, [*key, bucket]).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before")
