"""Shingle sets of texts as sorted 64-bit hashes, and texts read again by the ids of their documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.llm import common

SEED = 42


def shingle_hashes(w: list[bytes], words: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of that many words, space-joined (of all words, if they are fewer), a part of the text at a time."""
    n = max(1, len(w) - words + 1) if w else 0
    whole = b" ".join(w)
    sizes = np.array([len(x) for x in w], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts, last = ends - sizes, ends[min(words, len(w)) - 1 :] if n else ends
    hashed = xxhash.xxh64_intdigest
    for k in range(0, n, 65536):
        yield np.array([hashed(whole[a:b], SEED) for a, b in zip(starts[k : min(n, k + 65536)].tolist(), last[k : k + 65536].tolist(), strict=False)], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # of bytes: A-Z only, and space and \t-\r only


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles' hashes, in order."""
    return np.unique(np.concatenate([*shingle_hashes(words_of(text), words), np.zeros(0, np.uint64)]))


def node_of(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets in order. Empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def texts_of(docs: DataFrame, first_ids: DataFrame) -> DataFrame:
    """id, text of the documents with first_ids (first_id), and of a few more by accident, read again where they lie."""
    marks = common.id_marks(first_ids.select(F.xxhash64("first_id").alias("h")))
    has = common.mark_test(docs.sparkSession, marks)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["id", "text"]).filter(pa.array(has(b.column("h").to_numpy()), pa.bool_()))

    return common.documents(docs).select(F.col("doc_id").alias("id"), "text", F.xxhash64("doc_id").alias("h")).mapInArrow(read, "id long, text string")
