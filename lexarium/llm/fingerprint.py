"""Document fingerprints: sketches of a fixed share of all shingle hashes.

A shingle is a run of SHINGLE code points. Its hash is kept if it is below SHARE of the hash space, whatever the text's
length, so a sketch grows with its text, sketches merge by union (`merged`), and the share of one sketch that another
holds estimates containment even where one text is far longer than the other (`containment`). Likeness is the Jaccard
estimate of two sketches.

A text that has no hash below the threshold keeps its least hash, whole, in place of them; merging drops it beside kept
hashes, so that a merged sketch is always that of all shingles together. It is written apart from kept ones. A text
shorter than a shingle is one shingle; an empty text has the empty sketch, which is like itself (1) and like nothing
else (0).

Defined cases: a null text is an empty one; null ids sort last; repeated rows and ids are neighbours in text order; the
only row of a table is its own neighbour; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import common

SHINGLE = 12
#: One hash in 16 is kept.
SHARE_BITS = 4
#: Code points hashed at a time; chunks overlap by a shingle less one, so none is lost.
CHUNK = 1 << 20
#: Code points of a range of rows, and ranges at most.
RANGE_CHARS, QUANTILES = 32_000_000, 20_000
#: A kept hash is known by the 32 bits after those that the threshold fixes.
KEPT_BITS = np.uint64((1 << 64) - (1 << (32 - SHARE_BITS)))
_FACTOR = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _kept(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all shingles of these code points: the hashes under the threshold, and the least hash."""
    k = min(SHINGLE, len(points))
    n = len(points) - k + 1
    points = _mixed(points.astype(np.uint64) + np.uint64(1))
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(_FACTOR) + points[i : n + i]
    h = _mixed(h)
    return h[h >> np.uint64(64 - SHARE_BITS) == 0], h.min(keepdims=True)


def sketch(text: str) -> np.ndarray:
    """The kept hashes of the whole text, distinct and sorted; of 64 bits, of which the last 28 are cleared. Without any, the least hash as it is."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    if not len(points):
        return np.zeros(0, dtype=np.uint64)
    parts = [_kept(points[k : k + CHUNK + SHINGLE - 1]) for k in range(0, max(1, len(points) - SHINGLE + 1), CHUNK)]
    kept = np.concatenate([p[0] for p in parts])
    return np.unique(kept & KEPT_BITS) if len(kept) else np.min([p[1] for p in parts], axis=0)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate of two sketches; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of a's shingles that b has; 1 for an empty a."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    both = np.union1d(a, b)
    kept = both[both >> np.uint64(64 - SHARE_BITS) == 0]
    return kept if len(kept) else both[:1]


def written(s: np.ndarray) -> str:
    """Lowercase hex, 8 digits a kept hash, in order; a least hash that isn't kept has 16 after a hyphen."""
    if len(s) == 1 and s[0] >> np.uint64(64 - SHARE_BITS):
        return f"-{int(s[0]):016x}"
    return (s >> np.uint64(32 - SHARE_BITS)).astype(">u4").tobytes().hex()


def read(s: str) -> np.ndarray:
    if s.startswith("-"):
        return np.array([int(s[1:], 16)], dtype=np.uint64)
    return np.frombuffer(bytes.fromhex(s), dtype=">u4").astype(np.uint64) << np.uint64(32 - SHARE_BITS)


def _sorted_ranges(docs: DataFrame) -> DataFrame:
    """part, last, doc_id, text in order within each part; a row with last = 1 ends a part and is the next part's first.

    Ranges of doc_id are cut at approximate quantiles, of which there are as many as shuffle partitions, and more where ranges
    would hold over RANGE_CHARS. A range's first row is found by id, so that only those few texts are read for it, and is
    joined to the range before. Rows of one id stay in one range.
    """
    rows = common.documents(docs)
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = min(QUANTILES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS)))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10 * QUANTILES).alias("at")).first().at or []
    cuts = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))])
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("doc_id"))))
    rows = rows.select(part.alias("part"), "doc_id", "text")
    tops = rows.groupBy("part").agg(F.max("doc_id").alias("top")).collect()  # an id for each range
    tops.sort(key=lambda r: -r.part)
    to = F.create_map(*[F.lit(x) for a, b in zip(tops, tops[1:] + tops[:1], strict=True) for x in (b.part, a.part)]) if tops else F.lit(None).cast("map<int,int>")
    ids = [r.top for r in tops if r.top is not None]
    first = rows.where(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()).groupBy("part").agg(F.max("text").alias("text"))
    ends = first.select(to[F.col("part")].alias("part"), F.lit(1).alias("last"), F.lit(None).cast("long").alias("doc_id"), "text")
    both = rows.select("part", F.lit(0).alias("last"), "doc_id", "text").unionAll(ends)
    return both.repartitionByRange(n, "part").sortWithinPartitions("part", "last", F.col("doc_id").desc(), F.col("text").desc())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: see op2_fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, own = None, None
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(c).to_pylist() for c in ("part", "last", "doc_id", "text")), strict=True):
                s = sketch(row[3])
                if before is not None and before[0] == row[0]:
                    text = before[3]
                    third = len(text) // 3
                    edited = text[: len(text) - third] + row[3][:third]
                    e = sketch(edited)
                    out.append((before[2], len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(e), likeness(own, e), likeness(own, s)))
                before, own = row, s
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _sorted_ranges(docs).mapInArrow(run, schema)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every whole text and of its edited text, which ends in the next document's start."""
    return fingerprints(common.table(spark, sf_dir, "documents"))
