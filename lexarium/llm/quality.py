"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are made on the executors. The model is fitted on at most `sample` labelled rows, the rows with
the least hash of their id among those allowed (a documented bound; every row is scored). Trees are complete, so a model
is three flat arrays, and numpy walks all rows of a batch through a tree level by level.

Defined cases: a null or empty text has statistics of zeros and is scored like any other; null labels or ids don't
train; without labels of both kinds the score is the known share of label 1 (0.5 if none is known); repeated rows are
scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import common

FEATURES = (
    "log_chars log_words word_length word_length_sd distinct_share top_word_share repeat_share short_share long_share upper_share lower_share digit_share "
    "space_share symbol_share bar_share punctuation_share high_share log_lines line_words distinct_line_share capital_share stop_share entropy compressed "
    "symbol_word_share upper_word_share"
).split()
SAMPLE = 20_000
THRESHOLD = 0.3

_CLASSES = np.zeros((256, 8))
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b"#$%&*<>=@\\^_{}~+", b"|", b".,;:!?'\"()-", bytes(range(128, 256)))):
    _CLASSES[list(_bytes), _k] = 1


def statistics(text: str) -> list[float]:
    """FEATURES of a whole text."""
    raw = text.encode()
    words = text.split()
    if not words:
        return [float(np.log1p(len(text)))] + [0.0] * (len(FEATURES) - 1)
    n, nw = len(raw), len(words)
    seen = Counter(words)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = counts @ _CLASSES / n
    p = counts[counts > 0] / n
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=nw)
    lines = text.split("\n")
    ends = Counter(w[-1] for w in words)
    return [
        float(np.log1p(len(text))), float(np.log1p(nw)), float(lengths.mean()), float(lengths.std()), len(seen) / nw, max(seen.values()) / nw,
        sum(map(str.__eq__, words, words[1:])) / nw, float((lengths <= 2).mean()), float((lengths >= 14).mean()), *share.tolist(),
        float(np.log1p(len(lines))), nw / len(lines), len(set(lines)) / len(lines), sum(w[0].isupper() for w in words) / nw, (ends["."] + ends["!"] + ends["?"]) / nw,
        float(-(p * np.log2(p)).sum()), len(zlib.compress(raw, 1)) / n, sum(v for k, v in ends.items() if not k.isalnum() and k not in ".,;:") / nw, sum(map(str.isupper, words)) / nw,
    ]


@dataclass
class Trees:
    """feature, cut: a row for each tree, a column for each inner node of a complete tree; leaf: its leaves."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of the rows of x."""
        total = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            while inner and at.size and at[0] < inner:  # all rows are on one level
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Boosting on the logistic loss; splits are sought on histograms of quantile bins."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base, inner = float(np.log(share / (1 - share))), 2**depth - 1
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    n_features, width = x.shape[1], bins + 1
    flat = binned + np.arange(n_features) * width
    raw, out = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.nonzero(at == node)[0]
                if len(rows) > 1:
                    keys = flat[rows].ravel()
                    left_g, left_h = (np.bincount(keys, np.repeat(v[rows], n_features), n_features * width).reshape(n_features, width).cumsum(1) for v in (g, h))
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    right_g, right_h = all_g - left_g, all_h - left_h
                    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
                    gain[(left_h < least) | (right_h < least)] = 0
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(cuts[j]):
                        feature[node], cut[node] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        at -= inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        raw = raw + leaf[at]
        for to, v in zip(out, (feature, cut, leaf), strict=True):
            to.append(v)
    return Trees(base, *(np.array(v) for v in out))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, rows: int) -> DataFrame:
    """text, y of at most `rows` labelled rows that aren't held out: those whose id has the least hash."""
    drawn = (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label).cast("double").alias("y"))
        .where(F.col("y").isin(0.0, 1.0) & F.col("label_id").isNotNull() & ~held_out)
        .orderBy(F.xxhash64("label_id"), "label_id", "y")
        .limit(rows)
    )
    return common.documents(docs).join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y")


def features(texts: DataFrame) -> DataFrame:
    """doc_id, y, x (array of FEATURES) of labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    return texts.mapInArrow(run, "doc_id long, y double, x array<double>")


def train(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> Trees:
    """held_out is of label_id."""
    rows = features(labelled_sample(docs, labels, "quality", held_out, sample)).toPandas().sort_values(["doc_id", "y"], kind="stable")
    x = np.array(rows.x.tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, rows.y.to_numpy(dtype=float))


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return common.documents(docs).mapInArrow(run, "doc_id long, score double")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; rows whose crc32(doc_id) mod 5 is 0 don't train."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels, common.remainder("label_id", 5) == 0)
    return scored(docs, model).select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
