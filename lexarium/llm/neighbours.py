"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are normalised, the mean direction is subtracted, and the rest is turned by a random rotation (of a fixed seed)
into BITS dimensions or more. A code keeps each coordinate's sign in a bit, 64 to a machine word, with three scalars:
the rest's length, its inner product with the mean, and how well the code fits. A query's turned rest is rounded to
PLANES bits a coordinate, and kept as that many bit planes. Inner products are estimated by counting the ones of codes
and planes together; the fit and what rounding left bound the estimate's error. In each block of rows those vectors are
reranked exactly, by their own components, whose upper bound reaches the k-th best lower bound.

Codes and planes are made once, before rows are dealt. The query set meets all rows in blocks of bounded size (`ROWS` by
`QUERIES`); a block returns k rows a query at most. Equal vectors of a block are compared once. Work is the number of
queries times the number of rows; nothing is dropped, so recall is that of the error bounds (EPSILON).

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no part;
vectors of another length than a query's have no cosine with it and are no candidates; rows that repeat an id are rows of
their own, each a candidate of the others; ties go to the smaller id; fewer candidates than k give fewer rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexarium.llm import common

ROWS, QUERIES = 16384, 2048
#: Bits of a code at least, and bits of a coordinate of a query.
BITS, PLANES = 512, 4
#: Standard deviations of the estimate's error that the bounds allow for.
EPSILON = 3.0
SEED = 5


def code_bits(dim: int) -> int:
    return max(BITS, -(-dim // 64) * 64)


@lru_cache(maxsize=2)
def rotation(dim: int) -> np.ndarray:
    """dim orthonormal rows of as many components as a code has bits."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((code_bits(dim), dim)))
    return (q * np.sign(np.diag(r))).T.copy()


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    return np.packbits(bits, axis=1).view(np.uint64)


def turned(unit: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rests' directions after the rotation, and the rests' lengths."""
    rest = unit - mean
    length = np.linalg.norm(rest, axis=1)
    return (rest @ rotation(unit.shape[1])) / np.maximum(length, 1e-30)[:, None], length


class Codes:
    """words (packed signs) and length, with_mean, fit of vectors."""

    def __init__(self, words: np.ndarray, length: np.ndarray, with_mean: np.ndarray, fit: np.ndarray) -> None:
        self.words, self.length, self.with_mean, self.fit = words, length, with_mean, fit

    @staticmethod
    def of(unit: np.ndarray, mean: np.ndarray) -> Codes:
        x, length = turned(unit, mean)
        return Codes(packed(x > 0), length, unit @ mean, np.maximum(np.abs(x).sum(1) / np.sqrt(x.shape[1]), 1e-9))

    def take(self, rows: np.ndarray) -> Codes:
        return Codes(self.words[rows], self.length[rows], self.with_mean[rows], self.fit[rows])


class Asked:
    """planes (by plane, packed) and the scalars that estimates need, of queries."""

    def __init__(self, planes: np.ndarray, scalars: np.ndarray) -> None:
        self.planes, self.scalars = planes, scalars

    @staticmethod
    def of(unit: np.ndarray, mean: np.ndarray) -> Asked:
        x, length = turned(unit, mean)
        low = x.min(1)
        step = np.maximum((x.max(1) - low) / (2**PLANES - 1), 1e-30)
        whole = np.clip(np.rint((x - low[:, None]) / step[:, None]), 0, 2**PLANES - 1).astype(np.uint8)
        rounded = low[:, None] + step[:, None] * whole
        planes = np.stack([packed(whole >> j & 1 == 1) for j in range(PLANES)], axis=1)
        left = np.linalg.norm(x - rounded, axis=1)
        return Asked(planes, np.column_stack([length, low, step, rounded.sum(1), left, unit @ mean - mean @ mean]))


def bounds(codes: Codes, asked: Asked) -> tuple[np.ndarray, np.ndarray]:
    """Estimates of the inner products of queries and rows, by counts of ones, and their errors; a row for each query."""
    words = codes.words.shape[1]
    bits = words * 64
    ones = np.bitwise_count(codes.words).sum(1, dtype=np.int64)
    counts = np.zeros((len(asked.planes), len(codes.words)), dtype=np.int32)
    for w in range(words):
        column = np.ascontiguousarray(codes.words[:, w])[None, :]
        for j in range(PLANES):
            counts += np.bitwise_count(column & asked.planes[:, j, w, None]).astype(np.int32) << j
    length, low, step, total, left, shift = (asked.scalars[:, k, None] for k in range(6))
    with_code = (2 * (low * ones[None, :] + step * counts) - total) / np.sqrt(bits)
    error = (np.sqrt(np.maximum(0, 1 - codes.fit**2))[None, :] / np.sqrt(max(1, bits - 1)) + left / np.sqrt(bits)) * EPSILON / codes.fit[None, :]
    both = length * codes.length[None, :]
    return both * with_code / codes.fit[None, :] + codes.with_mean[None, :] + shift, both * error + 1e-6


Found = tuple[int, int, int, float]


def search(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, codes: Codes, query_rows: np.ndarray, queries: np.ndarray, asked: Asked, k: int) -> tuple[list[Found], float]:
    """(query row, row, id, cosine) of the k nearest of this block for each query, and the share of pairs that were reranked."""
    order = np.lexsort((rows, ids))
    ids, rows, vectors = ids[order], rows[order], np.ascontiguousarray(vectors[order])
    _, first, of = np.unique(vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
    members: list[list[int]] = [[] for _ in first]
    for at, group in enumerate(of.tolist()):
        if len(members[group]) <= k:  # the smallest ids; one may be the query's own row
            members[group].append(at)
    codes = codes.take(order[first])
    vectors = vectors[first].astype(np.float64)
    norms = np.sqrt((vectors * vectors).sum(1))
    out, reranked = [], 0
    for a in range(0, len(queries), 32):
        q = queries[a : a + 32].astype(np.float64)
        q_norms = np.sqrt((q * q).sum(1))
        estimate, error = bounds(codes, Asked(asked.planes[a : a + 32], asked.scalars[a : a + 32]))
        low, high = estimate - error, estimate + error
        # one more than k: the best may be the query itself
        nth = max(0, low.shape[1] - k - 1)
        least = np.partition(low, nth, axis=1)[:, nth]
        for i in range(len(q)):
            near = np.nonzero(high[i] >= least[i])[0]
            reranked += len(near)
            exact = (vectors[near] * q[i]).sum(1) / (norms[near] * q_norms[i])
            cut = np.partition(exact, -(k + 1))[-(k + 1)] if len(exact) > k + 1 else -2.0
            own = int(query_rows[a + i])
            found = sorted((-s, int(ids[m]), int(rows[m])) for s, r in zip(exact.tolist(), near.tolist(), strict=True) if s >= cut for m in members[r] if rows[m] != own)[:k]
            out += [(own, row, vec, -s) for s, vec, row in found]
    return out, reranked / max(1, len(queries) * len(first))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (the components as they are), dim of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.size("embedding").alias("dim"))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL").where(finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).reshape(-1, dim)


def _words(column: pa.ChunkedArray, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), *shape)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square overflows
    return x / np.linalg.norm(x, axis=1)[:, None]


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            yield dim, b.filter(pa.array(dims == dim))


def means(rows: DataFrame) -> dict[int, np.ndarray]:
    """The mean direction of the vectors of each length: a row for each length and component comes to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for dim, b in _by_length(batches):
            total[dim] = total.get(dim, 0) + np.append(_unit(_matrix(b.column("v"), dim)).sum(0), b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["dim", "total"])

    parts = rows.select("dim", "v").mapInArrow(sums, "dim int, total array<double>").select("dim", F.posexplode("total").alias("d", "x")).groupBy("dim", "d").agg(F.sum("x").alias("x")).collect()
    out: dict[int, np.ndarray] = {}
    for r in parts:
        out.setdefault(r.dim, np.zeros(r.dim + 1))[r.d] = r.x
    return {dim: x[:-1] / max(1, x[-1]) for dim, x in out.items()}


def coded(rows: DataFrame, mean: dict[int, np.ndarray]) -> DataFrame:
    """rows with code (packed signs) and its scalars: code_length, with_mean, fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in _by_length(batches):
            c = Codes.of(_unit(_matrix(b.column("v"), dim)), mean[dim])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([w.tobytes() for w in c.words], pa.binary()), pa.array(c.length), pa.array(c.with_mean), pa.array(c.fit)], [*b.schema.names, *names])

    names = ["code", "code_length", "with_mean", "fit"]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("code", T.BinaryType()), *(T.StructField(n, T.DoubleType()) for n in names[1:])]))


def asked(rows: DataFrame, mean: dict[int, np.ndarray]) -> DataFrame:
    """rows with planes (packed) and scalars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b in _by_length(batches):
            x = Asked.of(_unit(_matrix(b.column("v"), dim)), mean[dim])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([w.tobytes() for w in x.planes], pa.binary()), pa.array(x.scalars.tolist(), pa.list_(pa.float64()))], [*b.schema.names, "planes", "scalars"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("planes", T.BinaryType()), T.StructField("scalars", T.ArrayType(T.DoubleType()))]))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score, reranked: for each row where is_query holds, the k other rows of the largest cosine.
    reranked is the share of its group's pairs that were compared exactly."""
    rows = common.staged(valid(vectors).withColumn("row", F.monotonically_increasing_id()))
    mean = means(rows)
    shapes = rows.groupBy("dim").agg(F.ceil(F.count("*") / ROWS).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.count_if(is_query) / QUERIES)).alias("parties"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    by = ["dim", "block", "party"]
    data = coded(rows, mean).join(shapes, "dim").withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).withColumn("party", every("parties"))
    asks = asked(rows.where(is_query), mean).join(shapes, "dim").withColumn("party", F.pmod(F.xxhash64("row", F.lit(1)), "parties")).withColumn("block", every("blocks"))
    data = data.select(*by, "row", "vec_id", "v", "code", "code_length", "with_mean", "fit")
    asks = asks.select(*(F.col(c).alias(f"at_{c}") for c in by), F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("query"), "planes", "scalars")

    def run(d: pa.Table, q: pa.Table) -> pa.Table:
        found: list[Found] = []
        share = 0.0
        if d.num_rows and q.num_rows:
            dim = d.column("dim")[0].as_py()
            width = code_bits(dim) // 64
            codes = Codes(_words(d.column("code"), width), *(d.column(c).to_numpy() for c in ("code_length", "with_mean", "fit")))
            planes = Asked(_words(q.column("planes"), PLANES, width), _matrix(q.column("scalars"), 6))
            found, share = search(d.column("vec_id").to_numpy(), d.column("row").to_numpy(), _matrix(d.column("v"), dim), codes, q.column("query_row").to_numpy(), _matrix(q.column("query"), dim), planes, k)
        of = dict(zip(q.column("query_row").to_pylist(), q.column("query_id").to_pylist(), strict=True))
        cols = list(zip(*found, strict=True)) or [(), (), (), ()]
        return pa.table({"query_row": pa.array(cols[0], pa.int64()), "query_id": pa.array([of[x] for x in cols[0]], pa.int64()), "row": pa.array(cols[1], pa.int64()), "vec_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.float64()), "reranked": pa.array([share] * len(found), pa.float64())})

    found = data.groupBy(*by).cogroup(asks.groupBy(*(f"at_{c}" for c in by))).applyInArrow(run, "query_row long, query_id long, row long, vec_id long, score double, reranked double")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "reranked")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of each vector whose id is divisible by 50."""
    return nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("reranked")
