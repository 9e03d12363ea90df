"""What the operators share: table reading, tables staged in the shared folder, text splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch; texts are long, and a batch must stay small beside a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Bits that stand for a set of ids at most (16 MB).
MARK_BITS = 1 << 27


def session(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches of BATCH_ROWS rows and about BATCH_BYTES bytes (from now on, for its other queries too: later
    tasks of a lazy result need them), and the folder of spark.checkpoint.dir; one of its own only on a single machine where none is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.sparkContext.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(at or tempfile.mkdtemp(prefix="lexarium-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the cluster's checkpoint folder; deleted when the driver ends."""
    session(spark)
    at = f"{spark.sparkContext.getCheckpointDir()}/lexarium-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    atexit.register(_forget, fs, path)
    return at


def _forget(fs, path) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # the JVM has ended before: its folder goes with the session
        return


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written once to the shared folder and read back: later jobs neither recompute it nor depend on the executors that made it."""
    at = shared_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and what else is asked for; whatever other columns there are stay out. A null text is an empty one."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def id_marks(hashes: DataFrame) -> np.ndarray | None:
    """One bit for each hash h (mod the number of bits, 16 a row, MARK_BITS at most): rows without their bit aren't among them.
    None if so few bits would say little."""
    n = hashes.count()
    bits = 1 << max(15, (16 * n - 1).bit_length())
    if bits > MARK_BITS:
        return None
    at = hashes.select(F.pmod("h", F.lit(bits)).alias("h"))
    parts = at.groupBy(F.bitmap_bucket_number(F.col("h") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("h") + 1)).alias("bits")).collect()  # of 4 KB each
    out = np.zeros((bits // 32768, 4096), dtype=np.uint8)
    for r in parts:
        out[r.k - 1] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.ravel()


def mark_test(spark: SparkSession, marks: np.ndarray | None):
    """A function of hashes, for use in tasks: which have their bit. All of them if marks is None."""
    sent = spark.sparkContext.broadcast(marks) if marks is not None else None

    def has(h: np.ndarray) -> np.ndarray:
        if sent is None:
            return np.ones(len(h), dtype=bool)
        own = sent.value
        at = h & np.int64(len(own) * 8 - 1)
        return (own[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    return has


def flagged(df: DataFrame, h: Column, marks: np.ndarray | None, flag: str) -> DataFrame:
    """df with a column of that name: true for rows whose hash has its bit."""
    has = mark_test(df.sparkSession, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rest = b.select(range(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(has(b.column(b.num_columns - 1).to_numpy()))], [*rest.schema.names, flag])

    return df.select("*", h.alias("_h")).mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(flag, T.BooleanType())]))


def with_result(df: DataFrame, compute, name: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """df with a further column: compute(texts) of whole texts, a null one as empty. All columns pass as they are, without a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(compute([t or "" for t in b.column("text").to_pylist()]), arrow)
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))]))


def remainder(of: str, n: int):
    """crc32 of the id as text, mod n; a null id has the remainder of the empty text."""
    return F.crc32(F.coalesce(F.col(of).cast("string"), F.lit(""))) % n
