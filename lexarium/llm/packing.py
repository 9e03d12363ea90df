"""Packing of token sequences by cutting-stock column generation.

Texts are tokenised once; ids go to the shared folder as two-byte numbers. A text's whole multiples of the sequence
length are sequences of their own; its rest falls in one of CLASSES length classes. The histogram of all rests (at most
CLASSES rows) goes to the driver, where a linear program over packing patterns is solved by column generation: an
integer knapsack dynamic program prices new patterns with the duals of the basis until none improves.

Each task then packs blocks of the stored texts: a block takes its share of every pattern, rounded down, and deals its
texts to them, ranked by length in each class. Texts that rounding leaves are cut to fill the gaps that class rounding
leaves in the patterns' sequences, and then one after another to whole sequences. What ends a block becomes sequences
whose lengths are powers of two, so nothing is padded. No shuffle, and no group that grows: a block is bounded by rows
and tokens, and its sequences are numbered by task and place.

Defined cases: a null or empty text has the end id only; a text may be far longer than a sequence; repeated rows and
repeated ids are packed each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import common

LENGTH = 4096
CLASSES = 64
END_ID = 2
#: Runs that a worker keeps, and their bytes.
CACHE_WORDS, CACHE_BYTES = 600_000, 16_000_000
#: ASCII marks that begin no contraction and no special token of the vocabulary.
MARKS = b".,;:!?#$%&*()[]|/+=\""
BLOCK_ROWS, BLOCK_TOKENS = 20_000, 12_000_000


class Tokenizer(dict):
    """Runs of bytes between ASCII white space to their ids as two-byte numbers.

    The vocabulary drops white space and no rule of it reaches across, so a text's ids are those of its runs in turn. It
    lowers letters, and splits letters and digits from marks, so a run in capitals, or with MARKS after a
    letter, has the ids of what it is made of. A full cache is emptied: that changes the cost only.
    """

    def __init__(self, vocabulary: str) -> None:
        super().__init__()
        self.size = 0
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(vocabulary)
        if self.library.get_vocab_size() > 65536:
            raise ValueError("ids of more than two bytes")

    def __missing__(self, run: bytes) -> bytes:
        core = run.rstrip(MARKS)
        if core and len(core) < len(run) and core.decode()[-1].lower().isalpha():
            out = self[core] + self[run[len(core) :]]
        elif (low := run.lower()) != run and b"<|" not in run:
            out = self[low]
        else:
            out = array("H", self.library.encode(run.decode(), add_special_tokens=False).ids).tobytes()
        self.size += len(run) + len(out)
        self[run] = out
        return out

    def forget(self) -> None:
        self.clear()
        self.size = 0

    def ids(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS or self.size > CACHE_BYTES:
            self.forget()
        return b"".join(map(self.__getitem__, text.encode().split()))


@lru_cache(maxsize=1)
def tokenizer(vocabulary: str) -> Tokenizer:
    return Tokenizer(vocabulary)


def tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, doc_tokens, ids (two bytes each, with the end id)."""
    end = np.uint16(END_ID).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for b in batches:
            ids = [own.ids(t) + end for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "doc_tokens", "ids"])
        own.forget()  # workers outlive their stage

    return common.documents(docs).mapInArrow(run, "doc_id long, doc_tokens long, ids binary")


def class_of(rest: int, length: int = LENGTH) -> int:
    """1..CLASSES: how many units of length / CLASSES the rest needs."""
    return -(-rest * CLASSES // length)


def knapsack(values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The pattern (copies of each class, class i + 1 needing i + 1 units) of the largest value within size units."""
    best, last = np.zeros(size + 1), np.full(size + 1, -1)
    for room in range(1, size + 1):
        best[room], last[room] = best[room - 1], -1
        for i in range(min(room, len(values))):
            if (v := best[room - i - 1] + values[i]) > best[room] + 1e-12:
                best[room], last[room] = v, i
    pattern, room = np.zeros(len(values), dtype=np.int64), size
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= last[room] + 1
    return float(best[size]), pattern


def patterns(histogram: np.ndarray, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """(pattern, how often) with the fewest sequences that hold all rests: the linear program by column generation."""
    n = len(histogram)
    demand = histogram.astype(float)
    basis = np.diag([float(n // (i + 1)) for i in range(n)])  # a column for each class by itself
    for _ in range(rounds):
        level = np.linalg.solve(basis, demand)
        value, column = knapsack(np.linalg.solve(basis.T, np.ones(n)), n)
        if value <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, column.astype(float))
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    level = np.linalg.solve(basis, demand)
    return [(basis[:, k].astype(np.int64), float(level[k])) for k in np.argsort(-level, kind="stable") if level[k] > 1e-9]


def pack(sizes: np.ndarray, chosen: list[tuple[np.ndarray, float]], share: float, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (row, start, size) of texts of the given sizes; every token is in one piece."""
    whole = [[(row, start, length)] for row, size in enumerate(sizes.tolist()) for start in range(0, size - length + 1, length)]
    rest = sizes % length
    ranked: list[list[int]] = [[] for _ in range(CLASSES + 1)]
    for row in np.lexsort((np.arange(len(sizes)), rest)).tolist():  # the longest of a class is the last, and is taken first
        if rest[row]:
            ranked[class_of(int(rest[row]), length)].append(row)
    built: list[list[tuple[int, int, int]]] = []
    for pattern, often in chosen:
        used = np.nonzero(pattern)[0]
        times = min([int(often * share), *(len(ranked[i + 1]) // int(pattern[i]) for i in used)])
        for _ in range(times):
            rows = [ranked[i + 1].pop() for i in used for _ in range(int(pattern[i]))]
            built.append([(r, int(sizes[r] - rest[r]), int(rest[r])) for r in rows])
    left = [(r, int(sizes[r] - rest[r]), int(rest[r])) for rows in ranked for r in rows]
    out = whole
    k = 0
    while k < len(built):
        sequence, gap = built[k], length - sum(p[2] for p in built[k])
        k += 1
        while gap:
            if not left:
                if k >= len(built):
                    break
                left.extend(built.pop())  # the last pattern's texts fill gaps in place of it
            row, start, size = left.pop()
            cut = min(gap, size)
            sequence.append((row, start, cut))
            if size > cut:
                left.append((row, start + cut, size - cut))
            gap -= cut
        if gap:
            left.extend(sequence)
        else:
            out.append(sequence)
    total = sum(p[2] for p in left)
    while total:
        room = min(length, 1 << (total.bit_length() - 1))
        total -= room
        sequence = []
        while room:
            row, start, size = left.pop()
            cut = min(room, size)
            sequence.append((row, start, cut))
            if size > cut:
                left.append((row, start + cut, size - cut))
            room -= cut
        out.append(sequence)
    return out


def packed(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    stored = common.staged(tokenised(docs, vocabulary or public_tokenizers.path("word_bpe_49k.json")))
    rest = F.col("doc_tokens") % LENGTH
    counts = stored.groupBy(F.ceil(rest * CLASSES / LENGTH).cast("int").alias("c")).agg(F.count("*").alias("n")).collect()
    histogram = np.zeros(CLASSES)
    for r in counts:  # at most CLASSES + 1 rows
        if r.c:
            histogram[r.c - 1] = r.n
    total = sum(r.n for r in counts)
    chosen = patterns(histogram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 33
        rows: list[tuple[int, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal serial
            out: list[tuple] = []
            for sequence in pack(np.array([len(x) for _, x in rows]), chosen, len(rows) / total):
                at = 0
                for row, start, size in sequence:
                    doc_id, ids = rows[row]
                    out.append((doc_id, start, size, zlib.crc32(ids[start : start + size].astype("<u4").tobytes()), len(ids), serial, at))
                    at += size
                serial += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                rows.append((doc_id, np.frombuffer(ids, dtype=np.uint16)))
                tokens += len(ids) // 2
                if len(rows) >= BLOCK_ROWS or tokens >= BLOCK_TOKENS:
                    yield flush()
                    rows, tokens = [], 0
        if rows:
            yield flush()

    return stored.select("doc_id", "ids").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packed(common.table(spark, sf_dir, "documents"))
