"""Language-model scores from Elias-Fano n-gram tries.

Words are known by 64-bit hashes; a word's id is its hash's place among those of the training texts. N-grams of two and
three words that occur at least LEAST times are kept (of a kept three-word gram both pairs are kept, so only those are
counted). Probabilities are smoothed by interpolated absolute discounting down to the additive single-word model; what
discounts and left-out grams release goes to the shorter context. They are stored as eight-bit logarithms.

A pair's hash deals it and all that follows it to a shard, so a frequent word's grams are spread over all shards. A
shard is a file of levels: context words, monotone pointers to their successors, the successors themselves as prefix
sums, each an Elias-Fano sequence, and the probabilities. A successor is sought from its context's prefix sum: a select
over the upper bits finds its bucket, whose few lower parts are compared.

Files lie in the shared folder and are memory-mapped where that is a mounted path; from other stores a worker keeps a
copy in its temporary folder for its own time. Nothing of the model passes through the driver but numbers of rows.

Defined cases: a null or empty text is its end only; without training texts every word is unknown, N and V are 0; words
are runs of bytes other than ASCII white space; repeated rows count as often as they occur; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import common

LEAST, DISCOUNT, ADDED = 2, 0.9, 0.1
#: Training tokens to a shard, words to a vocabulary file or a block of contexts, and tokens counted at a time.
SHARD_TOKENS, BLOCK_WORDS, CHUNK_TOKENS = 8_000_000, 1 << 20, 1_000_000
CACHE_WORDS = 400_000
END = b""
#: An eight-bit step of a stored logarithm, base 10.
STEP = 1 / 28


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 0)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes: A-Z only, and space and \t-\r only


# Elias-Fano sequences

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)
#: Place of the r-th one of a byte, at byte * 8 + r.
_SELECT = np.zeros(256 * 8, dtype=np.int64)
for _b in range(256):
    _SELECT[_b * 8 : _b * 8 + _BYTE_BITS[_b].sum()] = np.nonzero(_BYTE_BITS[_b])[0]


class EliasFano:
    """A monotone sequence: lower bits in whole bytes, upper parts in unary, and counts of ones before each 64 bits."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, n: int, top: int) -> None:
        self.low, self.high, self.ones, self.n, self.top = low, high, ones, n, top
        self.shift = np.uint64(low.dtype.itemsize * 8 if len(low) or low.dtype != np.uint8 else 8)
        self.zeros = (np.arange(len(ones), dtype=np.int64) * 64 - ones).astype(np.uint32)

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        spare = (top // max(1, n)).bit_length() - 1
        kind = np.uint8 if spare < 11 else np.uint16 if spare < 26 else np.uint32
        shift = np.uint64(np.dtype(kind).itemsize * 8)
        at = (values >> shift).astype(np.int64) + np.arange(n)
        bits = np.zeros(((int(at[-1]) + 2 if n else 1) // 64 + 1) * 64, dtype=np.uint8)
        bits[at] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.bitwise_count(high).cumsum(dtype=np.int64)])[:-1].astype(np.uint32)
        return EliasFano(values.astype(kind), high, ones, n, top)

    def _select(self, rank: np.ndarray, zeros: bool) -> np.ndarray:
        before = self.zeros if zeros else self.ones
        at = np.searchsorted(before, rank.astype(np.uint32), side="right") - 1
        rank = rank - before[at]
        word = self.high[at]
        if zeros:
            word = ~word
        at *= 64
        for half in (32, 16, 8):  # narrow down to the byte
            ones = np.bitwise_count(word & np.uint64((1 << half) - 1)).astype(np.int64)
            on = rank >= ones
            rank = rank - ones * on
            at += half * on
            word = word >> (np.uint64(half) * on)
        return at + _SELECT[(word & np.uint64(255)).astype(np.int64) * 8 + rank]

    def get(self, i: np.ndarray) -> np.ndarray:
        if not len(i):
            return np.zeros(0, dtype=np.uint64)
        return ((self._select(i, False) - i).astype(np.uint64) << self.shift) | self.low[i].astype(np.uint64)

    def all(self) -> np.ndarray:
        at = np.nonzero(np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little"))[0]
        return ((at - np.arange(self.n)).astype(np.uint64) << self.shift) | np.asarray(self.low).astype(np.uint64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each x, or -1: select the bucket of its upper part, then compare lower parts."""
        out = np.full(len(x), -1, dtype=np.int64)
        live = np.nonzero(x <= np.uint64(self.top))[0] if self.n else np.zeros(0, dtype=np.int64)
        if not len(live):
            return out
        upper = (x[live] >> self.shift).astype(np.int64)
        lower = x[live].astype(self.low.dtype)
        bit = np.zeros(len(live), dtype=np.int64)
        some = upper > 0
        bit[some] = self._select(upper[some] - 1, True) + 1
        at = bit - upper
        for _ in range(2):  # most buckets have an element or two
            inside = (at < self.n) & ((self.high[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            live, at, bit, lower, upper = live[inside], at[inside], bit[inside], lower[inside], upper[inside]
            own = self.low[at]
            hit = own == lower
            out[live[hit]] = at[hit]
            on = own < lower
            live, at, bit, lower, upper = live[on], at[on] + 1, bit[on] + 1, lower[on], upper[on]
        if len(live):  # long ones are halved
            last = self._select(upper, True) - upper
            first, end = at, last
            while (end > first).any():
                half = (first + end) >> 1
                on = (first < end) & (self.low[np.minimum(half, self.n - 1)] < lower)
                end = np.where((first < end) & ~on, half, end)
                first = np.where(on, half + 1, first)
            hit = (first < last) & (self.low[np.minimum(first, self.n - 1)] == lower)
            out[live[hit]] = first[hit]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones, f"{name}.size": np.array([self.n, self.top], dtype=np.int64)}

    @staticmethod
    def of(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, top = np.asarray(arrays[f"{name}.size"]).tolist()
        return EliasFano(arrays[f"{name}.low"], arrays[f"{name}.high"], np.asarray(arrays[f"{name}.ones"]), n, top)


# files of the shared folder


def files_of(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store and path of a folder; Hadoop's names for S3 are those of the one store."""
    scheme, sep, rest = folder.partition("://")
    return pyarrow.fs.FileSystem.from_uri(f"s3{sep}{rest}" if scheme in ("s3a", "s3n") else folder)


def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """Written whole under another name, then renamed: a task that is run again leaves the same file."""
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = (v.dtype.str, at, len(v))
        at += -(-v.nbytes // 8) * 8
    first = json.dumps(head).encode()
    first += b" " * (-(len(first) + 8) % 8)
    fs, path = files_of(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{os.getpid()}-{np.random.default_rng().integers(1 << 60)}"
    with fs.open_output_stream(part) as f:
        f.write(len(first).to_bytes(8, "little") + first)
        for v in arrays.values():
            f.write(v.tobytes() + b"\0" * (-v.nbytes % 8))
    fs.move(part, f"{path}/{name}")


@lru_cache(maxsize=None)
def _copies() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="lexarium-")


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The file's arrays, memory-mapped."""
    fs, path = files_of(folder)
    path = f"{path}/{name}"
    if fs.type_name != "local":
        local = os.path.join(_copies().name, f"{abs(hash(folder))}-{name}")
        if not os.path.exists(local):
            pyarrow.fs.copy_files(path, f"{local}.part", source_filesystem=fs, destination_filesystem=pyarrow.fs.LocalFileSystem())
            os.replace(f"{local}.part", local)
        path = local
    raw = np.memmap(path, dtype=np.uint8, mode="r").view(np.ndarray)
    start = 8 + int(raw[:8].view(np.uint64)[0])
    head = json.loads(bytes(raw[8:start]))
    return {k: raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, (kind, at, n) in head.items()}


# the model


def coded(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-log10 / STEP), 0, 255).astype(np.uint8)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards


def by_shard(shard: np.ndarray, rows: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that has some of the rows, with them in order."""
    of = shard[rows].astype(np.uint16 if shards < 65536 else np.int64)  # two bytes are sorted by radix
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(shards + 1)).tolist()
    for k in range(shards):
        if edges[k + 1] > edges[k]:
            yield k, rows[order[edges[k] : edges[k + 1]]]


class Vocabulary:
    """Ids and counts of the training words, in files by the upper bits of the hash."""

    def __init__(self, folder: str, bits: int, sizes: list[int], total: int) -> None:
        self.folder, self.bits, self.total = folder, bits, total
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.n = int(self.starts[-1])
        self.files = [load(folder, f"words-{k}") if s else None for k, s in enumerate(sizes)]
        self.met: dict[bytes, int] = {}
        self.end = self.look_up([END])[0] if self.n else -1

    def look_up(self, words: list[bytes]) -> list[int]:
        hashes = np.array([hash_of(w) for w in words], dtype=np.uint64)
        out = np.full(len(words), -1, dtype=np.int64)
        part = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(words), dtype=np.int64)
        for k in np.unique(part).tolist():
            if self.files and self.files[k] is not None:
                rows = np.nonzero(part == k)[0]
                known = self.files[k]["hash"]
                at = np.minimum(np.searchsorted(known, hashes[rows]), len(known) - 1)
                out[rows] = np.where(known[at] == hashes[rows], at + self.starts[k], -1)
        return out.tolist()

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.met) > CACHE_WORDS:
            self.met.clear()
        column = pa.array(words, pa.binary()).dictionary_encode()  # a dictionary of many words is slow to ask, so once for each
        distinct = column.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.met]
        self.met.update(zip(new, self.look_up(new), strict=True))
        return np.fromiter(map(self.met.__getitem__, distinct), dtype=np.int64, count=len(distinct))[column.indices.to_numpy()]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of ids; 0 for -1."""
        out = np.zeros(len(ids), dtype=np.int64)
        part = np.searchsorted(self.starts, ids, side="right") - 1
        for k in np.unique(part[ids >= 0]).tolist():
            rows = np.nonzero((part == k) & (ids >= 0))[0]
            out[rows] = self.files[k]["count"][ids[rows] - self.starts[k]]
        return out

    def single(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the additive probability of words of these counts."""
        return np.log10((counts + ADDED) / (self.total + ADDED * (self.n + 1)))


class Model:
    def __init__(self, folder: str, bits: int, sizes: tuple[int, ...], total: int, shards: int, order: int) -> None:
        self.words = Vocabulary(folder, bits, list(sizes), total)
        self.folder, self.shards, self.order = folder, shards, order
        self.pairs: dict[int, dict] = {}
        self.triples: dict[int, dict] = {}
        self.blocks: dict[int, np.ndarray] = {}

    def pair(self, shard: int) -> dict | None:
        if shard not in self.pairs:
            a = load(self.folder, f"pairs-{shard}")
            self.pairs[shard] = {"contexts": EliasFano.of(a, "contexts"), "pointers": EliasFano.of(a, "pointers"), "next": EliasFano.of(a, "next"), "code": a["code"]}
        return self.pairs[shard]

    def triple(self, shard: int) -> dict:
        if shard not in self.triples:
            a = load(self.folder, f"triples-{shard}")
            self.triples[shard] = {"pointers": EliasFano.of(a, "pointers"), "next": EliasFano.of(a, "next"), "code": a["code"], "back": a["back"]}
        return self.triples[shard]

    def back(self, ids: np.ndarray) -> np.ndarray:
        """log10 of what a context word leaves to single words; 0 for unknown words."""
        out = np.zeros(len(ids))
        block = ids // BLOCK_WORDS
        for k in np.unique(block[ids >= 0]).tolist():
            if k not in self.blocks:
                self.blocks[k] = load(self.folder, f"back-{k}")["back"]
            rows = np.nonzero((block == k) & (ids >= 0))[0]
            out[rows] = self.blocks[k][ids[rows] - k * BLOCK_WORDS]
        return out

    def find_pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """shard, place in it (-1: not kept) and code of each pair."""
        place, code = np.full(len(a), -1, dtype=np.int64), np.zeros(len(a), dtype=np.int64)
        known = (a >= 0) & (b >= 0)
        key = (np.where(known, a, 0).astype(np.uint64) << np.uint64(32)) | np.where(known, b, 0).astype(np.uint64)
        shard = shard_of(key, self.shards)
        for k, rows in by_shard(shard, np.nonzero(known)[0], self.shards):
            x = self.pair(k)
            found = search_next(x["contexts"], x["pointers"], x["next"], a[rows], b[rows])
            place[rows] = found
            code[rows[found >= 0]] = x["code"][found[found >= 0]]
        return shard, place, code

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 of each token's probability; ids begin each text with the end's id (at starts), which has none itself (0)."""
        single = self.words.single(self.words.counts(ids))
        before = np.concatenate([[-1], ids[:-1]])
        first = np.zeros(len(ids), dtype=bool)
        first[starts] = True
        before[first] = -1
        shard, place, code = self.find_pairs(before, ids)
        out = np.where(place >= 0, -STEP * code, self.back(before) + single)
        if self.order > 2:
            context = np.concatenate([[-1], place[:-1]])
            context[first] = -1
            context_shard = np.concatenate([[0], shard[:-1]])
            for k, rows in by_shard(context_shard, np.nonzero((context >= 0) & ~first)[0], self.shards):
                x = self.triple(k)
                found = np.full(len(rows), -1, dtype=np.int64)
                known = ids[rows] >= 0
                found[known] = search_next(None, x["pointers"], x["next"], context[rows][known], ids[rows][known])
                out[rows] = np.where(found >= 0, -STEP * x["code"][np.maximum(found, 0)] if len(x["code"]) else 0.0, out[rows] - STEP * x["back"][context[rows]])
        out[first] = 0.0
        return out


def search_next(contexts: EliasFano | None, pointers: EliasFano, following: EliasFano, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The place of each word among its context's successors, or -1. Contexts recur, so each is placed once."""
    distinct, of = np.unique(context, return_inverse=True)
    k = contexts.find(distinct.astype(np.uint64)) if contexts is not None else distinct
    known = np.nonzero(k >= 0)[0]
    low, high, base = (np.zeros(len(distinct), dtype=np.int64) for _ in range(3))
    low[known], high[known] = pointers.get(k[known]).astype(np.int64), pointers.get(k[known] + 1).astype(np.int64)
    later = known[low[known] > 0]
    base[later] = following.get(low[later] - 1).astype(np.int64)
    out = np.full(len(word), -1, dtype=np.int64)
    rows = np.nonzero(high[of] > low[of])[0]
    found = following.find((base[of[rows]] + word[rows] + 1).astype(np.uint64))
    inside = (found >= low[of[rows]]) & (found < high[of[rows]])
    out[rows[inside]] = found[inside]
    return out


def levels(context: np.ndarray, word: np.ndarray, contexts: int) -> tuple[EliasFano, EliasFano]:
    """pointers and successors of sorted (context place, word): a successor is its word + 1 over the last of the context before."""
    counts = np.bincount(context, minlength=contexts).astype(np.int64)
    pointers = np.concatenate([[0], counts.cumsum()])
    ends = pointers[1:][counts > 0] - 1
    used = np.concatenate([[0], (word[ends] + 1).cumsum()])[:-1] if len(ends) else np.zeros(0, dtype=np.int64)
    base = np.repeat(used, counts[counts > 0])
    return EliasFano.build(pointers), EliasFano.build(base + word + 1)


@lru_cache(maxsize=1)
def model(*about) -> Model:
    return Model(*about)


def sequence(own: Vocabulary, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of all texts, each begun and ended by the end's id; starts and lengths of the texts."""
    split = [words_of(t) for t in texts]
    lengths = np.array([len(w) + 2 for w in split], dtype=np.int64)
    starts = np.concatenate([[0], lengths.cumsum()])[:-1].astype(np.int64) if len(split) else lengths
    ids = own.ids([w for s in split for w in (END, *s, END)])
    return ids, starts, lengths


def encoded(docs: DataFrame, about: tuple, keep: Column | None = None) -> DataFrame:
    """doc_id, trains (where keep holds), ids (sequence() of the text, one more each, in four bytes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(*about).words
        for b in batches:
            ids, _, lengths = sequence(own, b.column("text").to_pylist())
            ends = np.concatenate([[0], lengths.cumsum() * 4]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer((ids + 1).astype(np.uint32))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("trains"), column], ["doc_id", "trains", "ids"])

    return common.documents(docs, (F.lit(False) if keep is None else keep).alias("trains")).mapInArrow(run, "doc_id long, trains boolean, ids binary")


def read_ids(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What sequence() gave for encoded() rows."""
    raw = rows.to_pylist()
    lengths = np.array([len(x) // 4 for x in raw], dtype=np.int64)
    return np.frombuffer(b"".join(raw), dtype=np.uint32).astype(np.int64) - 1, lengths.cumsum() - lengths, lengths


def _counted_words(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            hashes = np.array([hash_of(w) for w in counts], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(list(counts.values()), pa.int64())], ["hash", "n"])

        counts: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                counts.update(words_of(t))
                counts[END] += 1
            if len(counts) > CACHE_WORDS:
                yield out()
                counts.clear()
        yield out()

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _dealt(keys: list[np.ndarray], shards: list[np.ndarray], n: int) -> pa.RecordBatch:
    """A row for each shard: its distinct keys, sorted, and how often each came."""
    key, shard = np.concatenate(keys), np.concatenate(shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(n + 1))
    rows = []
    for k in range(n):
        if edges[k + 1] > edges[k]:
            distinct, often = np.unique(key[order[edges[k] : edges[k + 1]]], return_counts=True)
            rows.append((k, distinct.tobytes(), often.astype(np.uint32).tobytes()))
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], ["shard", "keys", "counts"])


def _counted_grams(rows: DataFrame, about: tuple, order: int) -> DataFrame:
    """shard, keys, counts, of encoded() rows: of pairs (ids in the upper and lower half), or of the words after kept pairs (place and id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(*about)
        keys, shards, size = [], [], 0
        for b in batches:
            ids, starts, _ = read_ids(b.column("ids"))
            before = np.concatenate([[-1], ids[:-1]])
            before[starts] = -1
            if order == 2:
                at = before >= 0
                key = (before[at].astype(np.uint64) << np.uint64(32)) | ids[at].astype(np.uint64)
                shard = shard_of(key, own.shards)
            else:
                shard, place, _ = own.find_pairs(before, ids)
                context = np.concatenate([[-1], place[:-1]])
                context[starts] = -1
                at = np.nonzero((context >= 0) & (place >= 0))[0]
                key, shard = (context[at].astype(np.uint64) << np.uint64(32)) | ids[at].astype(np.uint64), shard[at - 1]
            keys.append(key)
            shards.append(shard)
            size += len(key)
            if size >= CHUNK_TOKENS:
                yield _dealt(keys, shards, own.shards)
                keys, shards, size = [], [], 0
        if size:
            yield _dealt(keys, shards, own.shards)

    def merge(t: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(t.column("keys").to_pylist()), dtype=np.uint64)
        often = np.frombuffer(b"".join(t.column("counts").to_pylist()), dtype=np.uint32)
        order = np.argsort(key, kind="stable")
        key, often = key[order], often[order]
        first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        total = np.add.reduceat(often.astype(np.int64), first)
        kept = total >= LEAST
        return pa.table({"shard": t.column("shard")[:1], "keys": pa.array([key[first][kept].tobytes()], pa.binary()), "counts": pa.array([total[kept].tobytes()], pa.binary())})

    return rows.mapInArrow(run, "shard int, keys binary, counts binary").groupBy("shard").applyInArrow(merge, "shard int, keys binary, counts binary")


def _read_grams(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = np.frombuffer(t.column("keys")[0].as_py(), dtype=np.uint64)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), np.frombuffer(t.column("counts")[0].as_py(), dtype=np.int64)


def _write_backs(pairs: DataFrame, about: tuple) -> None:
    """For blocks of context words: what their discounted successors leave."""

    def partial(t: pa.Table) -> pa.Table:
        a, _, n = _read_grams(t)
        ids, first = np.unique(a, return_index=True)
        kept = np.add.reduceat(n - DISCOUNT, first) if len(ids) else np.zeros(0)
        block = ids // BLOCK_WORDS
        rows = [(k, ids[block == k].tobytes(), kept[block == k].tobytes()) for k in np.unique(block).tolist()]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table({"block": pa.array(columns[0], pa.int64()), "ids": pa.array(columns[1], pa.binary()), "kept": pa.array(columns[2], pa.binary())})

    def write(t: pa.Table) -> pa.Table:
        own = model(*about)
        block = t.column("block")[0].as_py()
        kept = np.zeros(min(BLOCK_WORDS, own.words.n - block * BLOCK_WORDS))
        for ids, x in zip(t.column("ids").to_pylist(), t.column("kept").to_pylist(), strict=True):
            kept[np.frombuffer(ids, dtype=np.int64) - block * BLOCK_WORDS] += np.frombuffer(x, dtype=np.float64)
        counts = own.words.counts(np.arange(len(kept)) + block * BLOCK_WORDS)
        save(own.folder, f"back-{block}", {"back": np.log10(np.maximum(1 - kept / np.maximum(counts, 1), 1e-6)).astype(np.float32)})
        return pa.table({"block": pa.array([block], pa.int64())})

    blocks = pairs.sparkSession.range(-(-sum(about[2]) // BLOCK_WORDS)).select(F.col("id").alias("block"), F.lit(b"").alias("ids"), F.lit(b"").alias("kept"))
    parts = pairs.groupBy("shard").applyInArrow(partial, "block long, ids binary, kept binary")
    parts.unionAll(blocks).groupBy("block").applyInArrow(write, "block long").agg(F.count("*")).collect()


def _write_pairs(pairs: DataFrame, about: tuple) -> None:
    def write(t: pa.Table) -> pa.Table:
        own = model(*about)
        a, b, n = _read_grams(t)
        contexts, of = np.unique(a, return_inverse=True)
        pointers, following = levels(of, b, len(contexts))
        p = (n - DISCOUNT) / np.maximum(own.words.counts(a), 1) + 10.0 ** (own.back(a) + own.words.single(own.words.counts(b)))
        save(own.folder, f"pairs-{t.column('shard')[0].as_py()}", EliasFano.build(contexts).arrays("contexts") | pointers.arrays("pointers") | following.arrays("next") | {"code": coded(np.log10(p))})
        return pa.table({"shard": t.column("shard")[:1]})

    pairs.groupBy("shard").applyInArrow(write, "shard int").agg(F.count("*")).collect()


def _write_triples(pairs: DataFrame, triples: DataFrame, about: tuple) -> None:
    def write(p: pa.Table, t: pa.Table) -> pa.Table:
        own = model(*about)
        _, second, often = _read_grams(p)
        place, word, n = _read_grams(t) if t.num_rows else (np.zeros(0, dtype=np.int64),) * 3
        pointers, following = levels(place, word, len(second))
        kept = np.bincount(place, n - DISCOUNT, len(second))
        back = coded(np.log10(np.maximum(1 - kept / np.maximum(often, 1), 1e-6)))
        _, found, code = own.find_pairs(second[place], word)
        shorter = np.where(found >= 0, -STEP * code, own.back(second[place]) + own.words.single(own.words.counts(word)))
        chance = (n - DISCOUNT) / np.maximum(often[place], 1) + 10.0 ** (shorter - STEP * back[place])
        save(own.folder, f"triples-{p.column('shard')[0].as_py()}", pointers.arrays("pointers") | following.arrays("next") | {"code": coded(np.log10(chance)), "back": back})
        return pa.table({"shard": p.column("shard")[:1]})

    pairs.groupBy("shard").cogroup(triples.groupBy("shard")).applyInArrow(write, "shard int").agg(F.count("*")).collect()


def train(docs: DataFrame, keep: Column, order: int = 3) -> tuple:
    """Writes the model of the rows where keep holds; returns what Model() takes."""
    return trained(docs, keep, order)[0]


def trained(docs: DataFrame, keep: Column, order: int = 3) -> tuple[tuple, DataFrame]:
    """train(), and encoded() of all rows: words are looked up once, for pairs, for triples and for scores."""
    spark = docs.sparkSession
    folder = common.shared_folder(spark)
    texts = common.documents(docs).where(keep).select("text")
    counted = common.staged(_counted_words(texts))
    size = counted.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    bits = max(0, (max(1, size.v) // BLOCK_WORDS).bit_length())
    upper = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")

    def write(t: pa.Table) -> pa.Table:
        hashes, n = t.column("hash").to_numpy().view(np.uint64), t.column("n").to_numpy()
        by = np.argsort(hashes)
        save(folder, f"words-{t.column('part')[0].as_py()}", {"hash": hashes[by], "count": n[by]})
        return pa.table({"part": t.column("part")[:1], "n": pa.array([len(n)], pa.int64())})

    sizes = [0] * (1 << bits)
    for r in counted.withColumn("part", upper).groupBy("part").applyInArrow(write, "part long, n long").collect():  # a row a file
        sizes[r.part] = r.n
    shards = max(1, -(-size.n // SHARD_TOKENS))
    about = (folder, bits, tuple(sizes), int(size.n), shards, order)
    if size.v >> 32:
        raise ValueError("more words than 32 bits can number")
    rows = common.staged(encoded(docs, about, keep))
    if size.v:
        # every shard has a row, also one without pairs
        empty = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(b"").alias("keys"), F.lit(b"").alias("counts"))
        pairs = _filled(_counted_grams(rows.where("trains"), about, 2), empty)
        _write_backs(pairs, about)
        _write_pairs(pairs, about)
        if order > 2:
            _write_triples(pairs, _filled(_counted_grams(rows.where("trains"), about, 3), empty), about)
    return about, rows


def _filled(grams: DataFrame, empty: DataFrame) -> DataFrame:
    found = common.staged(grams)
    return found.unionAll(empty.join(found.select("shard").distinct(), "shard", "left_anti"))


def scored(docs: DataFrame, about: tuple) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row."""
    return scored_ids(encoded(docs, about), about)


def scored_ids(rows: DataFrame, about: tuple) -> DataFrame:
    """scored() of encoded() rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(*about)
        for b in batches:
            ids, starts, lengths = read_ids(b.column("ids"))
            if not len(starts):
                continue
            counts = own.words.counts(ids)
            single = own.words.single(counts) if own.words.n else np.full(len(ids), 0.0)
            known = (counts > 0).astype(np.int64)
            single[starts], known[starts] = 0.0, 0
            full = own.log10(ids, starts) if own.words.n else single
            sums = [np.add.reduceat(x, starts) for x in (known, single, full)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lengths - 1), pa.array(sums[0]), pa.array(np.full(len(starts), own.words.total)), pa.array(sums[1]), pa.array(sums[2])], names)

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents; rows whose crc32(doc_id) mod 10 is 0 don't train."""
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.remainder("doc_id", 10) == 0
    about, rows = trained(docs, ~held_out)
    found = scored_ids(rows, about)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
