"""Byte-level BPE by DuckDB recursive queries inside Spark partitions.

A partition's texts are split with the vocabulary's pattern. Each piece that the worker hasn't met yet becomes
token-position rows, one a byte. The recursive query joins neighbouring rows with the merge table, contracts each
piece's leftmost pair of minimum rank, and drops a piece from the recursion at its fixpoint. Ordered aggregation gives
a piece's ids. Ids are decoded by joining (text, position, id) rows with the vocabulary and aggregating bytes in order:
`decode` takes any column of ids, and `digests` decodes the ids that it has put together for each text.

A piece of over LONG bytes is contracted in chunks of CHUNK bytes. A sequence of tokens is the encoding of its bytes exactly
if each two neighbours are the encoding of theirs (the first merge across a border would happen as well with these two
alone), so borders of chunks are tested, and what lies about a border that fails is contracted again as one chunk.

Pieces recur, so a worker keeps the ids of about CACHE_PIECES of them between batches, in two halves: when the newer one is
full the older one goes, with the pieces that haven't come again since. Those are simply encoded anew, so the bound changes
the cost only.

Defined cases: a null text is an empty one, with no ids; a piece may be as long as the text; repeated rows give
repeated results; a null id is kept; null or no ids decode to no bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import common

CACHE_PIECES = 700_000
LONG, CHUNK = 96, 64
#: Ids to one run of the decoding query.
DECODED_IDS = 2_000_000
#: Pieces to one run of the recursive query, and their bytes.
PIECES, PIECE_BYTES = 50_000, 1_000_000

ENCODE = """
WITH RECURSIVE step(piece, pos, tok, done) AS (
  SELECT piece, pos, tok, false FROM start
  UNION ALL
  SELECT piece, pos, tok, done FROM (
    WITH neighbours AS (
      SELECT piece, pos, tok, lag(pos) OVER beside AS before, lead(tok) OVER beside AS next_tok
      FROM step WHERE NOT done WINDOW beside AS (PARTITION BY piece ORDER BY pos)),
    ranked AS (
      SELECT n.*, m.rank * 4294967296 + n.pos AS place
      FROM neighbours n LEFT JOIN merges m ON m.pair = n.tok::BIGINT * 4294967296 + n.next_tok),
    leftmost AS (SELECT piece, min(place) // 4294967296 AS merged, min(place) % 4294967296 AS hit FROM ranked GROUP BY piece)
    SELECT r.piece, r.pos, CASE WHEN r.pos = l.hit THEN l.merged::INTEGER ELSE r.tok END AS tok, l.hit IS NULL AS done
    FROM ranked r JOIN leftmost l USING (piece)
    WHERE l.hit IS NULL OR r.before IS DISTINCT FROM l.hit)
)
SELECT piece, list(tok ORDER BY pos) AS ids FROM step WHERE done GROUP BY piece
"""

DECODE = """
SELECT i.text, string_agg(v.bytes, '' ORDER BY i.pos) AS decoded FROM ids i JOIN vocabulary v ON v.tok = i.tok GROUP BY i.text
"""


class Encoder:
    """The vocabulary and merge table in a DuckDB connection of one thread, and the pieces met so far."""

    def __init__(self, vocabulary: str, pattern: str) -> None:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]
        self.met: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # the older half
        self.bytes = {r: t for t, r in ranks.items()}
        self.joined: dict[tuple[int, int], bool] = {}  # neighbours that stay as they are
        # every way to make a token of two others
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        p = np.array(pairs, dtype=np.int64)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self._load("merges", pa.table({"pair": p[:, 0] * 4294967296 + p[:, 1], "rank": p[:, 2]}))
        self._load("vocabulary", pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "bytes": [t.hex() for t in ranks]}))

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("arriving", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM arriving")
        self.db.unregister("arriving")

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces and keeps their ids. A piece that is itself a token is that token, as in the library."""
        raw = [(piece, piece.encode()) for piece in pieces]
        short = [(piece, b) for piece, b in raw if b not in self.ranks and len(b) <= LONG]
        self.met.update((piece, np.uint32(self.ranks[b]).tobytes()) for piece, b in raw if b in self.ranks)
        for (piece, _), ids in zip(short, self.contract([b for _, b in short]), strict=True):
            self.met[piece] = ids.tobytes()
        for piece, b in raw:
            if b not in self.ranks and len(b) > LONG:
                self.met[piece] = self.contract_long(b).tobytes()

    def contract(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of each byte string, by runs of the recursive query."""
        out, k = [], 0
        while k < len(raw):
            n, size = k, 0
            while n < len(raw) and n - k < PIECES and (size == 0 or size + len(raw[n]) <= PIECE_BYTES):
                size += len(raw[n])
                n += 1
            out += self._contract(raw[k:n])
            k = n
        return out

    def _contract(self, raw: list[bytes]) -> list[np.ndarray]:
        size = np.array([len(b) for b in raw])
        tok = self.of_byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        self.db.register("start", pa.table({"piece": np.repeat(np.arange(len(raw), dtype=np.int32), size), "pos": np.arange(len(tok), dtype=np.int64), "tok": tok}))
        got = self.db.sql(ENCODE).to_arrow_table()
        self.db.unregister("start")
        ids = got.column("ids").combine_chunks()
        values, offsets = ids.values.to_numpy().astype(np.uint32), ids.offsets.to_numpy()
        out = [np.zeros(0, np.uint32)] * len(raw)
        for at, a, b in zip(got.column("piece").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            out[at] = values[a:b]
        return out

    def stay(self, pairs: set[tuple[int, int]]) -> None:
        """Learns of each pair of ids whether they are the encoding of their bytes."""
        new = sorted(pairs.difference(self.joined))
        for pair, ids in zip(new, self.contract([self.bytes[a] + self.bytes[b] for a, b in new]), strict=True):
            self.joined[pair] = tuple(ids.tolist()) == pair

    def contract_long(self, b: bytes) -> np.ndarray:
        """Ids of a long byte string. Of chunks whose border fails the halves beside it become one chunk; from the third time on whole chunks."""
        parts = self.contract([b[k : k + CHUNK] for k in range(0, len(b), CHUNK)])
        turn = 0
        while True:
            if len(self.joined) > CACHE_PIECES:
                self.joined.clear()
            borders = [(int(x[-1]), int(y[0])) for x, y in zip(parts, parts[1:], strict=False)]
            self.stay(set(borders))
            if all(map(self.joined.__getitem__, borders)):
                return np.concatenate(parts)
            pieces: list[list[np.ndarray]] = [[]]  # runs of ids that are contracted together
            for k, ids in enumerate(parts):
                left, right = k > 0 and not self.joined[borders[k - 1]], k < len(borders) and not self.joined[borders[k]]
                cuts = [] if turn >= 2 else ([len(ids) // 2] if left and right else [-(-len(ids) // 2)] if left or right else [])
                halves = np.split(ids, cuts)
                for i, half in enumerate(halves):
                    if i or not left:
                        pieces.append([])
                    pieces[-1].append(half)
            runs = [x for x in pieces if sum(map(len, x))]
            again = [k for k, x in enumerate(runs) if len(x) > 1]
            done = self.contract([b"".join(self.bytes[i] for h in runs[k] for i in h.tolist()) for k in again])
            parts = [np.concatenate(x) for x in runs]
            for k, ids in zip(again, done, strict=True):
                parts[k] = ids
            turn += 1

    def decode(self, of: list[np.ndarray]) -> list[bytes]:
        """The bytes of each array of ids, from the vocabulary alone."""
        out, k = [b""] * len(of), 0
        while k < len(of):
            n, size = k, 0
            while n < len(of) and (size == 0 or size + len(of[n]) <= DECODED_IDS):
                size += len(of[n])
                n += 1
            lengths = [len(x) for x in of[k:n]]
            rows = pa.table({"text": np.repeat(np.arange(k, n, dtype=np.int32), lengths), "pos": np.arange(size, dtype=np.int64), "tok": np.concatenate(of[k:n]).astype(np.int32)})
            self.db.register("ids", rows)
            got = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("ids")
            for at, text in zip(got.column("text").to_pylist(), got.column("decoded"), strict=True):
                out[at] = bytes.fromhex(text.as_py())
            k = n
        return out

    def split(self, texts: list[str]) -> list[list[str]]:
        """Each text's pieces, all of them met."""
        if len(self.met) > CACHE_PIECES // 2:
            self.before, self.met = self.met, {}
        split = [self.pattern.findall(t) for t in texts]
        new = {p for pieces in split for p in pieces}.difference(self.met)
        again = new.intersection(self.before)
        self.met.update((p, self.before[p]) for p in again)
        self.learn(sorted(new - again))
        return split

    def ids(self, pieces: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.met.__getitem__, pieces)), dtype=np.uint32)


@lru_cache(maxsize=1)
def encoder(vocabulary: str, pattern: str) -> Encoder:
    return Encoder(vocabulary, pattern)


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (array of int) of each text."""
    at = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(at, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                ids = [own.ids(s).astype(np.int32) for s in own.split(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return common.documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, decoded (binary) of rows with doc_id and ids (array of int). Ids that the vocabulary lacks fail."""
    at = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(at, public_tokenizers.PATTERN)
        for b in batches:
            of = [np.array(x or [], dtype=np.int32) for x in b.column("ids").to_pylist()]
            if any(i not in own.bytes for x in of for i in set(x.tolist())):
                raise ValueError("an id that isn't in the vocabulary")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(own.decode(of), pa.binary())], ["doc_id", "decoded"])

    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """encode() and decode() of its ids, as hashes made where they are: only digests leave the worker."""
    at = vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(at, pattern)
        for b in batches:
            ids = [own.ids(s) for s in own.split(b.column("text").to_pylist())]
            of_ids = [hashlib.sha256(",".join(map(own.names.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]
            of_bytes = [hashlib.sha256(x).hexdigest() for x in own.decode(ids)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and their decoding, as digests."""
    return digests(common.table(spark, sf_dir, "documents"))
