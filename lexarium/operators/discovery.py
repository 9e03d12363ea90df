"""Word discovery: runs of 2 to 5 neighbouring tokens scored by dominance, neighbour entropy and how often they go on.

Texts are read once: each becomes the 64-bit hashes of its words, which are staged, and everything after works on these numbers, many
texts at a time. A run can only be in enough documents if both runs of one token fewer are, so sizes are counted one after the other:
a task sums what it has met before it is shuffled, and the hashes of enough documents become a bit map of bounded size by which the
next size is sieved. Only what passes all sieves is written out with its neighbours and counted exactly; a hash or bit that two runs
share costs time, not rows. Texts of runs are put together at the end, from the table of words. That no two words and no two runs that
count have one hash is checked by their words; if two have, all is done again with another seed.

Defined cases: null and empty texts have no runs; a run at a line's edge has the edge (^ or $) as its neighbour; rows
that repeat an id count as one document; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.functions import reading
from lexarium.functions.reading import Read, Reader
from lexarium.operators import store
from lexarium.sources import shared

LONGEST = 5
#: Bits of a sieve at most (16 MB), characters and tokens that are worked on at once, sums that a task holds before it puts them out.
BITS, CHARACTERS, AT_ONCE, HELD = 1 << 27, 1 << 22, 1 << 20, 1 << 21
#: Low bits of a run's hash that give way to the number of its document where documents are counted.
DOC_BITS = 14
_FACTORS = np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tokens(read: Read) -> pa.Array:
    """The hashes of each text's words, with a zero after each line."""
    mixed = np.zeros(len(read.hashes) + len(read.lines), np.uint64)
    mixed[np.arange(len(read.hashes)) + np.searchsorted(read.lines, read.first)] = read.hashes
    ends = 8 * (np.searchsorted(read.first, read.texts) + np.searchsorted(read.lines, read.texts))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(mixed)])


def _rows(many: int, **columns: pa.Array) -> pa.RecordBatch:
    types = {"tokens": pa.binary(), "word": pa.string(), "w": pa.int64(), "n": pa.int64()}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(many, t) for c, t in types.items()], list(types))


def encoded(docs: DataFrame, seed: int) -> DataFrame:
    """A row a document: tokens, the hashes of its words with a zero after each line; and the sums of many texts' words: word, w (its hash), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(seed)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for begin, end in reading.slices(texts, CHARACTERS):
                read = reader.read(texts[begin:end])
                yield _rows(end - begin, tokens=tokens(read))
                words, w, n, _, _ = read.distinct()  # a word that another one's hash stands for is there too, so that it is seen
                yield _rows(len(words), word=words, w=pa.array(w.view(np.int64)), n=pa.array(n))

    return docs.select("text").mapInArrow(run, "tokens binary, word string, w long, n long")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens of whole documents, with a zero before the first, and the number of each token's document in the slice: about AT_ONCE tokens
    at a time, of fewer documents than DOC_BITS can number."""
    for b in batches:
        held, n = [], 0
        for i, tokens in enumerate(column := b.column("tokens").to_pylist(), 1):
            held.append(tokens)
            n += len(tokens) // 8
            if n > AT_ONCE or len(held) == (1 << DOC_BITS) - 1 or i == len(column):
                lengths = [1] + [len(x) // 8 for x in held]
                yield np.frombuffer(b"".join([bytes(8), *held]), dtype=np.uint64), np.repeat(np.arange(len(lengths)), lengths)
                held, n = [], 0


def runs(w: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, hash) of the runs of that size within lines."""
    n = max(0, len(w) - size + 1)
    real = w != 0
    whole = real[:n].copy()
    for k in range(1, size):
        whole &= real[k : n + k]
    first = np.flatnonzero(whole)
    if size == 1:
        return first, w[first]
    return first, sum((w[first + k] * _FACTORS[k] for k in range(size)), np.zeros(len(first), np.uint64))


def passing(w: np.ndarray, size: int, sieves: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of runs() those of which both parts of one token fewer pass."""
    own, h = runs(w, size - 1)
    good = np.zeros(len(w) + 1, dtype=bool)
    good[own[has_bit(sieves[size - 1], h)]] = True
    first = np.flatnonzero(good[:-1] & good[1:])
    first = first[w[first + size - 1] != 0] if size == 2 else first
    return first, sum((w[first + k] * _FACTORS[k] for k in range(size)), np.zeros(len(first), np.uint64))


def has_bit(sieve: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(DOC_BITS)) % np.uint64(len(sieve) * 8)
    return (sieve[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def counts(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an array in order, and how often each stands there."""
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))
    return ordered[at], np.diff(np.append(at, len(ordered)))


def counted(coded: DataFrame, size: int, sieves: dict[int, np.ndarray], least_df: int) -> DataFrame:
    """h (the high bits of hashes) of the runs of that size in least_df documents or more."""
    sent = coded.sparkSession.sparkContext.broadcast(sieves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sums() -> pa.RecordBatch:
            h, df = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, each = counts(h[order])
            df = np.add.reduceat(df[order], np.cumsum(each) - each) if len(h) else df
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(df)], ["h", "df"])

        for w, doc in slices(batches):
            first, h = passing(w, size, sent.value)
            by_doc = (h >> np.uint64(DOC_BITS) << np.uint64(DOC_BITS)) | doc[first].astype(np.uint64)
            by_doc.sort()
            held.append(counts(counts(by_doc)[0] >> np.uint64(DOC_BITS)))
            n += len(held[-1][0])
            if n > HELD:
                yield sums()
                held, n = [], 0
        if held:
            yield sums()

    return coded.select("tokens").mapInArrow(run, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")).where(F.col("df") >= least_df).select("h")


def sieve_of(hashes: DataFrame) -> np.ndarray:
    """A bit for each h, of 16 a hash and BITS at most, made of partial maps of 4 KB."""
    n = hashes.count()
    bits = min(BITS, 1 << max(15, (16 * n).bit_length()))
    at = hashes.select(F.pmod("h", F.lit(bits)).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits")).collect()
    out = np.zeros((bits // 32768, 4096), dtype=np.uint8)
    for r in parts:
        out[r.k - 1] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.ravel()


def written(coded: DataFrame, sieves: dict[int, np.ndarray], longest: int, beside: bool) -> DataFrame:
    """Sums of slices of what passes the sieves: runs (h, other: another hash, n: occurrences, df, and their words' hashes, w0 and on), or with beside their
    neighbours (h, after: on which side, x: the neighbour's hash, 0 at a line's edge, n)."""
    sent = coded.sparkSession.sparkContext.broadcast(sieves)
    parts = [f"w{k}" for k in range(longest)]

    def rows(**columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns.values()], list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, doc in slices(batches):
            known, number = np.unique(w, return_inverse=True) if beside else (w, w)
            for size in range(2, longest + 1):
                first, h = passing(w, size, sent.value)
                kept = has_bit(sent.value[size], h)
                first, h = first[kept], h[kept]
                own, one, group = np.unique(h, return_index=True, return_inverse=True)
                if beside:
                    for after, next_to in ((False, number[first - 1]), (True, number[first + size])):
                        sides, n = counts(np.sort(group << 32 | next_to))
                        yield rows(h=own[sides >> 32], after=np.full(len(n), after), x=known[sides & 0xFFFFFFFF], n=n)
                    continue
                by_doc, _ = counts(np.sort(group << 32 | doc[first]))
                # a run that another one's hash stands for is put out too, without occurrences of its own, so that it is seen
                hidden = np.flatnonzero(np.any([w[first + k] != w[first[one] + k][group] for k in range(size)], axis=0))
                at, more = np.concatenate([one, hidden]), (0, len(hidden))
                words = {c: w[first[at] + k] if k < size else np.zeros(len(at), np.int64) for k, c in enumerate(parts)}
                other = sum((words[c] * _FACTORS[longest + k] for k, c in enumerate(parts[:size])), np.zeros(len(at), np.uint64))
                yield rows(h=h[at], other=other, n=np.pad(np.bincount(group, minlength=len(own)), more), df=np.pad(np.bincount(by_doc >> 32, minlength=len(own)), more), **words)

    return coded.mapInArrow(run, "h long, after boolean, x long, n long" if beside else ", ".join(f"{c} long" for c in ("h", "other", "n", "df", *parts)))


def discovered(docs: DataFrame, least_df: int = 3, longest: int = LONGEST, seed: int = 0) -> DataFrame:
    """term, size, tf, df, dominance (tf over that of the rarest part), entropy (of the poorer side), extends (the largest share
    that one neighbour continues to a longer run; 0 for the longest)."""
    read = shared.staged(encoded(shared.spread(store.whole(docs)), seed))
    coded = read.where("tokens IS NOT NULL").select("tokens")
    words = shared.staged(read.where("word IS NOT NULL").groupBy("word", "w").agg(F.sum("n").alias("word_tf")))
    sieves = {1: sieve_of(words.where(F.col("word_tf") >= least_df).select(F.shiftrightunsigned("w", DOC_BITS).alias("h")))}
    for size in range(2, longest + 1):
        sieves[size] = sieve_of(shared.staged(counted(coded, size, sieves, least_df)))
    parts = [f"w{k}" for k in range(longest)]
    met = written(coded, sieves, longest, False).groupBy("h").agg(F.sum("n").alias("tf"), F.sum("df").alias("df"), F.min("other").alias("least"), F.max("other").alias("most"), *[F.min(c).alias(c) for c in parts])
    often = shared.staged(met)
    if not (words.groupBy("w").count().where("count > 1").isEmpty() and often.where("least <> most").isEmpty()):
        return discovered(docs, least_df, longest, seed + 1)
    often = often.where(F.col("df") >= least_df).select("h", "tf", "df", F.array(*parts).alias("w"))
    named = often.select("h", F.posexplode("w").alias("k", "w")).where("w <> 0").join(words, "w")
    terms = named.groupBy("h").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("term"), F.count("*").cast("int").alias("size"), F.min("word_tf").alias("rarest"))
    by_side = written(coded, sieves, longest, True).groupBy("h", "after", "x").agg(F.sum("n").cast("double").alias("c"))
    h = F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")
    real = F.max(F.when(F.col("x") != 0, F.col("c")))
    sides = by_side.groupBy("h", "after").agg(h.alias("e"), real.alias("most")).groupBy("h").agg(F.min("e").alias("e"), F.coalesce(F.max("most"), F.lit(0.0)).alias("most"))
    out = often.join(terms, "h").join(sides, "h")
    extends = F.when(F.col("size") < longest, F.col("most") / F.col("tf")).otherwise(0.0)
    return out.select("term", "size", "tf", "df", F.round(F.col("tf") / F.col("rarest").cast("double"), 12).alias("dominance"), F.round(F.abs("e"), 6).alias("entropy"), F.round(extends, 12).alias("extends"))


def selected(found: DataFrame, entropy: float = 1.0, dominance: float = 0.6, extends: float = 0.6, block: tuple[str, ...] = (), titles: tuple[str, ...] = (), leading: tuple[str, ...] = (), ending: tuple[str, ...] = (), allow: tuple[str, ...] = ()) -> DataFrame:
    """Terms free enough at both sides, bound enough inside, and that seldom go on; without blocked ones, those that begin with
    a leading word or end with an ending one, and a title before a term that is found itself. allow: found ones that stay."""
    words = F.split("term", " ")
    first, last = words[0], F.element_at(words, -1)
    listed = lambda c, names: c.isin(*names) if names else F.lit(False)
    good = found.where((F.col("entropy") >= entropy) & (F.col("extends") < extends) & (F.col("dominance") >= dominance))
    rest = F.when(listed(first, titles), F.array_join(F.slice(words, 2, F.size(words) - 1), " "))
    titled = good.select("term", rest.alias("rest")).where("rest IS NOT NULL").join(good.select(F.col("term").alias("rest")), "rest", "left_semi").select("term")
    kept = good.where(~listed(F.col("term"), block) & ~listed(first, leading) & ~listed(last, ending)).join(titled, "term", "left_anti")
    return kept.unionByName(found.where(listed(F.col("term"), allow))).dropDuplicates(["term"])
