"""Near duplicates by SimHash, searched with the generalised pigeonhole principle.

A fingerprint of 64 bits is made of each text. Equal fingerprints collapse to one node before anything is compared.
Two fingerprints within `radius` bits must, for thresholds t_1..t_m with sum(t_i) = radius - m + 1 over a partition of
the bits, agree within t_i bits in at least one part i. Correlated bits are put in the same part, and a dynamic program
chooses the thresholds (a part may get -1: it isn't probed) with the fewest estimated candidates. Every fingerprint is
indexed by the exact value of each part and probes the values within t_i bits; what meets is verified on all 64 bits.
A choice of parts and thresholds changes the cost only, never the links found.

Buckets in which many fingerprints meet are compared in blocks that return a spanning forest, so no group emits all of
its pairs. Components are found by alternating star contractions on the shared folder.

Where a least similarity is asked for, equal sets of shingles are one node, and what links by fingerprints comes first: each
of those links is held against the whole sets before it counts. A similar pair may differ in more bits than any exact search
prunes, so what fingerprints leave apart is completed by candidates that share a shingle of their prefixes (frequent shingles
last), which no pair of that similarity can avoid; their whole sets are compared as well: pair by pair, or in blocks
(blocks.py) where many nodes share a shingle.

Defined cases: a null text is an empty one; a text without words has fingerprint 0 and is linked like any other; a text
with fewer words than a shingle has one shingle; repeated rows and ties share a fingerprint, and the smallest id names
the component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import blocks, common
from lexarium.llm.sets import jaccard, node_of, shingle_hashes, shingle_set, texts_of, words_of

BITS = 64
#: Fingerprints from which bit correlations and candidate counts are estimated: a cost choice, not a filter.
SAMPLE = 2048
#: A bucket is compared in blocks from so many index rows on, and so many times those that even dealing would give it.
HOT_ROWS, HOT_TIMES = 64, 16
BLOCK = 2048
#: Documents from which frequent shingles are taken, and how many of these at most: a cost choice, not a filter.
SAMPLED, LATE = 4096, 100_000
#: Nodes that share one of these least hashes are joined by links to one of them, in as many turns with another one each; then
#: pairs of buckets are compared, of those of DENSE nodes or more in blocks, of others where they meet: a cost choice.
FACTORS = tuple(int(x) | 1 for x in np.random.default_rng(3).integers(1 << 62, 1 << 63, 4, dtype=np.uint64))
DENSE, TURNS = 16, 2
#: Shingles of a group of sets that are compared in one place, 8 bytes each.
CHUNK = 2_000_000


def majority(parts: Iterator[np.ndarray] | list[np.ndarray]) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without hashes."""
    total, n = np.zeros(BITS, dtype=np.int64), 0
    for h in parts:
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(total * 2 > n).view(">u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """Of all shingles of the text, repeats included."""
    return majority(shingle_hashes(words_of(text), words))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return common.documents(docs).mapInArrow(run, "doc_id long, fp long")


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles of three sampled documents or more, at most LATE. They only order the others: what isn't here costs time, not links."""
    step = max(1, docs.count() // SAMPLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view(np.int64))], ["value"])

    drawn = common.documents(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text").distinct()
    found = drawn.mapInArrow(run, "value long").groupBy("value").agg(F.count("*").alias("n")).where("n >= 3")
    return np.sort(np.array([r.value for r in found.orderBy(F.col("n").desc(), "value").limit(LATE).select("value").collect()], dtype=np.int64).view(np.uint64))


def prefix_size(n: Column, least: float) -> Column:
    return F.when(n > 0, n - F.ceil(n * least - 1e-9) + 1).otherwise(0)


def prefixes(docs: DataFrame, words: int, least: float) -> DataFrame:
    """doc_id, text_key (hash of the text), fp (fingerprint()), node (hash of the shingle set), n (shingles), prefix, last, mins: the set's first
    n - ceil(least n) + 1 shingles as ordered numbers, frequent ones last, the greatest of them, and the set's least hashes.

    Two sets of the least similarity share least * max(n, m) shingles or more, so the first one they share, in any order that
    all sets follow, lies in both prefixes. Numbers keep 63 bits of a shingle's hash: what meets by accident is compared whole."""
    late = frequent(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node, n, prefix, mins = [], [], [], [], []
            for t in b.column("text").to_pylist():
                parts = list(shingle_hashes(words_of(t), words))
                own = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]))
                fp.append(majority(parts))
                at = np.minimum(np.searchsorted(late, own), max(0, len(late) - 1))
                first = np.where(late[at] == own, np.uint64(0), np.uint64(1 << 63)) if len(late) else np.uint64(1 << 63)  # the sign of what comes first
                number = np.sort(((own >> np.uint64(1)) | first).view(np.int64))
                node.append(node_of(own))
                n.append(len(own))
                mins.append([int(x) for x in (own * factor).min(1, initial=np.uint64(2**64 - 1)).view(np.int64)])
                prefix.append(number[: len(own) - int(np.ceil(least * len(own) - 1e-9)) + 1 if len(own) else 0])
            ends = np.cumsum([0, *map(len, prefix)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*prefix, np.zeros(0, np.int64)])))
            last = pa.array([int(x[-1]) if len(x) else 0 for x in prefix], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (fp, node)), pa.array(n, pa.int32()), lists, last, pa.array(mins, pa.list_(pa.int64()))], names)

    factor = np.array([[x] for x in FACTORS], dtype=np.uint64)
    names = ["doc_id", "text_key", "fp", "node", "n", "prefix", "last", "mins"]
    return common.documents(docs, text_key()).mapInArrow(run, "doc_id long, text_key long, fp long, node long, n int, prefix array<long>, last long, mins array<long>")


def once(prints: DataFrame, first: DataFrame) -> DataFrame:
    """node, n, prefix of prints, one row a node. Only rows of nodes that have several (first: node, rows) are brought together, and a
    few more by accident; the others stay where they lie."""
    marks = common.id_marks(first.where("rows > 1").select(F.col("node").alias("h")))
    rows = common.flagged(prints.select("node", "n", "prefix"), F.col("node"), marks, "perhaps")
    several = rows.where("perhaps").groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    return rows.where("NOT perhaps").select("node", "n", "prefix").unionAll(several)


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")


def meeting(nodes: DataFrame, least: float) -> DataFrame:
    """What meets by a number that several prefixes hold, a row for each pair and number: value, a, n, b, m (a, b: nodes whose
    sizes fit). Of a number that DENSE nodes or more hold, the nodes in place of pairs: value, a, n, and b is null.

    Rows are sorted by value in each partition and read as they come; a run is held up to DENSE rows."""
    rows = nodes.select(F.explode("prefix").alias("value"), "node", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32))
        dense = None  # the value of a run that goes on
        for b in batches:
            v, node, n = (np.concatenate([x, b.column(c).to_numpy()]) for x, c in zip(held, ("value", "node", "n"), strict=True))
            edges = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1], [True]])) if len(v) else np.zeros(1, np.int64)
            starts, sizes = edges[:-1], np.diff(edges)
            many = (sizes >= DENSE) | (v[starts] == dense if dense is not None else False)
            at = np.repeat(many, sizes)
            if at.any():
                yield _rows(v[at], node[at], n[at])
            ends = not len(sizes)
            yield from _pairs(v, node, n, starts[:-1][~many[:-1]], sizes[:-1][~many[:-1]], least)
            if ends:
                continue
            dense = int(v[-1]) if many[-1] else None
            k = len(v) if many[-1] else int(starts[-1])
            held = (v[k:], node[k:], n[k:])
        if len(held[0]):
            yield from _pairs(*held, np.zeros(1, np.int64), np.array([len(held[0])]), least)

    return rows.repartition("value").sortWithinPartitions("value").mapInArrow(run, "value long, a long, n int, b long, m int")


def _rows(value: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray | None = None, m: np.ndarray | None = None) -> pa.RecordBatch:
    other = [pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())] if b is None else [pa.array(b), pa.array(m)]
    return pa.RecordBatch.from_arrays([pa.array(value), pa.array(a), pa.array(n), *other], ["value", "a", "n", "b", "m"])


def _pairs(v: np.ndarray, node: np.ndarray, n: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """The pairs of each run of fewer than DENSE rows, the larger set (or greater node) first."""
    for size in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == size]
        i, j = np.triu_indices(size, 1)
        x, y = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
        fits = (np.minimum(n[x], n[y]) >= np.ceil(np.maximum(n[x], n[y]) * least - 1e-9)) & (node[x] != node[y])
        x, y = x[fits], y[fits]
        turn = (n[x] < n[y]) | ((n[x] == n[y]) & (node[x] < node[y]))
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        yield _rows(v[x], node[x], n[x], node[y], n[y])


def _fits(least: float) -> Column:
    """Sets of m and n shingles may reach the least similarity."""
    return F.least("n", "m") >= F.ceil(F.greatest("n", "m") * least - 1e-9)


def print_links(first: DataFrame, least: float, radius: int) -> DataFrame:
    """Candidates by fingerprints: a node's link to the least node of its fingerprint, and those nodes' links() of up to radius
    bits. first: node, fp, n. As star_links(), value is what links are compared by in one place."""
    least_of = common.staged(first.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("p")))
    named = least_of.select("fp", F.col("p.node").alias("other"), F.col("p.n").alias("m"))
    same = first.select("fp", "node", "n").join(named, "fp").where("node <> other").select(F.col("fp").alias("value"), "node", "n", "other", "m")
    prints = least_of.select("fp", F.col("fp").alias("node"), F.col("fp").alias("known"))
    near = common.staged(links(prints, probing(prints, radius), radius))
    near = near.join(named.toDF("a", "node", "n"), "a").join(named.toDF("b", "other", "m"), "b").select(F.col("b").alias("value"), "node", "n", "other", "m")
    return _edges(same.unionAll(near).where(_fits(least)))


def _edges(pairs: DataFrame) -> DataFrame:
    """Pairs value, node, n, other, m as distinct edges value, a, n, b, m, the larger set (or greater node) first."""
    one, two = F.struct("n", "node"), F.struct(F.col("m").alias("n"), F.col("other").alias("node"))
    edge = pairs.select("value", F.greatest(one, two).alias("x"), F.least(one, two).alias("y"))
    return edge.groupBy("x", "y").agg(F.min("value").alias("value")).select("value", F.col("x.node").alias("a"), F.col("x.n").alias("n"), F.col("y.node").alias("b"), F.col("y.n").alias("m"))


def star_links(sets: DataFrame, least: float, turn: int) -> DataFrame:
    """Candidates between the nodes that share a least hash and one of them: a few for each node, at most. They join most of a
    dense group before its pairs are compared. sets: node, n, mins, known."""
    rows = sets.select("node", "n", "known", F.posexplode("mins").alias("k", "value")).select("node", "n", "known", F.xxhash64("k", "value").alias("value"))
    pivots = rows.groupBy("value").agg(F.min("known").alias("x"), F.max("known").alias("y"), F.min_by(F.struct("node", "n", "known"), F.xxhash64("node", F.lit(turn))).alias("p"), F.count("*").alias("rows")).where("x <> y")
    pivots = pivots.where(F.col("rows") >= (DENSE if turn else 2))  # what is left of a small group is a few pairs
    pivots = pivots.select("value", F.col("p.node").alias("other"), F.col("p.n").alias("m"), F.col("p.known").alias("other_known"))
    return _edges(rows.join(pivots, "value").where((F.col("known") != F.col("other_known")) & _fits(least)))


def labels(links: DataFrame) -> DataFrame:
    """node, root of links' nodes: equal roots are connected, though not all that are connected have one root. Two steps to the least neighbour."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
    one = common.staged(both.groupBy("node").agg(F.min("root").alias("root")).select("node", F.least("node", "root").alias("root")))
    return common.staged(one.join(one.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.coalesce("further", "root").alias("root")))


def pair_links(met: DataFrame, together: DataFrame, first: DataFrame, least: float) -> DataFrame:
    """Candidates: pairs that aren't known to be together and share as many shingles of their prefixes as a pair of the least
    similarity must. Of two prefixes, the one that ends first has all of its shared shingles in the other; what it may share
    beyond is its set less its prefix. met: pairs by value; a pair that shares a dense value as well is compared there."""
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("m").alias("m"), F.min("value").alias("value"))
    need = F.ceil((F.col("n") + F.col("m")) * (least / (1 + least)) - 1e-9)
    beyond = lambda n: F.col(n) - prefix_size(F.col(n), least)
    pairs = pairs.where(F.col("shared") + F.greatest(beyond("n"), beyond("m")) >= need)
    for c in ("a", "b"):
        pairs = pairs.join(together.toDF(c, f"{c}_root"), c, "left")
    pairs = pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    ends = first.select("node", "last")
    pairs = pairs.join(ends.toDF("a", "a_last"), "a").join(ends.toDF("b", "b_last"), "b")
    reach = F.when(F.col("a_last") < F.col("b_last"), beyond("n")).when(F.col("a_last") > F.col("b_last"), beyond("m")).otherwise(F.greatest(beyond("n"), beyond("m")))
    return pairs.where(F.col("shared") + reach >= need).select("value", "a", "n", "b", "m")


def mixed(rows: DataFrame) -> DataFrame:
    """rows (value, node, n, known) of the values whose nodes aren't all known to be together."""
    values = rows.groupBy("value").agg(F.min("known").alias("x"), F.max("known").alias("y")).where("x <> y").select("value")
    return rows.join(values, "value", "left_semi")


def alike(edges: DataFrame, docs: DataFrame, first: DataFrame, words: int, least: float) -> DataFrame:
    """The edges of the least similarity, by whole shingle sets: a, b of edges value, a, n, b, m.

    Edges that met by one value are compared in one group, so that a text is sent once for many edges (texts are less than
    half of what their sets would be, and become sets where they are compared). Groups hold CHUNK shingles or so; where a value's nodes hold more, they are cut in blocks, and each two blocks are a group."""
    edges = common.staged(edges)
    ends = edges.select("value", F.col("a").alias("node"), "n").unionAll(edges.select("value", F.col("b").alias("node"), F.col("m").alias("n"))).distinct()
    weights = common.staged(ends.groupBy("value").agg(F.sum("n").alias("weight")))
    groups = max(1, int((weights.agg(F.sum("weight")).first()[0] or 0) // CHUNK))
    blocks = F.ceil(F.greatest("weight", F.lit(1)) / CHUNK)
    own = lambda node: F.pmod(F.xxhash64(node), blocks)
    by = ["g", "i", "j"]
    edges = edges.join(weights, "value").select("a", "b", F.when(blocks <= 1, F.pmod(F.xxhash64("value"), F.lit(groups))).otherwise(F.col("value")).alias("g"), own("a").alias("i"), own("b").alias("j"))
    ends = edges.select(*by, F.col("a").alias("node")).unionAll(edges.select(*by, F.col("b").alias("node"))).distinct().toDF("at_g", "at_i", "at_j", "node")
    ends = common.staged(ends.join(first.select("node", "first_id"), "node"))
    texts = texts_of(docs, ends.select("first_id").distinct())
    held = ends.join(texts, ends.first_id.eqNullSafe(texts.id)).select("at_g", "at_i", "at_j", "node", "text")

    def compare(e: pa.Table, s: pa.Table) -> pa.Table:
        sets = {}
        for node, text in zip(s.column("node").to_pylist(), s.column("text"), strict=True):
            own = shingle_set(text.as_py(), words)
            if node_of(own) == node & (2**64 - 1):  # an id may have other texts
                sets[node] = own
        near = [jaccard(sets[a], sets[b]) >= least for a, b in zip(e.column("a").to_pylist(), e.column("b").to_pylist(), strict=True)]
        return e.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return edges.groupBy(*by).cogroup(held.groupBy("at_g", "at_i", "at_j")).applyInArrow(compare, "a long, b long")


def parts_of(sample: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of even size; each starts at the free bit of the strongest correlations and takes those most correlated with it."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(float)  # bit 0: the highest
    corr = np.zeros((BITS, BITS))
    if len(sample) > 2:
        c = bits - bits.mean(0)
        sd = np.sqrt((c**2).mean(0)) + 1e-12
        corr = np.abs(c.T @ c / len(sample) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, out = list(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, out))) // (m - k)
        group = [max(free, key=lambda b: (corr[b, free].max(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def part_mask(group: list[int]) -> int:
    return sum(1 << (BITS - 1 - b) for b in group)


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i >= -1 with the given sum and the least sum of costs[i][t_i + 1]: dynamic programming over parts and the sum so far."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t1, c in enumerate(row):
                k = used + t1
                if k <= total + len(costs) and (k not in after or cost + c < after[k][0]):
                    after[k] = (cost + c, [*chosen, t1 - 1])
        best = after
    return best[total + len(costs)][1]


def plan(sample: np.ndarray, rows: int, radius: int) -> list[tuple[int, int]]:
    """(mask of the part's bits, threshold) for each part that is probed, by the least estimated probes and candidates."""
    best: tuple[float, list[tuple[int, int]]] | None = None
    x = sample[:, None] ^ sample[None, :] if len(sample) else np.zeros((0, 0), np.uint64)
    off = ~np.eye(len(sample), dtype=bool)
    for m in range(2, radius + 2):
        groups = parts_of(sample, m)
        costs = []
        for g in groups:
            near = np.bitwise_count(x & np.uint64(part_mask(g)))[off]
            row = [0.0]
            for t in range(min(radius - m + 1 + m, 3) + 1):
                probes = sum(comb(len(g), e) for e in range(t + 1))
                # the sample shows frequent meetings, the uniform share bounds the rare ones from below
                share = max((near <= t).mean() if near.size else 0.0, probes / 2.0 ** len(g))
                row.append(4.0 * probes + share * rows)
            costs.append(row)
        if radius + 1 > sum(len(r) - 1 for r in costs):
            continue
        t = allocate(costs, radius - m + 1)
        cost = sum(costs[i][t[i] + 1] for i in range(m))
        if best is None or cost < best[0]:
            best = (cost, [(part_mask(g), k) for g, k in zip(groups, t, strict=True) if k >= 0])
    return best[1]


def flips(mask: int, t: int) -> list[int]:
    """Signed longs: every change of up to t bits under the mask."""
    bits = [1 << b for b in range(BITS) if mask >> b & 1]
    out = [sum(c) for e in range(t + 1) for c in combinations(bits, e)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in out]


def _changed(own: Column, by: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(x).cast("long") for x in by]), lambda x: own.bitwiseXOR(x))


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def forest(a: pa.Table, b: pa.Table, radius: int) -> list[tuple[int, int]]:
    """Edges that join what links between a and b join; fewer than both have rows."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def side(t: pa.Table) -> tuple:
        known = t.column("known").to_numpy()
        return t.column("fp").to_numpy().view(np.uint64), known, known.tolist(), t.column("node").to_pylist()

    (fa, ka, la, na), (fb, kb, lb, nb) = side(a), side(b)
    out = []
    for k in range(0, len(fa), 256):
        near = (np.bitwise_count(fa[k : k + 256, None] ^ fb[None, :]) <= radius) & (ka[k : k + 256, None] != kb[None, :])
        for i, j in np.argwhere(near).tolist():
            ru, rv = root(la[k + i]), root(lb[j])
            if ru != rv:
                parent[max(ru, rv)] = min(ru, rv)
                out.append((na[k + i], nb[j]))
    return out


def probing(nodes: DataFrame, radius: int) -> list[tuple[int, int]]:
    """plan() for these nodes, from a sample of their fingerprints and their number."""
    drawn = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    return plan(np.array([r.fp for r in drawn], dtype=np.int64).view(np.uint64), nodes.count(), radius)


def links(nodes: DataFrame, chosen: list[tuple[int, int]], radius: int) -> DataFrame:
    """fp, node, known of distinct nodes to edges a, b between nodes. Links within radius bits between nodes not known to be
    together have the same components as these edges."""
    index = probes = None
    for k, (mask, t) in enumerate(chosen):
        own = F.col("fp").bitwiseAND(F.lit(signed(mask)))
        i = nodes.select(F.lit(k).alias("part"), own.alias("value"), "fp", "node", "known")
        p = nodes.select(F.lit(k).alias("part"), F.explode(_changed(own, flips(mask, t))).alias("value"), F.col("fp").alias("probe_fp"), F.col("node").alias("probe"), F.col("known").alias("probe_known"))
        index, probes = (i, p) if index is None else (index.unionAll(i), probes.unionAll(p))
    rows = nodes.count()
    limit = F.create_map(*[F.lit(x) for k, (mask, _) in enumerate(chosen) for x in (k, float(HOT_ROWS + HOT_TIMES * rows / 2.0 ** mask.bit_count()))])
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("probe_fp"))) <= radius) & (F.col("node") < F.col("probe")) & (F.col("known") != F.col("probe_known"))
    hot = common.staged(index.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") >= limit[F.col("part")]))
    none = hot.isEmpty()
    cool = index if none else index.join(hot, ["part", "value"], "left_anti")
    found = cool.join(probes, ["part", "value"]).where(near).select(F.col("probe").alias("a"), F.col("node").alias("b")).distinct()
    return found if none else found.unionAll(_in_blocks(index, probes, hot, radius))


def _in_blocks(index: DataFrame, probes: DataFrame, hot: DataFrame, radius: int) -> DataFrame:
    """The hot buckets' edges. Both sides are dealt to blocks of about BLOCK rows by hash, and every block meets every block in a group of its own."""
    p = probes.join(hot, ["part", "value"]).select("part", "value", F.col("probe_fp").alias("fp"), F.col("probe").alias("node"), F.col("probe_known").alias("known"))
    counts = p.groupBy("part", "value").agg(F.count("*").alias("np"))
    blocks = hot.join(counts, ["part", "value"]).select("part", "value", F.ceil(F.col("n") / BLOCK).alias("bi"), F.ceil(F.col("np") / BLOCK).alias("bp"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    i = index.join(blocks, ["part", "value"]).withColumn("i", F.pmod(F.xxhash64("node"), "bi")).withColumn("p", every("bp"))
    q = p.join(blocks, ["part", "value"]).withColumn("p", F.pmod(F.xxhash64("node"), "bp")).withColumn("i", every("bi"))
    cols = ["part", "value", "i", "p", "fp", "node", "known"]
    i, q = i.select(*cols), q.select(*cols)

    def run(t: pa.Table) -> pa.Table:
        of = t.column("side").to_numpy()
        e = np.array(forest(t.filter(pa.array(of == 0)), t.filter(pa.array(of == 1)), radius), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    both = i.withColumn("side", F.lit(0)).unionByName(q.withColumn("side", F.lit(1)))
    return both.groupBy(*cols[:4]).applyInArrow(run, "a long, b long").where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """Edges a, b to (node, root) of the nodes that aren't the least of their component, the root. Alternating large and small stars; each round is staged in the shared folder."""
    e = common.staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("a", "b", "m")
        e = common.staged(small.select("a", F.col("m").alias("b")).unionAll(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that links of up to radius bits reach."""
    prints = common.staged(fingerprints(docs, words))
    first = common.staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    nodes = first.select("fp", F.col("fp").alias("node"), F.col("fp").alias("known"))
    roots = components(links(nodes, probing(nodes, radius), radius))
    named = _named(first.withColumnRenamed("fp", "node"), roots)
    return prints.join(named.withColumnRenamed("node", "fp"), "fp").select("doc_id", "fp", "component_id")


def similar_documents(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 4) -> DataFrame:
    """doc_id, text_key, node, component_id, kept_node of every row: links are of nodes (sets of shingles) of the least Jaccard
    similarity over words-word shingles, found by fingerprints of up to radius differing bits first, and then by the shingles
    that their prefixes share. kept_node is that of the component's row of the smallest id (of several, the least node).

    Links by fingerprints come first, then those between nodes of one least hash, in TURNS; then only nodes that these leave
    apart are compared.
    """
    prints = common.staged(prefixes(docs, words, least))
    first = common.staged(prints.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("last").alias("last"), F.first("mins").alias("mins"), F.count("*").alias("rows")))
    links = common.staged(alike(print_links(first, least, radius), docs, first, words, least))
    known = labels(links)
    for turn in range(TURNS):
        edges = common.staged(star_links(_known(first.select("node", "n", "mins"), known), least, turn))
        if edges.isEmpty():
            break
        links = links.unionAll(common.staged(alike(edges, docs, first, words, least)))
        known = labels(links)
    together = common.staged(components(links))
    met = common.staged(meeting(once(prints, first), least))
    dense = met.where("b IS NULL").select("value", F.col("a").alias("node"), "n")
    pairs = met.where("b IS NOT NULL")
    shared = dense.select("value", "node").unionAll(pairs.select("value", F.col("a").alias("node"))).unionAll(pairs.select("value", F.col("b").alias("node")))
    rest = alike(pair_links(pairs, together, first, least), docs, first, words, least)
    rest = rest.unionAll(blocks.links(mixed(_known(dense, together)), docs, first, words, least, shared=shared))
    roots = components(links.unionAll(rest))
    named = _named(first, roots)
    return prints.select("doc_id", "text_key", "node").join(named, "node").select("doc_id", "text_key", "node", "component_id", "kept_node")


def _known(rows: DataFrame, together: DataFrame | None) -> DataFrame:
    """rows (node and more) with known: what names the nodes that the node is known to be together with. together: None before any links."""
    if together is None:
        return rows.withColumn("known", F.col("node"))
    return rows.join(together, "node", "left").withColumn("known", F.coalesce("root", "node")).drop("root")


def _named(first: DataFrame, roots: DataFrame) -> DataFrame:
    """node, component_id, kept_node: the least first_id of the nodes of one root, and its node."""
    member = first.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_id")
    least = member.groupBy("root").agg(F.min(F.struct("first_id", "node")).alias("kept"))
    return member.join(least, "root").select("node", F.col("kept.first_id").alias("component_id"), F.col("kept.node").alias("kept_node"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by 4-word shingles and up to 4 differing bits."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
