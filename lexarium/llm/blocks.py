"""Links inside groups of many similar texts: whole sets are compared in blocks, and only a spanning forest comes out.

Buckets of one text family hold nearly the same nodes again and again: those whose node of the least hash is the same can be one
group (a larger one), so that a text is sent once for all of them. A group is dealt to blocks by hash, so that no task holds more than ROWS nodes
or WEIGHT shingles a side; each two blocks meet in a group of their own. The shingles that two nodes or more of a meeting share are numbered, each node's
become bits, and intersections of all pairs are counted by words of 64 bits. No pair is put out but those that join nodes not
known to be together yet: fewer than there are nodes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarium.llm import common
from lexarium.llm.sets import node_of, shingle_set, texts_of

#: Nodes and shingles of a block; bytes of an intermediate product, rows of one side that are looked at together, and shingles that are bits at a time.
ROWS, WEIGHT, PRODUCT, STEP, COLUMNS = 2048, 1_000_000, 8 << 20, 128, 8192


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each set of left (places in sets) shares with each of right. Elements that two sets or more hold become
    bits, COLUMNS at a time, so that what is held beside the sets and the counts doesn't grow with their sizes."""
    out = np.zeros((len(left), len(right)), dtype=np.int32)
    held, of, n = np.unique(np.concatenate([*sets, np.zeros(0, sets[0].dtype if sets else np.uint64)]), return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1).astype(np.int32)[of]
    del held, of
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [start, start + COLUMNS]).tolist()
        width = -(-min(COLUMNS, total - start) // 64) * 64
        some = np.zeros((len(sets), width), dtype=bool)
        some[row[a:b], column[a:b] - start] = True
        bits = np.packbits(some, axis=1).view(np.uint64)
        del some
        mine, others = np.flatnonzero(bits[left].any(1)), np.flatnonzero(bits[right].any(1))
        theirs = bits[right[others]]
        step = max(1, PRODUCT // max(1, theirs.nbytes))
        for k in range(0, len(mine), step):
            at = mine[k : k + step]
            out[at[:, None], others] += np.bitwise_count(bits[left[at]][:, None, :] & theirs[None, :, :]).sum(2, dtype=np.int32)
    return out


def forest(sets: list[np.ndarray], known: list, left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links (places in sets) between left and right that join what isn't known to be together, fewer than there are sets."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    both, size = overlaps(sets, left, right), np.array([len(s) for s in sets], dtype=np.int64)
    group = np.unique(np.array(known), return_inverse=True)[1]
    out = []
    for k in range(0, len(left), STEP):
        a = left[k : k + STEP]
        shared = both[k : k + STEP]
        either = size[a][:, None] + size[right][None, :] - shared
        near = (shared / np.maximum(either, 1) >= least) & (group[a][:, None] != group[right][None, :])
        for i, j in np.argwhere(near).tolist():
            x, y = int(a[i]), int(right[j])
            ru, rv = root(known[x]), root(known[y])
            if ru != rv:
                parent[ru] = rv
                out.append((x, y))
    return out


def plausible(numbers: list[np.ndarray], size: np.ndarray, last: np.ndarray, known: list, left: np.ndarray, right: np.ndarray, least: float, before: list[np.ndarray] | None = None) -> np.ndarray:
    """Places of the sets that may have a link between left and right, by what their prefixes share: of two prefixes the one that ends
    first has all of its shared shingles in the other, and what the sets may share beyond is that set less its prefix. numbers: those of
    each prefix that other sets hold too; last: the greatest of the whole prefix; before: the groups ahead of this one that each set is
    in; a pair that meets in one of them is left to it."""
    both, group = overlaps(numbers, left, right), np.unique(np.array(known), return_inverse=True)[1]
    ahead = overlaps(before, left, right) > 0 if before is not None else None
    beyond = np.ceil(size * least - 1e-9).astype(np.int64) - 1  # the set less its prefix
    found = np.zeros(len(numbers), dtype=bool)
    for k in range(0, len(left), STEP):
        a = left[k : k + STEP][:, None]
        b = right[None, :]
        shared = both[k : k + STEP]
        reach = np.where(last[a] < last[b], beyond[a], np.where(last[a] > last[b], beyond[b], np.maximum(beyond[a], beyond[b])))
        need = np.ceil((size[a] + size[b]) * (least / (1 + least)) - 1e-9)
        may = (shared > 0) & (shared + reach >= need) & (np.minimum(size[a], size[b]) >= np.ceil(np.maximum(size[a], size[b]) * least - 1e-9)) & (group[a] != group[b])
        if ahead is not None:
            may &= ~ahead[k : k + STEP]
        found[a[may.any(1), 0]] = True
        found[right[may.any(0)]] = True
    return np.flatnonzero(found)


def links(rows: DataFrame, docs: DataFrame, first: DataFrame, words: int, least: float, joined: bool = True, shared: DataFrame | None = None) -> DataFrame:
    """a, b: links of the least similarity that join the nodes of each bucket. rows: value (the bucket), node, n (shingles), known;
    first: node, first_id, by which the texts are read again. shared: value, node, the numbers of prefixes (of prefix filtering) that two
    nodes or more hold, with first's last: then only texts that may have a link by their prefixes are read, each for the first group in
    which it meets the other; what no other node holds adds to no count and isn't sent. joined: buckets of one least node are one group."""
    if joined:
        groups = rows.groupBy("value").agg(F.min_by("node", F.xxhash64("node")).alias("g"))
        rows = common.staged(rows.join(groups, "value").select(F.col("g").alias("value"), "node", "n", "known").distinct())
    sized = rows.groupBy("value").agg(F.sum("n").alias("weight"), F.count("*").alias("rows"))
    blocks = F.greatest(F.ceil(F.col("weight") / WEIGHT), F.ceil(F.col("rows") / ROWS), F.lit(1))
    dealt = rows.join(sized.select("value", blocks.alias("blocks")), "value").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = dealt.select("value", "node", "n", "known", "own", every.alias("other")).select(F.col("value").alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", "known", "own")
    by = ["g", "i", "j"]
    met = met.join(first.select("node", "first_id", *(["last"] if shared is not None else [])), "node")
    if shared is not None:

        def sieve(t: pa.Table) -> pa.Table:
            own, i, j = t.column("own").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
            numbers, groups = ([x.values.to_numpy() for x in t.column(c)] for c in ("numbers", "groups"))
            g = t.column("g")[0].as_py()
            may = plausible(numbers, t.column("n").to_numpy().astype(np.int64), t.column("last").to_numpy(), t.column("known").to_pylist(), np.flatnonzero(own == i), np.flatnonzero(own == j), least, [x[x < g] for x in groups])
            return t.select([*by, "node", "known", "own", "first_id"]).take(pa.array(may))

        groups = rows.groupBy("node").agg(F.collect_set("value").alias("groups"))
        held = shared.join(rows.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.collect_set("value").alias("numbers"))
        met = met.join(groups.join(held, "node"), "node").groupBy(*by).applyInArrow(sieve, "g long, i long, j long, node long, known long, own long, first_id long")
    met = common.staged(met.drop("n", "last"))
    texts = texts_of(docs, met.select("first_id").distinct())
    held = met.join(texts, met.first_id.eqNullSafe(texts.id)).select("g", "i", "j", "node", "known", "own", "text")

    def compare(t: pa.Table) -> pa.Table:
        found: dict[int, tuple] = {}
        for node, known, own, text in zip(t.column("node").to_pylist(), t.column("known").to_pylist(), t.column("own").to_pylist(), t.column("text"), strict=True):
            if node not in found:
                s = shingle_set(text.as_py(), words)
                if node_of(s) == node & (2**64 - 1):  # an id may have other texts
                    found[node] = (s, known, own)
        nodes = list(found)
        own = np.array([found[x][2] for x in nodes], dtype=np.int64)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        edges = forest([found[x][0] for x in nodes], [found[x][1] for x in nodes], np.flatnonzero(own == i), np.flatnonzero(own == j), least)
        return pa.table([pa.array([nodes[x] for x, _ in edges], pa.int64()), pa.array([nodes[y] for _, y in edges], pa.int64())], names=["a", "b"])

    return held.groupBy(*by).applyInArrow(compare, "a long, b long")
