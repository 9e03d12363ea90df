"""The prefix trie of conversations: turn arrays sorted over all partitions, swept with a stack, and stitched at the borders.

A turn is 16 bytes, the digest of its role and text, so arrays stay small and sort in any order in which equal turns are equal.
Conversations are range-sorted by (turns, id) over the whole cluster: equal ones can't overfill a partition, as ids part them. A
sweep of a partition keeps the open nodes, the prefixes of the row before; the common prefix with the next row says which of
them close. A node that is neither a prefix of the partition's first row nor of its last lies in it whole and is returned
as a result; the others, a path at each border, are returned as parts. One task then sweeps these parts of all partitions in
order with the same stack. It holds one path, and reads a path a border: rows by partitions and depth, not by conversations.

A child is closed before its parent's least id is known. It waits, WAITING rows at most at a time; children that can't wait, or
whose parent is a border node, keep the parent's place and get its id by a join.

Defined cases: a null turn comes first, turns of one number follow by role and then by digest; null roles and texts are empty;
rows without a conversation id belong to none; repeated rows are turns of their own; an empty table has no node. A conversation's
turns are one row, 20 bytes a turn. The digest of ids is sequential by nature: a node's ids at borders are read by one task, as
strings of at most CHUNK ids, and are never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import common, sql

#: A conversation takes its first turns (fewer than HEADS) from the one at the start of its block of BLOCK ids.
BLOCK, HEADS = 20, 4
#: Rows that wait for their parent in a task, and ids of a string.
WAITING, CHUNK = 50_000, 50_000
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
#: What a row is: a node; a node whose parent's id is that of the node at (part_at, parent); the id of the node at (part_at, number); a border
#: node's part; ids that end at a border node. Parts of one partition are ordered by (stage, seq): first row's path, its ids, last row's path, its ids.
WHOLE, LACKS, NAMES, PART, IDS = range(5)
_SCHEMA = pa.schema(
    [("kind", pa.int8()), ("part_at", pa.int32()), ("number", pa.int64()), ("parent", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
     ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("stage", pa.int8()), ("seq", pa.int64()), ("key", pa.binary()), ("words", pa.int64()), ("ids", pa.string())]
)
_DDL = "kind tinyint, part_at int, number long, parent long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, stage tinyint, seq long, key binary, words long, ids string"


def turn_arrays(rows: DataFrame) -> DataFrame:
    """conv_id, turns (key, words of each) of rows (conv_id, turn, role, text), in order of turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    n = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("int")
    own = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), key.alias("key"), n.alias("words")).alias("t"))
    block = own.withColumn("block", first_of_block("conv_id")).repartition("block")  # a block's conversations meet once, for their arrays and for their heads
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words")))
    return block.groupBy("block", "conv_id").agg(ordered.alias("turns"))


def first_of_block(conv_id: str) -> Column:
    return F.col(conv_id) - F.col(conv_id) % BLOCK


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id, keys, words: of each conversation the first h turns of its block's first one, then its own after h; h is the id's hash mod HEADS."""
    arrays = turn_arrays(rows)
    heads = arrays.where("conv_id = block").select("block", F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    none = F.array().cast("array<struct<key:binary,words:int>>")
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))))
    return arrays.join(heads, "block", "left").select("conv_id", turns.alias("turns")).select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.words").alias("words"))


class Node:
    """An open node: what its members and the closed nodes under it come to so far."""

    __slots__ = ("number", "depth", "key", "words", "left", "conv_id", "n_convs", "n_children", "n_leaves", "saved", "hash", "begun", "ended", "ids", "waiting", "flushed", "places")

    def __init__(self, number: int, depth: int, key: bytes, words: int, left: bool = False):
        self.number, self.depth, self.key, self.words, self.left = number, depth, key, words, left
        self.conv_id: int | None = None
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.ids: list[str] = []  # of members that end here, before they are hashed
        self.hash, self.begun = hashlib.sha256(), False
        self.ended: str | None = None  # the digest, where a part came with it
        self.waiting: list[Node] = []  # children that lack this node's id
        self.flushed = False
        self.places: list[tuple[int, int]] = []  # (partition, number) of its parts

    def met(self, conv_id: int, n: int) -> None:
        self.n_convs += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)

    def digest(self, ids: str) -> None:
        self.hash.update(b"," * self.begun + ids.encode())
        self.begun = True

    def totals(self) -> tuple[int, int]:
        """Leaves and tokens of the subtree, the node's own included."""
        return self.n_leaves or 1, self.saved + (self.n_convs - 1) * self.words

    def gains(self, n_children: int, n_leaves: int, saved: int) -> None:
        self.n_children, self.n_leaves, self.saved = self.n_children + n_children, self.n_leaves + n_leaves, self.saved + saved

    def row(self, kind: int, part_at: int, parent: int | None, parent_conv_id: int | None) -> tuple:
        leaves, saved = self.totals()
        return (kind, part_at, self.number, parent, self.conv_id, self.depth, parent_conv_id, self.n_convs, self.n_children, leaves, saved, self.ended or self.hash.hexdigest(), None, None, None, None, None)


class Stack:
    """Open nodes from the root on, and the rows of what has closed."""

    def __init__(self, part_at: int, waiting: int = WAITING):
        self.part_at, self.most, self.held, self.numbers = part_at, waiting, 0, 0
        self.open: list[Node] = []
        self.out: list[tuple] = []

    def push(self, key: bytes, words: int, left: bool = False) -> Node:
        node = Node(self.numbers, len(self.open), key, words, left)
        self.numbers += 1
        self.open.append(node)
        return node

    def close(self, node: Node) -> None:
        """A node that is whole: its children get its id, and it waits for its parent's."""
        self.out.extend(child.row(WHOLE, self.part_at, None, node.conv_id) for child in node.waiting)
        self.held -= len(node.waiting)
        node.waiting = []
        for at, number in [*node.places, *([(self.part_at, node.number)] if node.flushed else [])]:
            self.out.append((NAMES, at, number, None, node.conv_id, *[None] * 12))
        if not self.open:
            self.out.append(node.row(WHOLE, self.part_at, None, None))
            return
        self.open[-1].gains(1, *node.totals())
        self.open[-1].waiting.append(node)
        self.held += 1
        if self.held > self.most:
            for parent in self.open:
                self.flush(parent)

    def flush(self, parent: Node) -> None:
        """Children that can't wait keep their parent's place."""
        if parent.waiting:
            self.out.extend(child.row(LACKS, self.part_at, parent.number, None) for child in parent.waiting)
            self.held -= len(parent.waiting)
            parent.waiting, parent.flushed = [], True


class Sweep(Stack):
    """One partition's rows in order."""

    def __init__(self, part_at: int, waiting: int = WAITING, chunk: int = CHUNK):
        super().__init__(part_at, waiting)
        self.border: list[Node] = []  # closed ones that are prefixes of the first row, the deepest first
        self.chunk, self.chunks = chunk, 0

    def row(self, keys: list[bytes], words: list[int], conv_id: int) -> None:
        first = not self.open
        if first:
            self.push(b"", 0, True)
        same = 0
        while same < len(keys) and same + 1 < len(self.open) and self.open[same + 1].key == keys[same]:
            same += 1
        if same < len(keys):
            self.settle(self.open[-1], False)
        while len(self.open) > same + 1:
            self.pop()
        for k in range(same, len(keys)):
            self.push(keys[k], words[k], first)
        for node in self.open:
            node.met(conv_id, 1)
        end = self.open[-1]
        end.ids.append(str(conv_id))
        if len(end.ids) >= self.chunk:
            self.settle(end, True)

    def settle(self, node: Node, as_row: bool) -> None:
        """Ids are hashed where the node has all that end at it. The first row's node may have more in partitions before, and
        the last row's in partitions after: theirs go on as rows. What turns out not to be the last row's is in both."""
        if not node.ids:
            return
        ids = ",".join(node.ids)
        if node.left or as_row:
            self.out.append((IDS, self.part_at, node.number, *[None] * 9, 1 if node.left else 3, self.chunks, None, None, ids))
            self.chunks += 1
        if not node.left:
            node.digest(ids)
        node.ids = []

    def pop(self) -> None:
        node = self.open.pop()
        if node.left:
            self.flush(node)
            self.border.append(node)
        else:
            self.close(node)

    def finish(self) -> None:
        """Parts of the nodes on both borders' paths."""
        if not self.open:
            return
        last = self.open[-1]
        self.settle(last, True)
        for node in self.open:
            self.flush(node)
        left = [n for n in self.open if n.left] + self.border[::-1]
        for stage, nodes in ((0, left), (2, [n for n in self.open if not n.left])):
            for n in nodes:
                digest = None if n.left or n is last else n.hash.hexdigest()
                self.out.append((PART, self.part_at, n.number, None, n.conv_id, n.depth, None, n.n_convs, n.n_children, n.n_leaves, n.saved, digest, stage, n.depth, n.key, n.words, None))


class Stitch(Stack):
    """Parts of all partitions in order: the first row's path goes on with what the partition before has left open."""

    def part(self, r: dict) -> None:
        if r["kind"] == IDS:
            if r["stage"] == 1 or (r["part_at"], r["number"]) == self.open[-1].places[-1]:
                self.open[-1].digest(r["ids"])
            return
        d = r["depth"]
        if r["stage"] == 2 or len(self.open) <= d or self.open[d].key != r["key"]:
            self.down_to(d)
            self.push(r["key"], r["words"])
        node = self.open[d]
        node.met(r["conv_id"], r["n_convs"])
        node.gains(r["n_children"], r["n_leaves"], r["saved_tokens"])
        node.ended = node.ended or r["ends_sha256"]
        node.places.append((r["part_at"], r["number"]))

    def down_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.close(self.open.pop())


def batches_of(stack: Stack, last: bool) -> Iterator[pa.RecordBatch]:
    """What the stack has put out, as soon as it fills a batch."""
    while stack.out and (last or len(stack.out) >= common.BATCH_ROWS):
        rows, stack.out = stack.out[: common.BATCH_ROWS * 8], stack.out[common.BATCH_ROWS * 8 :]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def trie(arrays: DataFrame, waiting: int = WAITING, chunk: int = CHUNK) -> DataFrame:
    """The columns of NODE for every distinct prefix of arrays (conv_id, keys, words)."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sweep(TaskContext.get().partitionId(), waiting, chunk)
        for b in batches:
            for conv_id, keys, words in zip(b.column("conv_id").to_pylist(), b.column("keys").to_pylist(), b.column("words").to_pylist(), strict=True):
                own.row(keys, words, conv_id)
            yield from batches_of(own, False)
        own.finish()
        yield from batches_of(own, True)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Stitch(-1, waiting)
        for b in batches:
            for r in b.to_pylist():
                own.part(r)
            yield from batches_of(own, False)
        own.down_to(0)
        yield from batches_of(own, True)

    ordered = arrays.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    swept = common.staged(ordered.mapInArrow(sweep, _DDL), "kind")
    parts = swept.where(F.col("kind").isin(PART, IDS)).select(_SCHEMA.names).coalesce(1).sortWithinPartitions("part_at", "stage", "seq")
    stitched = common.staged(parts.mapInArrow(stitch, _DDL), "kind")
    every = swept.unionByName(stitched)
    named = every.where(F.col("kind") == NAMES).select("part_at", F.col("number").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    lacking = every.where(F.col("kind") == LACKS).drop("parent_conv_id").join(named, ["part_at", "parent"])
    return every.where(F.col("kind") == WHOLE).select(*NODE).unionByName(lacking.select(*NODE))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(rebuilt(common.table(spark, sf_dir, "conversations")))


_KEY = "md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
#: Prefixes as lists of turns; subtrees by joining each node with the prefixes of its own.
ORACLE_SQL = f"""WITH {sql.CRC_TABLE},
own AS (SELECT conv_id AS c, {_KEY} AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), {_KEY}) AS pos FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, {sql.crc32("CAST(c AS VARCHAR)")} % {HEADS} AS h FROM (SELECT DISTINCT c FROM own), crc),
turn AS (SELECT i.c, o.k, o.w, 0 AS part, o.pos FROM ids i JOIN own o ON o.c = i.c - i.c % {BLOCK} AND o.pos <= i.h UNION ALL SELECT i.c, o.k, o.w, 1, o.pos FROM ids i JOIN own o ON o.c = i.c AND o.pos > i.h),
path AS (SELECT i.c, coalesce(list(t.k ORDER BY t.part, t.pos) FILTER (t.k IS NOT NULL), []) AS p, coalesce(list(t.w ORDER BY t.part, t.pos) FILTER (t.k IS NOT NULL), []) AS w FROM ids i LEFT JOIN turn t USING (c) GROUP BY i.c),
prefix AS (SELECT c, p[1:d] AS p, d, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, d = len(p) AS ends FROM (SELECT c, p, w, unnest(range(len(p) + 1)) AS d FROM path)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, max(w) AS w, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS e FROM prefix GROUP BY p, d),
child AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
counted AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (p)),
under AS (SELECT p[1:pos] AS p, sum((n - 1) * w)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT p, n, w, n_children, unnest(range(d + 1)) AS pos FROM counted) GROUP BY ALL)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, u.n_leaves, u.saved_tokens, sha256(x.e) AS ends_sha256
FROM counted x LEFT JOIN node y ON x.d > 0 AND y.p = x.p[1:x.d - 1] JOIN under u ON u.p = x.p"""
