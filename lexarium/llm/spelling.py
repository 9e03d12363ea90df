"""Spelling variants: words that differ by one code point, by a self-join of a trie that is cut into parts by prefix.

Words are counted in the texts; the vocabulary is then cut at prefixes so that no part has many rows. A part holds the words
under its prefix, which form a trie, and guests: words that come under the prefix once a code point of theirs before its end is
left out. In trie terms the guests' nodes are active at distance one where the part begins, so they only go on by equal code
points. Within a part active nodes are propagated level by level: a node is active for itself at distance zero; two children of
one node are active for each other at distance one (a replaced code point), a child and its own parent too (an inserted
one); from there both sides descend by equal code points, and what is terminal on both sides is a pair. Each pair of near words
is met in exactly one part, once: by the place where the words part. Parts return counts and the best partner by word, not pairs.

Defined cases: a null text has no words, a null id is an empty one; repeated rows count as often as they stand; of near words
with the same count the smallest in code-point order is the form; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import common, sql

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words count from so many code points and occurrences; a form has so many times the occurrences; runs whose hash this divides lose a code point.
LENGTH, LEAST, TIMES, SLIP = 6, 5, 5, 199
#: Rows of a part from which it is cut further (or a share of all rows, so that cuts stay few), and words a task counts at once.
ROWS, CUTS, HELD = 512, 20_000, 200_000
_LABEL = 21  # bits of a code point
_NONE = np.zeros(0, dtype=np.int64)


def slipped(run: str, before: int) -> str:
    """The run, or without one code point where its hash (begun by that of its document's id) says so."""
    h = zlib.crc32(run.encode(), before)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """word, n of the words of least length and occurrences. A task sums what it has met, HELD words at a time, before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                before = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for w, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # bytes: only A-Z are lowered
                    if len(w) >= length and len(w := slipped(w, before)) >= length:
                        held[w] += n
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    return common.documents(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def ladder() -> Iterator[int]:
    """Lengths of prefixes at which parts may be cut."""
    at = 2
    while True:
        yield at
        at += max(1, at // 2)


def without(word: str, at: int) -> str:
    return word[:at] + word[at + 1 :]


def cuts(vocabulary: DataFrame, rows: int = ROWS) -> list[set[str]]:
    """Of each length of the ladder the prefixes of too many rows. By the number of rows of a part that is too many, a length has CUTS at most."""
    out: list[set[str]] = []
    spark, n = vocabulary.sparkSession, vocabulary.count()
    for size in ladder():
        place = F.sequence(F.lit(1), F.least(F.lit(size), F.length("word")))
        ways = F.transform(place, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.lit(size + 1) - i)))
        prefix = vocabulary.select(F.explode(F.array_append(ways, F.substring("word", 1, size))).alias("prefix"))
        if out:  # only what lies under a cut of the length before
            above = F.broadcast(spark.createDataFrame([(p,) for p in sorted(out[-1])], "above string"))
            prefix = prefix.join(above, F.substring("prefix", 1, len(next(iter(out[-1])))) == F.col("above"), "left_semi")
        most = max(rows, n * (size + 1) // CUTS)
        found = {r.prefix for r in prefix.where(F.length("prefix") == size).groupBy("prefix").count().where(F.col("count") > most).collect()}
        if not found:
            return out
        out.append(found)
    return out


def part_of(word: str, cut: list[set[str]]) -> str:
    """The prefix of the part that the word belongs to."""
    for size, many in zip(ladder(), [*cut, set()], strict=False):
        if word[:size] not in many:
            return word[:size]
    raise AssertionError("the last length has no cuts")


def parted(vocabulary: DataFrame, cut: list[set[str]]) -> DataFrame:
    """part, at (of the code point left out; -1: the word itself), rest (what follows the part's prefix), last (it differs from the next code point), word, n."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                own = part_of(word, sent.value)
                out.append((own, -1, word[len(own) :], False, word, n))
                for i in range(len(word)):
                    less = without(word, i)
                    to = part_of(less, sent.value)
                    if i >= len(to) and to == own:
                        break  # from here on both words lie in this part
                    out.append((to, i, less[len(to) :], word[i : i + 1] != word[i + 1 : i + 2], word, n))
            if not out:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int64()), strict=True)], ["part", "at", "rest", "last", "word", "n"])

    return vocabulary.mapInArrow(run, "part string, at int, rest string, last boolean, word string, n long")


class Level:
    """The nodes of one depth: by node its parent, label (code point) and terminal word (-1: none), sorted by parent and label."""

    def __init__(self, parent: np.ndarray, label: np.ndarray, word: np.ndarray):
        self.parent, self.label, self.word = parent, label, word
        self.key = (parent << _LABEL) | label

    def children(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in of, node) of every node here whose parent is in of."""
        a, b = np.searchsorted(self.parent, of, "left"), np.searchsorted(self.parent, of, "right")
        n = b - a
        place = np.repeat(np.arange(len(of)), n)
        return place, np.repeat(a - np.cumsum(n) + n, n) + np.arange(len(place))

    def find(self, parent: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child of each parent by that label, -1 where there is none."""
        if not len(self.key):
            return np.full(len(parent), -1)
        key = (parent << _LABEL) | label
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, at, -1)


def self_join(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in words, which are distinct and in order) at distance one: active nodes propagated down the words' trie."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    start = np.cumsum(size) - size
    code = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    alive, node = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
    level = Level(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([0 if len(words) and not size[0] else -1]))
    same = (_NONE, _NONE)  # active pairs of one depth
    more = (_NONE, _NONE, _NONE)  # (node, active node one level higher, label by which they may not go on, or -1)
    left, right = [], []

    def met(x: np.ndarray, y: np.ndarray) -> None:
        both = (x >= 0) & (y >= 0)
        left.append(x[both])
        right.append(y[both])

    depth = 0
    while True:
        on = size[alive] > depth
        alive, parent = alive[on], node[on]
        alone = len(alive) < 2 or (np.diff(parent) != 0).all()
        if not len(alive) or (alone and not len(same[0]) and not len(more[0]) and (level.word[parent] < 0).all()):
            break  # words that are alone in their nodes meet nothing further down
        label = code[start[alive] + depth]
        new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (label[1:] != label[:-1])])
        node, first = np.cumsum(new) - 1, np.flatnonzero(new)
        below = Level(parent[first], label[first], np.where(size[alive[first]] == depth + 1, alive[first], -1))
        # what was active goes on by equal labels
        place, x = below.children(same[0])
        y = below.find(same[1][place], below.label[x])
        x, y = x[y >= 0], y[y >= 0]
        place, u = below.children(more[0])
        v = level.find(more[1][place], below.label[u])
        goes = (v >= 0) & (below.label[u] != more[2][place])
        u, v = u[goes], v[goes]
        # each node's children: by each other's side, and by the node's own
        n = np.bincount(below.parent, minlength=len(level.word))
        place, sib = below.children(below.parent)
        other = place < sib
        first_of, second = place[other], sib[other]
        fresh = np.flatnonzero((n[below.parent] > 1) | (level.word[below.parent] >= 0))
        same = (np.concatenate([x, first_of]), np.concatenate([y, second]))
        more = (np.concatenate([u, fresh]), np.concatenate([v, below.parent[fresh]]), np.concatenate([np.full(len(u), -1), below.label[fresh]]))
        met(below.word[same[0]], below.word[same[1]])
        met(below.word[more[0]], level.word[more[1]])
        level, depth = below, depth + 1
    return np.concatenate([*left, _NONE]), np.concatenate([*right, _NONE])


def met_in_part(t: pa.Table) -> pa.Table:
    """word, n_near, best (the near word of most occurrences), best_n of a part's words that have near words in it."""
    at, rest, last = t.column("at").to_pylist(), t.column("rest").to_pylist(), t.column("last").to_pylist()
    own, count = t.column("word").to_pylist(), dict(zip(t.column("word").to_pylist(), t.column("n").to_pylist(), strict=True))
    inside = sorted((r, w) for k, r, w in zip(at, rest, own, strict=True) if k < 0)
    x, y = self_join([r for r, _ in inside])
    pairs = [(inside[a][1], inside[b][1]) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    named, guests = dict(inside), defaultdict(list)
    for k, r, z, w in zip(at, rest, last, own, strict=True):
        if k >= 0:
            guests[k, r].append(w)
            if z and r in named:
                pairs.append((w, named[r]))
    found: dict[str, tuple[int, int, str]] = {}

    def add(w: str, other: str) -> None:
        n, best_n, best = found.get(w, (0, 0, ""))
        if count[other] > best_n or (count[other] == best_n and other < best):
            best_n, best = count[other], other
        found[w] = (n + 1, best_n, best)

    for a, b in pairs:
        add(a, b)
        add(b, a)
    for group in guests.values():  # they differ in the one code point that each has left out
        for a, b in permutations(group, 2):
            add(a, b)
    n, best_n, best = zip(*found.values(), strict=True) if found else ((), (), ())
    return pa.table([pa.array(found.keys(), pa.string()), pa.array(n, pa.int64()), pa.array(best, pa.string()), pa.array(best_n, pa.int64())], names=["word", "n_near", "best", "best_n"])


def near_words(vocabulary: DataFrame, rows: int = ROWS) -> DataFrame:
    """word, n_near, best, best_n of the words that have near words: sums and bests of all parts."""
    rows_of = parted(vocabulary, cuts(vocabulary, rows))
    found = rows_of.groupBy("part").applyInArrow(met_in_part, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best", (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form (word, form): forms followed to the last. Occurrences grow TIMES with each, so there are few; each turn doubles the way."""
    now = common.staged(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = common.staged(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if then.where("moved").isEmpty():
            return then.select("word", "root")
        now = then.select("word", "root")


def variants(docs: DataFrame, length: int = LENGTH, least: int = LEAST, times: int = TIMES, rows: int = ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text)."""
    vocabulary = common.staged(words(docs, length, least))
    near = common.staged(near_words(vocabulary, rows))
    has = F.col("best_n") >= times * F.col("n")
    out = vocabulary.join(near, "word", "left").select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best_n")).alias("form_n"))
    out = common.staged(out)
    return out.join(roots(out.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of documents with its form and the last of its forms."""
    return variants(common.table(spark, sf_dir, "documents"))


#: Pairs are met by what is left without a code point; forms are followed by recursion.
ORACLE_SQL = f"""WITH RECURSIVE {sql.CRC_TABLE},
runs AS (SELECT id, run, count(*) AS k FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({sql.LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
 WHERE length(run) >= {LENGTH} GROUP BY ALL),
hashed AS (SELECT run, k, {sql.crc32("id || ':' || run")} AS h FROM runs, crc),
kept AS (SELECT CASE WHEN h % {SLIP} = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed),
vocabulary AS (SELECT word, sum(k)::BIGINT AS n FROM kept WHERE length(word) >= {LENGTH} GROUP BY word HAVING sum(k) >= {LEAST}),
ways AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM ways a JOIN ways b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM ways a JOIN vocabulary b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM ways a JOIN vocabulary b ON a.less = b.word),
near AS (SELECT word, count(*) AS n_near, min({{'less': -other_n, 'w': other}}) AS b FROM pairs GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {TIMES} * v.n THEN b.w END AS form, CASE WHEN -b.less >= {TIMES} * v.n THEN -b.less END AS form_n
 FROM vocabulary v LEFT JOIN near USING (word)),
follow AS (SELECT word, word AS last, form AS further FROM forms UNION ALL SELECT f.word, f.further, g.form FROM follow f JOIN forms g ON f.further = g.word)
SELECT f.word, f.form, r.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN follow r ON f.word = r.word WHERE r.further IS NULL"""
