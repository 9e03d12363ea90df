"""Near duplicates by SetSketch registers: exponentially spaced truncated minima of a text's shingle set.

Register i holds floor(1 - log_b x) for the least x that an exponential hash i gives a shingle, cut to 16 bits. Registers of a
union are the greater of each two, and those of similar sets are mostly equal, so runs of them (bands) are where similar texts
meet. With BANDS bands of WIDTH registers two sets of the least similarity 0.85 miss all bands once in 10^8. Of what meets,
similarity is estimated by maximum likelihood from the registers that are greater, less and equal together with both sizes, and a
pair goes on unless the least similarity is exp(-DOUBT) times less likely; then whole sets decide.

Equal sets are one node. In each bucket nodes are first compared with one of them, in TURNS turns with another one each; what then
isn't known to be together is compared in pairs in buckets of few nodes, and in blocks that return spanning forests in others.

Defined cases: a null or empty text, or one without words, has no shingles and links with nothing; a text of fewer words than a
shingle has one; repeated rows and ties share a node; the smallest id names the component, null only where no row has an id; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import blocks, common, simhash, sql
from lexarium.llm.sets import node_of, shingle_set

#: Words of a shingle, the least similarity.
WORDS, LEAST = 3, 0.85
#: Bands and registers of a band; base, rate and greatest value of a register.
BANDS, WIDTH = 32, 5
BASE, RATE, MOST = 1.001, 20.0, 65535
#: Differences of log-likelihood that decide before whole sets do; similarities at which it is taken.
DOUBT = 20.0
GRID = np.concatenate([np.linspace(0.0, 0.84, 43), np.linspace(0.85, 1.0, 31)])
#: Turns of comparing with one node of a bucket, and nodes from which a bucket is compared in blocks.
TURNS, DENSE = 2, 16
_DRAW = np.random.default_rng(12)
_FACTORS = (_DRAW.integers(1 << 62, 1 << 63, (BANDS * WIDTH, 1), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_MIX = (_DRAW.integers(1 << 62, 1 << 63, (BANDS, WIDTH), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Of a set of 64-bit hashes. merged() of two sets' registers are those of their union."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[None, k : k + 2048] * _FACTORS).min(1))
    x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-12)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, MOST).astype(np.uint16) if len(shingles) else np.zeros(len(_FACTORS), np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(a, b)


def bands(of: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band's registers and number."""
    h = (of.reshape(-1, BANDS, WIDTH).astype(np.uint64) * _MIX).sum(2, dtype=np.uint64) + _MIX[:, 0] * np.arange(1, BANDS + 1, dtype=np.uint64)
    return h ^ (h >> np.uint64(29))


def log_likelihood(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """By pair and similarity of GRID, from registers a, b (a row a pair) of sets of n and m; -inf where the sizes don't allow it."""
    p = lambda x: -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)
    u, v = (n / (n + m))[:, None], (m / (n + m))[:, None]
    more, less = u - v * GRID, v - u * GRID
    allowed = (more > -1e-9) & (less > -1e-9)
    up, down = p(np.maximum(more, 0)), p(np.maximum(less, 0))
    same = np.maximum(1 - up - down, 1e-12)
    count = [x.sum(1)[:, None] for x in (a > b, a < b, a == b)]
    log = lambda k, q: np.where(k > 0, k * np.log(np.maximum(q, 1e-12)), 0.0)
    return np.where(allowed, log(count[0], up) + log(count[1], down) + log(count[2], same), -np.inf)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, node (hash of the shingle set), n (its size), registers of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column("text").to_pylist()]
            node = np.array([node_of(s) for s in sets], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array([registers(s).tobytes() for s in sets], pa.binary())], ["doc_id", "node", "n", "registers"])

    return common.documents(docs).mapInArrow(run, "doc_id long, node long, n long, registers binary")


def banded(nodes: DataFrame) -> DataFrame:
    """value, node, n: a row for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = bands(_rows_of(b.column("registers"))).view(np.int64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(value), *(pa.array(np.repeat(b.column(c).to_numpy(), BANDS)) for c in ("node", "n"))], ["value", "node", "n"])

    return nodes.select("node", "n", "registers").mapInArrow(run, "value long, node long, n long")


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), len(_FACTORS))


def plausible(pairs: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of pairs (value, a, n, b, m) whose registers don't speak against the least similarity, with the likeliest one as estimate."""
    for c in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("registers").alias(f"{c}_registers")), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = log_likelihood(_rows_of(b.column("a_registers")), _rows_of(b.column("b_registers")), b.column("n").to_numpy(), b.column("m").to_numpy())
            may = found[:, GRID >= least - 1e-9].max(1) >= found.max(1) - DOUBT
            rest = b.select(["value", "a", "n", "b", "m"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(GRID[found.argmax(1)])], [*rest.schema.names, "estimate"]).filter(pa.array(may & np.isfinite(found.max(1))))

    return pairs.select("value", "a", "n", "b", "m", "a_registers", "b_registers").mapInArrow(run, "value long, a long, n long, b long, m long, estimate double")


def _fits(least: float) -> Column:
    return F.least("n", "m") >= F.ceil(F.greatest("n", "m") * least - 1e-9)


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs, each with one value: value, a, n, b, m."""
    return rows.groupBy("a", "b").agg(F.min("value").alias("value"), F.first("n").alias("n"), F.first("m").alias("m")).select("value", "a", "n", "b", "m")


def _mixed(rows: DataFrame) -> DataFrame:
    """rows (value, node, n, known) of the buckets whose nodes aren't all known to be together, with the bucket's rows."""
    buckets = rows.groupBy("value").agg(F.count("*").alias("rows"), F.min("known").alias("x"), F.max("known").alias("y")).where("x <> y")
    return rows.join(buckets.select("value", "rows"), "value")


def star_pairs(rows: DataFrame, least: float, turn: int) -> DataFrame:
    """Each node of a mixed bucket with one of them, another in each turn. rows: value, node, n, known."""
    pivots = rows.groupBy("value").agg(F.min("known").alias("x"), F.max("known").alias("y"), F.min_by(F.struct("node", "n", "known"), F.xxhash64("node", F.lit(turn))).alias("p")).where("x <> y")
    out = rows.join(pivots.select("value", F.col("p.node").alias("b"), F.col("p.n").alias("m"), F.col("p.known").alias("b_known")), "value").where((F.col("known") != F.col("b_known")) & _fits(least))
    return _pairs(out.select("value", F.col("node").alias("a"), "n", "b", "m"))


def classes(docs: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: links are of the least Jaccard similarity, decided by whole sets."""
    prints = common.staged(sketches(docs, words))
    nodes = common.staged(prints.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("registers").alias("registers")))
    rows = banded(nodes)
    shared = common.staged(rows.join(rows.groupBy("value").agg(F.count("*").alias("rows")).where("rows > 1").select("value"), "value"))
    links, together = None, None
    for turn in range(TURNS):
        found = common.staged(simhash.alike(plausible(star_pairs(simhash._known(shared, together), least, turn), nodes, least).drop("estimate"), docs, nodes, words, least))
        links = found if links is None else links.unionAll(found)
        together = common.staged(simhash.components(links))
    left = common.staged(_mixed(simhash._known(shared, together)))
    few = left.where(F.col("rows") < DENSE)
    other = few.select("value", F.col("node").alias("b"), F.col("n").alias("m"), F.col("known").alias("b_known"))
    pairs = few.join(other, "value").where((F.col("node") > F.col("b")) & (F.col("known") != F.col("b_known")) & _fits(least))
    pairs = _pairs(pairs.select("value", F.col("node").alias("a"), "n", "b", "m"))
    rest = simhash.alike(plausible(pairs, nodes, least).drop("estimate"), docs, nodes, words, least)
    dense = blocks.links(left.where(F.col("rows") >= DENSE).drop("rows"), docs, nodes, words, least, joined=False)
    roots = simhash.components(links.unionAll(rest).unionAll(dense))
    named = simhash._named(nodes, roots).select("node", "component_id")
    return prints.join(named, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by 3-word shingle sets and a similarity of 0.85 or more."""
    found = classes(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: All pairs by their shared shingles; components by recursion over links.
ORACLE_SQL = f"""WITH RECURSIVE
words AS (SELECT doc_id, regexp_extract_all({sql.LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM met JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other),
named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN named c USING (doc_id)"""
