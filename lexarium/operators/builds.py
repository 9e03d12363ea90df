"""One build, from a tree of texts to a published snapshot: what has changed is found, indexed, embedded and published, or nothing is.

The newest manifest (segments.py) is the base and the only commit: state, chunks and the index of the changed documents lie in
its segments, vectors and audit rows in folders that it names. A build reads every text's hashes, and beyond them only what has
changed. Vectors are kept by the hash of a chunk's text, so that only texts which no chunk had before are embedded, each once.

Defined cases: without changes nothing is published; a body that breaks the heading contract fails the build; a document whose
source or title alone has changed is rendered anew without being embedded; a build that fails, or that loses to another one on the
same base, leaves nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions import text
from lexarium.operators import chunking, evaluation, segments, snapshots
from lexarium.operators.segmentation import PLAIN, Analysis
from lexarium.operators.segments import Segmented
from lexarium.sources import shared

#: How bodies are made of sources; another number makes every document new.
VERSION = 2
Embed = Callable[[list[str]], list[list[float]]]
_VECTORS = "text_hash string, embedding array<double>"


@dataclass(frozen=True)
class Build:
    index: Segmented
    published: bool
    work: dict[str, int]
    embedded: int = 0


def prepared(tree: DataFrame, titles: DataFrame | None = None, start: str = "## Body", end: str = "## Appendix") -> DataFrame:
    """doc_id, text (the cleaned body), title, source (channel), publication_date, source_hash, body_hash of tree (doc_id, raw,
    source_hash); titles (doc_id, title) come before a source's own."""
    body = F.col("body_")  # made in a row of its own: text and hash are of one
    own = tree.withColumn("body_", text.clean(text.body("raw", start, end))).select(
        "doc_id", body.alias("text"), F.nullif(text.title("raw"), F.lit("")).alias("own_title"), F.regexp_extract("doc_id", "^([^/]+)/", 1).alias("source"), text.publication_date("raw").alias("publication_date"),
        "source_hash", F.sha2(body, 256).alias("body_hash"),
    )
    listed = titles if titles is not None else tree.select("doc_id", F.lit(None).cast("string").alias("title")).limit(0)
    return own.join(listed.select("doc_id", F.col("title").alias("listed")), "doc_id", "left").withColumn("title", F.coalesce("listed", "own_title", "doc_id")).drop("listed", "own_title")


def vectors(index: Segmented) -> DataFrame:
    """text_hash, embedding of every chunk text that has been embedded."""
    at = [f"{index.root}/{name}" for name in index.extra.get("vectors", [])]
    return index.spark.read.schema(_VECTORS).parquet(*at) if at else index.spark.createDataFrame([], _VECTORS)


def chunk_vectors(index: Segmented) -> DataFrame:
    """The chunks with their vectors."""
    return index.table("chunks").join(vectors(index), "text_hash")


def audit(index: Segmented) -> DataFrame:
    """doc_id, work, build of every build."""
    at = [f"{index.root}/{name}" for name in index.extra.get("audit", [])]
    schema = "doc_id string, work string, build long"
    return index.spark.read.schema(schema).parquet(*at) if at else index.spark.createDataFrame([], schema)


def run_once(spark: SparkSession, tree: DataFrame, root: str, embed: Embed, titles: DataFrame | None = None, analysis: Analysis = PLAIN, sizes: chunking.Sizes = chunking.Sizes(), base: Segmented | None = None) -> Build:
    """A build of tree (doc_id, raw, source_hash) on the newest manifest of root, or on base."""
    base = base or segments.current(spark, root, analysis)
    docs = shared.staged(prepared(tree, titles))
    if bad := docs.select("doc_id", text.contract_violation("text").alias("why")).where("why IS NOT NULL").orderBy("doc_id").limit(5).collect():
        raise ValueError(f"bodies break the contract: {', '.join(f'{r.doc_id} ({r.why})' for r in bad)}")
    key = F.col("doc_id").alias("key")
    before = base.table("state") if base.segments else spark.createDataFrame([], "doc_id string, source_hash string, body_hash string, version int, title string")
    changes = snapshots.change_set(before.select(key, "source_hash", "body_hash", "version"), docs.select(key, "source_hash", "body_hash"), VERSION)
    work = shared.staged(snapshots.plan_of(changes, before.select(key, "title") if base.segments else None, docs.select(key, "title")).withColumnRenamed("key", "doc_id"))
    counts = {r.work: r.n for r in work.groupBy("work").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Build(base, False, counts)
    given = shared.staged(docs.join(work.where("work <> 'remove'").select("doc_id"), "doc_id", "left_semi"))
    chunks = shared.staged(chunking.chunks(given, sizes).withColumn("text_hash", F.sha2("text", 256)))
    misses = chunks.join(vectors(base).select("text_hash"), "text_hash", "left_anti").groupBy("text_hash").agg(F.first("text").alias("text"))
    made = {what: f"{what}-{uuid.uuid4().hex}" for what in ("vectors", "audit")}
    fs, path = shared.file_system(spark, root)
    try:
        evaluation.embedded(misses, embed).select("text_hash", "embedding").write.parquet(f"{root}/{made['vectors']}")
        new = spark.read.schema(_VECTORS).parquet(f"{root}/{made['vectors']}")
        lost = chunks.join(vectors(base).select("text_hash").unionByName(new.select("text_hash")), "text_hash", "left_anti").count() + new.where("embedding IS NULL OR size(embedding) = 0").count()
        if lost:
            raise ValueError(f"{lost} chunks have no vector")
        work.withColumn("build", F.lit(base.number + 1).cast("long")).write.parquet(f"{root}/{made['audit']}")
        state = given.select("doc_id", "source_hash", "body_hash", F.lit(VERSION).alias("version"), "title")
        extra = base.extra | {what: [*base.extra.get(what, []), name] for what, name in made.items()}
        shown = given.drop("source_hash", "body_hash").withColumn("text", F.concat_ws("\n", "title", "text")).drop("title")
        index = segments.update(base, shown, work.where("work = 'remove'").select("doc_id"), {"state": state, "chunks": chunks}, extra)
        return Build(index, True, counts, new.count())
    except BaseException:
        for name in made.values():
            fs.delete(path(f"{root}/{name}"), True)
        raise
