"""An index that grows by segments: a build reads and writes what has changed, and readers see one manifest.

A segment is a stored index (store.py) that is never changed. A manifest, a small file with a number, lists the segments that make up
the index, and for each one the documents that later segments replace or that were removed, with what their words count. A build
writes a segment of the changed documents, the new lists, and the next manifest, which it creates only if no other build has
(a lost race leaves nothing). Postings, lengths and texts are those of all segments without what is gone; document counts and
lengths are sums in the manifest, so ranking is that of one index built anew. Where FAN segments are of one size class, they are
merged from their stored tables, so that there are a few for each power of FAN.

Defined cases: a document that is given and removed in one build is given; removing what isn't there does nothing; a build
without changes publishes nothing; rows that repeat an id are one document (store.whole).
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.operators import segmentation, store
from lexarium.operators.segmentation import PLAIN, Analysis
from lexarium.operators.store import Stored
from lexarium.sources import shared

#: Segments of one size class that are merged.
FAN = 8


class LostRaceError(RuntimeError):
    """Another build has published on the same base."""


@dataclass(frozen=True)
class Segment:
    """A segment's folder, its documents with words and their words; the folder of what is gone of it, and how much that is; tables
    besides an index's own, each with a doc_id."""

    name: str
    n: int
    tokens: int
    gone: str | None = None
    gone_n: int = 0
    gone_tokens: int = 0
    more: tuple[str, ...] = ()


@dataclass(frozen=True)
class Segmented:
    """The index of one manifest; reads like a Stored."""

    spark: SparkSession
    root: str
    number: int
    segments: tuple[Segment, ...]
    analysis: Analysis = PLAIN
    #: What a build has put into the manifest besides segments.
    extra: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        """A further table of the segments, without the rows of documents that are gone."""
        return self._every(name)

    @property
    def at(self) -> str:
        return f"{self.root}#{self.number}"

    def _every(self, name: str, segments: tuple[Segment, ...] | None = None) -> DataFrame:
        out = None
        for s in self.segments if segments is None else segments:
            df = self.spark.read.parquet(f"{self.root}/{s.name}/{name}")
            if s.gone is not None:
                gone = self.spark.read.parquet(f"{self.root}/{s.gone}/ids").withColumnRenamed("doc_id", "gone_id")
                df = df.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise ValueError("the index has no segment")
        return out

    @property
    def postings(self) -> DataFrame:
        return self._every("postings")

    @property
    def lengths(self) -> DataFrame:
        return self._every("lengths")

    @property
    def documents(self) -> DataFrame:
        return self._every("documents")

    @property
    def bodies(self) -> DataFrame:
        return self._every("bodies")

    @property
    def statistics(self) -> DataFrame:
        n = sum(s.n - s.gone_n for s in self.segments)
        tokens = sum(s.tokens - s.gone_tokens for s in self.segments)
        return self.spark.createDataFrame([(n, tokens / n if n else 0.0)], "n long, avg_length double")

    @property
    def lexicon(self) -> DataFrame:
        """Sums of the segments' words, less those of what is gone."""
        rows = None
        for s in self.segments:
            own = self.spark.read.parquet(f"{self.root}/{s.name}/lexicon").select("term", "df", "cf")
            if s.gone is not None:
                own = own.unionByName(self.spark.read.parquet(f"{self.root}/{s.gone}/terms").select("term", (-F.col("df")).alias("df"), (-F.col("cf")).alias("cf")))
            rows = own if rows is None else rows.unionByName(own)
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")


def _manifest(root: str, number: int) -> str:
    return f"{root}/manifest-{number:08d}.json"


def current(spark: SparkSession, root: str, analysis: Analysis = PLAIN) -> Segmented:
    """The newest manifest's index; an empty one, number 0, where there is none."""
    fs, path = shared.file_system(spark, root)
    found = [str(f.getPath().getName()) for f in fs.listStatus(path(root))] if fs.exists(path(root)) else []
    number = max((int(f[9:17]) for f in found if f.startswith("manifest-") and f.endswith(".json")), default=0)
    said = json.loads(shared.read_text(spark, _manifest(root, number))) if number else {"segments": [], "extra": {}}
    return Segmented(spark, root, number, tuple(Segment(**s | {"more": tuple(s["more"])}) for s in said["segments"]), analysis, said["extra"])


def _publish(base: Segmented, segments: list[Segment], extra: dict) -> Segmented:
    """The manifest after base's, if no other build has created it."""
    body = json.dumps({"segments": [asdict(s) for s in segments], "extra": extra})
    if not shared.create_text(base.spark, _manifest(base.root, base.number + 1), body):
        raise LostRaceError(f"manifest {base.number + 1} of {base.root} is there already")
    return Segmented(base.spark, base.root, base.number + 1, tuple(segments), base.analysis, extra)


def _counted(stored: Stored) -> tuple[int, int]:
    r = stored.lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    return r.n, r.tokens


def _without(base: Segmented, s: Segment, ids: DataFrame) -> Segment:
    """The segment with ids (doc_id) gone: what it has of them is listed, with the counts of their words."""
    stored = Stored(base.spark, f"{base.root}/{s.name}", base.analysis)
    listed = stored.documents.select("doc_id").distinct()
    if s.gone is not None:
        before = base.spark.read.parquet(f"{base.root}/{s.gone}/ids").withColumnRenamed("doc_id", "gone_id")
        listed = listed.join(before, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    asked = ids.withColumnRenamed("doc_id", "asked")
    hit = listed.join(asked, F.col("doc_id").eqNullSafe(F.col("asked")), "left_semi")
    at = f"gone-{uuid.uuid4().hex}"
    fs, path = shared.file_system(base.spark, base.root)
    try:
        hit.write.parquet(f"{base.root}/{at}/new")
        new = base.spark.read.parquet(f"{base.root}/{at}/new")
        if new.isEmpty():
            fs.delete(path(f"{base.root}/{at}"), True)
            return s
        named = new.withColumnRenamed("doc_id", "new_id")
        of = lambda df: df.join(named, F.col("doc_id").eqNullSafe(F.col("new_id")), "left_semi")
        terms = segmentation.postings(of(stored.bodies), base.analysis).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
        every = new
        if s.gone is not None:
            every = every.unionByName(base.spark.read.parquet(f"{base.root}/{s.gone}/ids"))
            terms = terms.unionByName(base.spark.read.parquet(f"{base.root}/{s.gone}/terms")).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        every.write.parquet(f"{base.root}/{at}/ids")
        terms.write.parquet(f"{base.root}/{at}/terms")
        lost = of(stored.lengths).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    except BaseException:
        fs.delete(path(f"{base.root}/{at}"), True)
        raise
    return replace(s, gone=at, gone_n=s.gone_n + lost.n, gone_tokens=s.gone_tokens + lost.tokens)


def update(base: Segmented, given: DataFrame | None = None, removed: DataFrame | None = None, more: dict[str, DataFrame] | None = None, extra: dict | None = None) -> Segmented:
    """The index after a build on base: given (doc_id, text and more) are new or changed documents, removed (doc_id) go; more:
    further tables of given, each with a doc_id; extra: what else the manifest says (else as before). What a build that fails or
    loses its race has written is deleted."""
    spark, fs_path = base.spark, shared.file_system(base.spark, base.root)
    ids = [df.select("doc_id") for df in (given, removed) if df is not None]
    if all(df.isEmpty() for df in ids):
        return base
    every = ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1])
    made: list[str] = []
    try:
        segments = [_without(base, s, every.distinct()) for s in base.segments]
        made += [s.gone for s, old in zip(segments, base.segments, strict=True) if s.gone != old.gone]
        if segments == list(base.segments) and (given is None or given.isEmpty()):
            return base
        if given is not None and not given.isEmpty():
            made.append(f"segment-{uuid.uuid4().hex}")
            segments.append(Segment(made[-1], *_counted(store.build(given, f"{base.root}/{made[-1]}", base.analysis, more)), more=tuple(more or ())))
        return _publish(base, segments, base.extra if extra is None else extra)
    except BaseException:
        for name in made:
            fs_path[0].delete(fs_path[1](f"{base.root}/{name}"), True)
        raise


def size_class(s: Segment) -> int:
    return int(math.log(max(1, s.n - s.gone_n), FAN) + 1e-9)


def merged(base: Segmented) -> Segmented:
    """The index with FAN or more segments of one size class (the smallest that has so many) as one, from their stored tables."""
    classes = sorted(size_class(s) for s in base.segments)
    full = next((c for c in classes if classes.count(c) >= FAN), None)
    if full is None:
        return base
    old = tuple(s for s in base.segments if size_class(s) == full)
    n, tokens = sum(s.n - s.gone_n for s in old), sum(s.tokens - s.gone_tokens for s in old)
    name = f"segment-{uuid.uuid4().hex}"

    def wrong(to: Stored) -> list[str]:
        rows = to.postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tf")).first()
        return [what for what, a, b in (("lengths", _counted(to), (n, tokens)), ("postings", rows.tf, tokens)) if a != b]

    of = lambda table: base._every(table, old)
    more = {t: of(t) for t in old[0].more}
    store.published(base.spark, f"{base.root}/{name}", base.analysis, lambda to: store.write_tables(to, of("documents"), of("bodies"), of("postings"), of("lengths"), more), wrong)
    try:
        return _publish(base, [*(s for s in base.segments if s not in old), Segment(name, n, tokens, more=old[0].more)], base.extra)
    except BaseException:
        fs, path = shared.file_system(base.spark, base.root)
        fs.delete(path(f"{base.root}/{name}"), True)
        raise


def swept(index: Segmented) -> list[str]:
    """Deletes the folders that this manifest doesn't name, and manifests before it; to be called when no reader has an older one."""
    fs, path = shared.file_system(index.spark, index.root)
    named = {x for s in index.segments for x in (s.name, s.gone)}
    out = []
    for f in fs.listStatus(path(index.root)):
        name = str(f.getPath().getName())
        old = name.startswith("manifest-") and int(name[9:17]) < index.number
        if old or (name.startswith(("segment-", "gone-")) and name not in named):
            fs.delete(f.getPath(), True)
            out.append(name)
    return sorted(out)
