"""A stored index: what ranking reads, written once and published whole.

Postings are made where a text lies and meet once, in ranges of (term, document): a query's few words prune row groups by their
least and greatest term, and a frequent term is spread over as many ranges as it needs. Texts lie in ranges of ids, so that a page
of results reads only its own. Lengths are counted in the texts, so that postings can be checked against them. A build writes to
a hidden folder, checks what it has written, and renames the folder; a build that fails or is found wrong leaves nothing.

Defined cases: null and empty texts have no postings and no length; rows that repeat an id are one document of their texts, one
after the other in order; an empty table gives an empty index with one row of statistics (0 documents).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions import text
from lexarium.operators import index, segmentation
from lexarium.operators.segmentation import PLAIN, Analysis
from lexarium.sources import shared

TABLES = ("documents", "bodies", "postings", "lexicon", "lengths", "statistics")
#: Documents of which postings are compared with their texts again: a check, seeded, not a filter of what is stored.
CHECKED = 20
#: Bytes of a row group of what is looked up by key.
GROUP_BYTES = 8 << 20


@dataclass(frozen=True)
class Stored:
    spark: SparkSession
    at: str
    analysis: Analysis = PLAIN

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}")

    @property
    def postings(self) -> DataFrame:
        return self.table("postings")

    @property
    def lengths(self) -> DataFrame:
        return self.table("lengths")

    @property
    def statistics(self) -> DataFrame:
        return self.table("statistics")

    @property
    def lexicon(self) -> DataFrame:
        return self.table("lexicon")

    @property
    def documents(self) -> DataFrame:
        """doc_id, title, title_terms, and the columns besides text that the documents came with."""
        return self.table("documents")

    @property
    def bodies(self) -> DataFrame:
        """doc_id, text."""
        return self.table("bodies")


def whole(docs: DataFrame) -> DataFrame:
    """doc_id, text: one row for each id; texts of one id follow each other in order."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    again = own.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    if again.isEmpty():
        return own
    key = own.doc_id.eqNullSafe(again.doc_id)
    joined = own.join(again, key, "left_semi").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("text"))
    return own.join(again, key, "left_anti").unionByName(joined)


def titled(docs: DataFrame, analysis: Analysis) -> DataFrame:
    """docs without text, with title (the text's first line) and title_terms."""
    title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    out = docs.select(*[c for c in docs.columns if c not in ("text", "title", "title_terms")], title.alias("title"))
    if analysis is PLAIN:
        return out.withColumn("title_terms", text.tokens("title"))
    words = F.pandas_udf(lambda s: s.map(lambda t: [w for w, _, _ in analysis.query(segmentation.normal(t))]), "array<string>")
    return out.withColumn("title_terms", words("title"))


def published(spark: SparkSession, at: str, analysis: Analysis, write: Callable[[Stored], None], wrong: Callable[[Stored], list[str]]) -> Stored:
    """What write() puts into a hidden folder, renamed to `at` if wrong() finds nothing; else nothing is left."""
    fs, path = shared.file_system(spark, at)
    if fs.exists(path(at)):
        raise FileExistsError(at)
    parent, _, name = at.rpartition("/")
    hidden = Stored(spark, f"{parent}/_building-{name}", analysis)
    try:
        write(hidden)
        if found := wrong(hidden):
            raise ValueError(f"the index is wrong: {', '.join(sorted(found))}")
        if not fs.rename(path(hidden.at), path(at)):
            raise OSError(f"can't rename {hidden.at}")
    except BaseException:
        fs.delete(path(hidden.at), True)
        raise
    return Stored(spark, at, analysis)


def write_tables(to: Stored, documents: DataFrame, bodies: DataFrame, postings: DataFrame, lengths: DataFrame, more: dict[str, DataFrame] | None = None) -> None:
    """All tables of an index, and further ones by name; lexicon and statistics are sums of what has been written."""
    for name, df in (more or {}).items():
        df.write.parquet(f"{to.at}/{name}")
    documents.write.parquet(f"{to.at}/documents")
    by_key = lambda df, *keys: df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.option("parquet.block.size", GROUP_BYTES)
    by_key(bodies, "doc_id").parquet(f"{to.at}/bodies")
    by_key(postings, "term", "doc_id").parquet(f"{to.at}/postings")
    to.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.parquet(f"{to.at}/lexicon")
    lengths.write.parquet(f"{to.at}/lengths")
    index.statistics(to.lengths).write.parquet(f"{to.at}/statistics")


def build(docs: DataFrame, at: str, analysis: Analysis = PLAIN, more: dict[str, DataFrame] | None = None) -> Stored:
    """The index of docs (doc_id, text and more) in the new folder at; more: further tables that lie there."""
    texts = whole(docs)
    return published(
        docs.sparkSession, at, analysis,
        lambda to: write_tables(to, titled(docs, analysis), texts, segmentation.postings(texts, analysis), segmentation.lengths(texts, analysis), more),
        lambda to: [r.check for r in checks(to, docs).where("wrong > 0").collect()],
    )


def checks(stored: Stored, docs: DataFrame) -> DataFrame:
    """check, wrong: how much of the stored tables breaks each rule; one row a rule, each counted where its rows lie.

    Documents are those of the source; documents have postings where their texts were counted to have words, and a length where the
    source has words (coverage), as many postings as words (lengths); sums of the lexicon and statistics are those of postings and lengths; positions are as many as tf says, in order;
    CHECKED documents' postings are those of their texts.
    """
    p, ids = stored.postings, docs.select("doc_id").distinct()
    one = lambda name, df: df.agg(F.count("*").alias("wrong")).select(F.lit(name).alias("check"), "wrong")
    kept = stored.documents.select("doc_id").distinct()
    by_doc = p.groupBy("doc_id").agg(F.sum("tf").alias("tf")).alias("p")
    both = by_doc.join(stored.lengths.alias("l"), F.col("p.doc_id").eqNullSafe(F.col("l.doc_id")), "full")
    met = both.agg(F.count_if(F.col("tf").isNull() | F.col("length").isNull()).alias("coverage"), F.count_if(F.col("tf") != F.col("length")).alias("lengths"))
    if stored.analysis is PLAIN:  # without a dictionary a text with a Latin letter or digit has a word
        lettered = docs.where(F.col("text").rlike("[A-Za-z0-9]")).select("doc_id").distinct().alias("d")
        bare = lettered.join(stored.lengths.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")), "left_anti").agg(F.count("*").alias("bare"))
        met = met.crossJoin(bare).select((F.col("coverage") + F.col("bare")).alias("coverage"), "lengths")
    totals = p.agg(F.count("*").alias("rows"), F.coalesce(F.sum("tf"), F.lit(0)).alias("cf")).crossJoin(stored.lexicon.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df_sum"), F.coalesce(F.sum("cf"), F.lit(0)).alias("cf_sum")))
    s, t = stored.statistics, index.statistics(stored.lengths)
    sample = docs.where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(CHECKED).select("doc_id").distinct()
    fresh = segmentation.postings(whole(docs.join(F.broadcast(sample), "doc_id", "left_semi")), stored.analysis).select("term", "doc_id", "tf", "positions")
    old = p.join(F.broadcast(sample), "doc_id", "left_semi").select("term", "doc_id", "tf", "positions")
    parts = [
        one("documents", kept.exceptAll(ids).unionAll(ids.exceptAll(kept))),
        met.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("wrong")) for c in ("coverage", "lengths")])).alias("x")).select("x.*"),
        totals.select(F.lit("lexicon").alias("check"), ((F.col("rows") != F.col("df_sum")).cast("long") + (F.col("cf") != F.col("cf_sum")).cast("long")).alias("wrong")),
        one("statistics", s.join(t, (s.n == t.n) & (F.abs(s.avg_length - t.avg_length) < 1e-9), "left_anti")),
        one("positions", p.where((F.size("positions") != F.col("tf")) | (F.col("tf") < 1) | (F.col("positions") != F.array_sort("positions")))),
        one("texts", fresh.exceptAll(old).unionAll(old.exceptAll(fresh))),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out
