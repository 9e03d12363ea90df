"""Citations, evaluation and lists: chunks are made of documents' lines, judged queries of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarium.functions import text
from lexarium.operators import catalogue, citations, evaluation, paging, queries
from lexarium.plans.base import LENGTHS, TOK, query, stored_index, table
from lexarium.plans.ranking import MANY

#: A chunk for each line of a text; the third words of lines are headings, similarities come from the ids.
CHUNKS = """chunks AS (SELECT 'd' || doc_id || '.md' AS doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Title ' || doc_id % 90 END AS title, CASE WHEN n % 4 = 0 THEN NULL ELSE 'Part ' || n % 3 END AS heading, CASE WHEN n % 4 = 0 THEN '' ELSE 'Part-' || n % 3 END AS anchor,
((doc_id * 7 + n * 13) % 10)::DOUBLE / 10 AS similarity, n AS place, n::INT AS chunk_index FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents))"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    bare = F.col("n") % 4 == 0
    return d.select(
        F.concat(F.lit("d"), "doc_id", F.lit(".md")).alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("Title "), F.col("doc_id") % 90)).alias("title"), F.when(~bare, F.concat(F.lit("Part "), F.col("n") % 3)).alias("heading"),
        F.when(bare, "").otherwise(F.concat(F.lit("Part-"), F.col("n") % 3)).alias("anchor"), (((F.col("doc_id") * 7 + F.col("n") * 13) % 10).cast("double") / 10).alias("similarity"), F.col("n").cast("long").alias("place"), F.col("n").alias("chunk_index"),
    )


STRONGEST = "strongest AS (SELECT doc_id, anchor, heading FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, place) AS k FROM chunks WHERE anchor <> '') WHERE k = 1)"


@query(f"WITH {CHUNKS}, {STRONGEST} SELECT * FROM strongest")
def strongest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section of each document that a bare citation opens."""
    return citations.strongest_sections(_chunks(spark, sf_dir))


@query(f"""WITH {CHUNKS}, {STRONGEST}, named AS (SELECT doc_id, coalesce(nullif(any_value(title), ''), doc_id) AS title FROM chunks GROUP BY doc_id),
pages AS (SELECT doc_id, n.title, coalesce(s.anchor, '') AS anchor, '' AS suffix FROM named n LEFT JOIN strongest s USING (doc_id) UNION ALL SELECT DISTINCT c.doc_id, n.title, c.anchor, '#' || c.anchor FROM chunks c JOIN named n USING (doc_id) WHERE c.anchor <> ''),
spelled AS (SELECT doc_id || suffix AS spelling, * FROM pages UNION ALL SELECT title || suffix, * FROM pages)
SELECT spelling, min(doc_id) AS doc_id, arg_min(anchor, doc_id) AS anchor, arg_min('[[' || title || ']](/read/' || doc_id || CASE WHEN anchor <> '' THEN '#' || anchor ELSE '' END || ')', doc_id) AS link FROM spelled GROUP BY spelling""")
def citation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source may be called, and where it leads."""
    return citations.citation_map(_chunks(spark, sf_dir))


@query(f"WITH {CHUNKS} SELECT doc_id, heading, anchor AS heading_anchor, min(chunk_index) AS first FROM chunks WHERE heading IS NOT NULL GROUP BY ALL")
def heading_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each heading's first chunk."""
    return catalogue.headings(_chunks(spark, sf_dir).withColumnRenamed("anchor", "heading_anchor"))


DAY = "CASE doc_id % 4 WHEN 0 THEN '20' || lpad((doc_id % 30)::VARCHAR, 2, '0') || '-03-0' || (doc_id % 9 + 1) WHEN 1 THEN 'soon' WHEN 2 THEN '2019-02-30' END"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    day = F.when(k % 4 == 0, F.concat(F.lit("20"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit("-03-0"), k % 9 + 1)).when(k % 4 == 1, "soon").when(k % 4 == 2, "2019-02-30")
    return table(spark, sf_dir, "documents").select(k, "source", day.alias("published"))


@query(f"WITH d AS (SELECT doc_id, {DAY} AS published FROM documents) SELECT doc_id, row_number() OVER (ORDER BY coalesce(CASE WHEN regexp_matches(published, '^2') THEN try_cast(published AS DATE) END, DATE '0001-01-01') DESC, doc_id DESC) AS place FROM d QUALIFY place <= 100")
def archive_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's first hundred places."""
    top = catalogue.archive(_dated(spark, sf_dir)).limit(100)
    from lexarium.functions.text import valid_date

    return top.select("doc_id", F.row_number().over(W.orderBy(valid_date("published").desc_nulls_last(), F.col("doc_id").desc())).cast("long").alias("place"))


@query(f"SELECT left(published, 4) AS year, count(*) AS n FROM (SELECT {DAY} AS published FROM documents) WHERE regexp_matches(published, '^[0-9]{{4}}') GROUP BY ALL")
def facets_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by year."""
    return catalogue.by_year(_dated(spark, sf_dir))


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id = 17")
def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document by its key."""
    return catalogue.by_key(table(spark, sf_dir, "documents"), "doc_id", 17).select("doc_id", "source", "lang")


#: Judged queries: a word each; its documents are those that hold it as a substring.
JUDGED = ("idiot", "clown", "apache", "licensed")
_HITS = " UNION ALL ".join(f"SELECT '{q}' AS query, doc_id FROM documents WHERE contains(text, '{q}')" for q in JUDGED)
_ASKED = "asked(query, unit, name, weight, core) AS (VALUES " + ", ".join(f"('{q}', 0, '{q}', 1.0::DOUBLE, true)" for q in JUDGED) + ")"
_RANKED = f"{TOK}, {LENGTHS}, {_ASKED}, {MANY}, ranked AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc_id) AS rank FROM shown)"


def _ranked_and_truth(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All results of the judged strings with their ranks, which are counted in buckets of scores, and the truth."""
    found = queries.answered(stored_index(spark, sf_dir), dict(enumerate(JUDGED))).withColumn("score", F.round("score", 6))
    found = found.select(F.element_at(F.array(*map(F.lit, JUDGED)), F.col("query") + 1).alias("query"), "doc_id", "score", F.floor(F.col("score") * 16).alias("bucket"))
    ranked = paging.numbered_within(found, ["query"], "bucket", [F.col("score").desc(), F.col("doc_id")], "rank").select("query", "doc_id", "rank")
    docs = table(spark, sf_dir, "documents")
    truth = docs.select("doc_id", F.explode(F.array(*[F.when(F.col("text").contains(q), q) for q in JUDGED])).alias("query")).where("query IS NOT NULL")
    return ranked, truth


@query(f"""WITH truth AS ({_HITS}), {_RANKED}, judged AS (SELECT r.*, t.doc_id IS NOT NULL AS hit FROM ranked r LEFT JOIN truth t ON t.query = r.query AND t.doc_id = r.doc_id),
n AS (SELECT query, count(*) AS n FROM truth GROUP BY query)
SELECT n.query, round(count(*) FILTER (WHERE hit) / count(rank)::DOUBLE, 6) AS precision, count(*) FILTER (WHERE hit AND rank <= 10) / 10.0::DOUBLE AS p_at_10, round(count(*) FILTER (WHERE hit) / any_value(n.n)::DOUBLE, 6) AS recall, round(1.0::DOUBLE / min(rank) FILTER (WHERE hit), 6) AS mrr,
(min(rank) FILTER (WHERE hit) <= 10)::INT AS hit_10, (min(rank) FILTER (WHERE hit) <= 20)::INT AS hit_20 FROM n JOIN judged USING (query) GROUP BY n.query""")
def labelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and first hits of each judged query."""
    found = evaluation.search_quality(*_ranked_and_truth(spark, sf_dir))
    return found.select("query", *(F.round(c, 6).alias(c) for c in ("precision", "p_at_10", "recall", "mrr")), "hit_10", "hit_20")


@query(f"""WITH truth AS ({_HITS}), {_RANKED}, ks(k) AS (VALUES (1), (5), (20)), q AS (SELECT query, count(*)::DOUBLE AS n FROM truth GROUP BY query),
each AS (SELECT q.query, k, (SELECT count(*) FROM ranked r JOIN truth t ON t.query = r.query AND t.doc_id = r.doc_id WHERE r.query = q.query AND r.rank <= k) / n AS recall, (SELECT count(*) FROM ranked r WHERE r.query = q.query AND r.rank <= k) AS size FROM q, ks)
SELECT k, round(avg(recall), 6) AS recall, round(avg(size), 6) AS results FROM each GROUP BY k""")
def retriever_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall among the first k, over all judged queries."""
    ranked, truth = _ranked_and_truth(spark, sf_dir)
    found = evaluation.retriever_recall(ranked.withColumnRenamed("doc_id", "id"), truth.withColumnRenamed("doc_id", "id"), [1, 5, 20])
    return found.select("k", F.round("recall", 6).alias("recall"), F.round("results", 6).alias("results"))


@query(r"""SELECT doc_id, 'Title ' || doc_id % 90 || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ' / Part ' || doc_id % 3 END || ' (' || printf('%.2f', (doc_id * 7 % 10)::DOUBLE / 10) || '): ' || left(regexp_replace(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), '^ | $', '', 'g'), 350) AS card,
sha256('{"doc_id":' || doc_id || ',"lang":' || to_json(lang) || ',"source":' || to_json(source) || '}') AS etag FROM documents""")
def grader_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a grader reads of each text, and the tag of its catalogue row."""
    heading = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("Part "), F.col("doc_id") % 3))
    card = text.grader_excerpt(F.concat(F.lit("Title "), F.col("doc_id") % 90), heading, (F.col("doc_id") * 7 % 10).cast("double") / 10, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", card.alias("card"), text.etag("doc_id", "lang", "source").alias("etag"))
