"""Index queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.operators import discovery, index, segmentation, segments
from lexarium.plans.base import LENGTHS, TOK, query, stored_index, table
from lexarium.sources import shared


def _tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tokens(table(spark, sf_dir, "documents"))


@query(f"WITH {TOK} SELECT doc_id, term, pos FROM tok")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every text with its place."""
    return _tok(spark, sf_dir)


@query(f"WITH {TOK} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM tok GROUP BY doc_id")
def doc_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and distinct terms of each document."""
    by_term = _tok(spark, sf_dir).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return by_term.groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_terms"))


@query(f"WITH {TOK}, {LENGTHS} SELECT n, round(avg_length, 6) AS avg_length FROM stats")
def collection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tokens and their average length."""
    return index.statistics(index.text_lengths(table(spark, sf_dir, "documents"))).select("n", F.round("avg_length", 6).alias("avg_length"))


@query(f"WITH {TOK} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok GROUP BY term, doc_id")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with positions."""
    return index.postings(_tok(spark, sf_dir)).select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query(f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY term")
def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequencies of all terms."""
    return index.lexicon(_tok(spark, sf_dir))


@query(f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term ORDER BY df DESC, term LIMIT 20")
def df_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 terms of the most documents."""
    return index.lexicon(_tok(spark, sf_dir)).select("term", "df").orderBy(F.col("df").desc(), "term").limit(20)


@query(f"WITH {TOK} SELECT term, doc_id, count(*) AS tf FROM tok WHERE term IN ('idiot', 'clown', 'apache') GROUP BY ALL")
def postings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of a query's words."""
    return stored_index(spark, sf_dir).postings.where(F.col("term").isin("idiot", "clown", "apache")).select("term", "doc_id", "tf")


RUNS = f"""WITH {TOK}, line_words AS (SELECT doc_id, pos // 4294967296 AS line, list(term ORDER BY pos) AS w FROM tok GROUP BY ALL),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM line_words, (VALUES (2), (3), (4), (5)) sizes(n) WHERE len(w) >= n),
runs AS (SELECT doc_id, n AS size, array_to_string(w[i : i + n - 1], ' ') AS term, CASE WHEN i > 1 THEN w[i - 1] ELSE '^' END AS before, CASE WHEN i + n - 1 < len(w) THEN w[i + n] ELSE '$' END AS after FROM places),
often AS (SELECT term, size, count(*) AS tf, count(DISTINCT doc_id) AS df FROM runs GROUP BY ALL HAVING count(DISTINCT doc_id) >= 3),
words AS (SELECT term AS word, count(*) AS c FROM tok GROUP BY term),
rarest AS (SELECT term, min(c) AS c FROM (SELECT term, unnest(string_split(term, ' ')) AS word FROM often) JOIN words USING (word) GROUP BY term),
sides AS (SELECT term, 1 AS side, before AS x, count(*) AS c FROM runs WHERE term IN (SELECT term FROM often) GROUP BY ALL UNION ALL SELECT term, 2, after, count(*) FROM runs WHERE term IN (SELECT term FROM often) GROUP BY ALL),
shares AS (SELECT *, c / sum(c) OVER (PARTITION BY term, side) AS p FROM sides),
spread AS (SELECT term, side, -sum(p * ln(p)) AS h, coalesce(max(c) FILTER (WHERE x NOT IN ('^', '$')), 0) AS most FROM shares GROUP BY ALL)"""
SCORED_RUNS = "found AS (SELECT o.term, o.size::INT AS size, o.tf, o.df, round(o.tf::DOUBLE / r.c, 12) AS dominance, round(abs(min(s.h)), 6) AS entropy, round(CASE WHEN o.size < 5 THEN max(s.most)::DOUBLE / o.tf ELSE 0.0 END, 12) AS extends FROM often o JOIN rarest r USING (term) JOIN spread s USING (term) GROUP BY o.term, o.size, o.tf, o.df, r.c)"


@query(f"{RUNS}, {SCORED_RUNS} SELECT * FROM found")
def word_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 2 to 5 tokens in three documents or more, with dominance, the entropy of their neighbours, and how often they go on."""
    return discovery.discovered(table(spark, sf_dir, "documents"))


@query(f"{RUNS}, {SCORED_RUNS}, good AS (SELECT * FROM found WHERE entropy >= 1.0 AND extends < 0.6 AND dominance >= 0.6) SELECT term, size FROM good WHERE NOT starts_with(term, 'the ') AND term <> 'you idiot' AND NOT (starts_with(term, 'of ') AND substr(term, 4) IN (SELECT term FROM good)) AND NOT ends_with(term, ' on')")
def discovery_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that are taken as terms."""
    found = discovery.discovered(table(spark, sf_dir, "documents"))
    return discovery.selected(found, block=("you idiot",), titles=("of",), leading=("the",), ending=("on",)).select("term", "size")


HOLDS = f"""WITH {TOK} SELECT 'postings' AS what, count(*)::BIGINT AS n FROM (SELECT DISTINCT term, doc_id FROM tok) UNION ALL SELECT 'tokens', count(*) FROM tok UNION ALL SELECT 'terms', count(DISTINCT term) FROM tok
UNION ALL SELECT 'lengths', count(DISTINCT doc_id) FROM tok UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'average', round(count(*) / count(DISTINCT doc_id))::BIGINT FROM tok"""


def _holds(at) -> DataFrame:
    count = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    tokens = at.lexicon.agg(F.sum("cf").alias("n")).select(F.lit("tokens").alias("what"), "n")
    average = at.statistics.select(F.lit("average").alias("what"), F.round("avg_length").cast("long").alias("n"))
    return count("postings", at.postings).unionAll(tokens).unionAll(count("terms", at.lexicon)).unionAll(count("lengths", at.lengths)).unionAll(count("documents", at.documents)).unionAll(average)


@query(HOLDS)
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored index holds; the first query to need it builds and checks it."""
    return _holds(stored_index(spark, sf_dir))


@query(HOLDS)
def segment_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index of segments holds after a build on an older corpus: one document in 50 was another, one in 80 wasn't there, and
    some are gone. It equals an index built anew."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    older = docs.where(k % 80 != 7).withColumn("text", F.when(k % 50 == 3, F.concat("text", F.lit(" words that were there before"))).otherwise(F.col("text")))
    gone = docs.where(k % 90 == 1).withColumn("doc_id", -1 - k)
    base = segments.update(segments.current(spark, shared.folder(spark, "segments")), older.unionByName(gone))
    return _holds(segments.update(base, docs.where((k % 80 == 7) | (k % 50 == 3)), gone.select("doc_id")))


@query(f"""WITH RECURSIVE {TOK}, lex AS (SELECT term, count(*) AS cf FROM tok GROUP BY term), dict AS (SELECT term, cf FROM lex WHERE length(term) BETWEEN 2 AND 4), total AS (SELECT ln(sum(cf)::DOUBLE) AS ln_total FROM dict),
words AS (SELECT term, round(1e9::DOUBLE * (ln(cf::DOUBLE) - ln_total))::BIGINT AS w FROM dict, total), lone AS (SELECT round(1e9::DOUBLE * -ln_total)::BIGINT AS w1 FROM total),
path AS (SELECT term, length(term)::INT AS i, [0::BIGINT] AS v, []::INT[] AS n FROM lex
UNION ALL SELECT term, i - 1, list_prepend(b.v, v), list_prepend(b.n, n) FROM (SELECT p.term, p.i, p.v, p.n, list_max(list_filter([{{'v': w1 + p.v[1], 'n': 1}}, {{'v': d2.w + p.v[2], 'n': 2}}, {{'v': d3.w + p.v[3], 'n': 3}}, {{'v': d4.w + p.v[4], 'n': 4}}], lambda x: x.v IS NOT NULL)) AS b
  FROM path p JOIN lone ON true LEFT JOIN words d2 ON d2.term = substring(p.term, p.i, 2) AND p.i + 1 <= length(p.term) LEFT JOIN words d3 ON d3.term = substring(p.term, p.i, 3) AND p.i + 2 <= length(p.term) LEFT JOIN words d4 ON d4.term = substring(p.term, p.i, 4) AND p.i + 3 <= length(p.term) WHERE p.i > 0)),
whole AS (SELECT term, n FROM path WHERE i = 0), walk AS (SELECT term, n, 1 AS at_, '' AS cut FROM whole UNION ALL SELECT term, n, at_ + n[at_], cut || CASE WHEN at_ > 1 THEN '|' ELSE '' END || substring(term, at_, n[at_]) FROM walk WHERE at_ <= length(term))
SELECT term, cut FROM walk WHERE at_ > length(term)""")
def dictionary_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term cut along its best path over the terms of two to four letters, weighed by their occurrences."""
    lexicon = stored_index(spark, sf_dir).lexicon
    known = lexicon.where(F.length("term").between(2, 4)).select(F.col("term").alias("word"), F.col("cf").alias("frequency"))
    own = segmentation.dictionary_of(known)
    cut = F.pandas_udf(lambda s: s.map(lambda t: "|".join(t[a:b] for a, b in own.path(t))), "string")
    return lexicon.select("term", cut("term").alias("cut"))
