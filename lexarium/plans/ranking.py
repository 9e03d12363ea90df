"""Keyword search queries over documents; the first line of a text is its title, its source its channel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarium.functions import text
from lexarium.operators import queries, ranking, snippets, suggest
from lexarium.operators.ranking import Unit
from lexarium.plans.base import LENGTHS, LOWER, TOK, query, stored_index, table

UNITS = [Unit((("idiot",), ("moron",))), Unit((("licensed", "under"),)), Unit((("the",),), 0.15, False), Unit((("apache",),)), Unit((("zzzzqq",),))]
PLAIN = [Unit((("idiot",),)), Unit((("clown",),)), Unit((("apache",),))]


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    at = stored_index(spark, sf_dir)
    return at.postings, at.lengths, at.statistics


def hits_sql(units: list[Unit]) -> str:
    out = []
    for k, u in enumerate(units):
        for s in u.spellings:
            joins = "".join(f" JOIN tok t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(s) if i)
            out.append(f"SELECT {k} AS unit, {len(s)} AS n_parts, t0.doc_id, t0.pos AS start FROM tok t0{joins} WHERE t0.term = '{s[0]}'")
    rows = ", ".join(f"({k}, '{u.name}', {float(u.weight)}::DOUBLE, {str(u.core).lower()})" for k, u in enumerate(units))
    return f"units(unit, name, weight, core) AS (VALUES {rows}), hits AS ({' UNION ALL '.join(out)})"


SCORED = """counted AS (SELECT unit, doc_id, count(*)::DOUBLE AS tf FROM hits GROUP BY ALL),
of_unit AS (SELECT unit, any_value(name) AS name, any_value(weight) AS weight, any_value(core) AS core, count(*)::DOUBLE AS df FROM counted JOIN units USING (unit) GROUP BY unit),
levels AS (SELECT count(*) FILTER (WHERE core AND 2 * df <= n) AS rare, count(*) FILTER (WHERE core) AS cores, count(*) AS every FROM of_unit, stats),
opens AS (SELECT unit, CASE WHEN rare > 0 THEN core AND 2 * df <= n WHEN cores > 0 THEN core ELSE true END AS gating FROM of_unit, levels, stats),
summed AS (SELECT c.doc_id, sum(weight * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 0.3::DOUBLE + 0.9::DOUBLE * length / avg_length)) * (0.1::DOUBLE + 0.9::DOUBLE * sum(weight) / (SELECT sum(weight) FROM units)) AS score,
  count(*) FILTER (WHERE gating) AS gate_hits, string_agg(name, '|' ORDER BY c.unit) AS terms FROM counted c JOIN of_unit USING (unit) JOIN opens USING (unit) JOIN lengths ON lengths.doc_id = c.doc_id, stats GROUP BY c.doc_id)"""
GATED = """asked AS (SELECT CASE WHEN rare > 0 THEN rare WHEN cores > 0 THEN cores ELSE every END AS k FROM levels),
passing AS (SELECT * FROM summed WHERE gate_hits >= greatest(1, least((SELECT CASE WHEN k < 3 THEN k WHEN k < 5 THEN 2 ELSE (k + 1) // 2 END FROM asked), (SELECT max(gate_hits) FROM summed))))"""
NEAR = """beside AS (SELECT DISTINCT b.doc_id FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND b.unit = a.unit + 1 AND b.start - (a.start + a.n_parts) BETWEEN 0 AND 2),
outcome AS (SELECT p.doc_id, score * CASE WHEN p.doc_id IN (SELECT doc_id FROM beside) THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS score, gate_hits, terms FROM passing p)"""
HEAD = f"WITH {TOK}, {LENGTHS}, {hits_sql(UNITS)}, {SCORED}, {GATED}, {NEAR}"
PLAIN_HEAD = f"WITH {TOK}, {LENGTHS}, {hits_sql(PLAIN)}, {SCORED}, {GATED}, {NEAR}"
ROW = "doc_id, round(score, 6) AS score, gate_hits, terms"


def _row(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.round("score", 6).alias("score"), "gate_hits", F.array_join("terms", "|").alias("terms"))


def _ranked(spark: SparkSession, sf_dir: str, units: list[Unit]) -> DataFrame:
    p, length, stats = _parts(spark, sf_dir)
    return ranking.ranked(p, length, stats, units)


@query(f"WITH {TOK}, {LENGTHS}, {hits_sql(UNITS)}, {SCORED} SELECT {ROW} FROM summed")
def bm25_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with coverage, of every document that matches a unit."""
    p, length, stats = _parts(spark, sf_dir)
    return _row(ranking.scores(ranking.hits(p, UNITS), length, stats, UNITS, gate=False))


@query(f"{HEAD} SELECT {ROW} FROM outcome")
def gated_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ranking: gate, BM25, coverage, proximity."""
    return _row(_ranked(spark, sf_dir, UNITS))


@query(f"WITH {TOK}, {hits_sql([UNITS[1]])} SELECT doc_id, count(*) AS tf, min(start) AS first_pos FROM hits GROUP BY doc_id")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase's places, by higher-order functions over positions."""
    found = ranking.hits(stored_index(spark, sf_dir).postings, [UNITS[1]])
    return found.select("doc_id", F.size("starts").cast("long").alias("tf"), F.array_min("starts").alias("first_pos"))


@query(f"WITH {TOK}, {hits_sql([UNITS[0]])} SELECT doc_id, count(*) AS tf FROM hits GROUP BY doc_id")
def alias_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit with two spellings: its frequency is their sum."""
    return ranking.hits(stored_index(spark, sf_dir).postings, [UNITS[0]]).groupBy("doc_id").agg(F.sum(F.size("starts")).alias("tf"))


@query(f"{HEAD} SELECT doc_id FROM beside")
def proximity_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents where neighbouring units stand close."""
    return ranking.near(ranking.hits(stored_index(spark, sf_dir).postings, UNITS), UNITS)


@query(f"{PLAIN_HEAD} SELECT {ROW} FROM outcome WHERE score >= 0.2::DOUBLE * (SELECT max(score) FROM outcome)")
def relative_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of at least a fifth of the best score."""
    return _row(ranking.cut(_ranked(spark, sf_dir, PLAIN)))


TITLE = f"titles AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all({LOWER.format('split_part(text, chr(10), 1)')}, '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS t FROM documents)"
TITLED = " + ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)} {chr(32).join(s)} {chr(39)})' for s in u.spellings)} THEN {float(u.weight)}::DOUBLE ELSE 0 END" for u in UNITS)


@query(f"{HEAD}, {TITLE} SELECT doc_id, round(score * (1.0::DOUBLE + ({TITLED}) / (SELECT sum(weight) FROM units)), 6) AS score FROM outcome JOIN titles USING (doc_id)")
def title_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores raised by what the first line has of the query."""
    titles = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.substring_index("text", "\n", 1)).alias("title_terms"))
    return ranking.with_titles(_ranked(spark, sf_dir, UNITS), titles, UNITS).select("doc_id", F.round("score", 6).alias("score"))


PHRASE, SPLIT = [Unit((("zzzzqq", "idiot"),))], [Unit((("zzzzqq",),)), Unit((("idiot",),))]


@query(f"WITH {TOK}, {LENGTHS}, {hits_sql(SPLIT)}, {SCORED}, {GATED} SELECT {ROW} FROM passing")
def split_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase without results is split in words and ranked again."""
    p, length, stats = _parts(spark, sf_dir)
    units = PHRASE if not ranking.hits(p, PHRASE).isEmpty() else SPLIT
    return _row(ranking.scores(ranking.hits(p, units), length, stats, units))


@query("SELECT doc_id, source FROM documents WHERE text LIKE '%idiot%' OR (text LIKE '%Apache%' AND text LIKE '%License%')")
def contains_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth by substrings: any of one list, or all of another."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where(t.contains("idiot") | (t.contains("Apache") & t.contains("License"))).select("doc_id", "source")


QUALITY = """SELECT count(*) FILTER (WHERE rank <= 10 AND hit) / 10.0::DOUBLE AS p_at_10, count(*) FILTER (WHERE hit)::DOUBLE / count(*) AS precision,
count(*) FILTER (WHERE hit)::DOUBLE / (SELECT count(*) FROM truth) AS recall, coalesce(max(CASE WHEN hit THEN 1.0::DOUBLE / rank END), 0.0) AS mrr, max(CASE WHEN hit AND rank <= 20 THEN 1 ELSE 0 END) AS hit_20 FROM judged"""


@query(
    f"{PLAIN_HEAD}, truth AS (SELECT doc_id FROM documents WHERE text LIKE '%idiot%'), "
    f"judged AS (SELECT row_number() OVER (ORDER BY round(score, 9) DESC, f.doc_id) AS rank, t.doc_id IS NOT NULL AS hit FROM outcome f LEFT JOIN truth t ON t.doc_id = f.doc_id) SELECT round(p_at_10, 6) AS p_at_10, round(precision, 6) AS precision, round(recall, 6) AS recall, round(mrr, 6) AS mrr, hit_20 FROM ({QUALITY})"
)
def search_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, reciprocal rank and hits of a ranking against the ground truth.

    Only the first 20 ranks need an order; they are a top-k, and the rest is counted.
    """
    truth = table(spark, sf_dir, "documents").where(F.col("text").contains("idiot")).select("doc_id", F.lit(True).alias("hit"))
    judged = _ranked(spark, sf_dir, PLAIN).join(truth, "doc_id", "left").select("doc_id", F.round("score", 9).alias("score"), F.coalesce("hit", F.lit(False)).alias("hit"))
    order = [F.col("score").desc(), F.col("doc_id")]
    first = judged.where("hit").orderBy(*order).limit(1).select(F.struct(-F.col("score"), "doc_id").alias("best"))
    before = judged.crossJoin(F.broadcast(first)).where(F.struct(-F.col("score"), F.col("doc_id")) <= F.col("best")).agg(F.count("*").alias("first_rank"))
    top = judged.orderBy(*order).limit(20).withColumn("rank", F.row_number().over(W.orderBy(*order))).agg(F.count_if(F.col("hit") & (F.col("rank") <= 10)).alias("in_10"), F.max(F.when(F.col("hit"), 1).otherwise(0)).alias("hit_20"))
    every = judged.agg(F.count("*").cast("double").alias("n"), F.count_if("hit").cast("double").alias("hits"))
    n_truth = truth.agg(F.count("*").cast("double").alias("n_truth"))
    one = every.crossJoin(n_truth).crossJoin(top).crossJoin(before)
    mrr = F.when(F.col("hits") > 0, 1.0 / F.col("first_rank")).otherwise(0.0)
    return one.select(F.round(F.col("in_10") / 10.0, 6).alias("p_at_10"), F.round(F.col("hits") / F.col("n"), 6).alias("precision"), F.round(F.col("hits") / F.col("n_truth"), 6).alias("recall"), F.round(mrr, 6).alias("mrr"), "hit_20")


@query(f"{PLAIN_HEAD} SELECT source, lang, count(*) AS n FROM outcome JOIN documents USING (doc_id) GROUP BY ALL")
def facets_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of the unfiltered results."""
    return _ranked(spark, sf_dir, PLAIN).join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id").groupBy("source", "lang").agg(F.count("*").alias("n"))


PAGE = "SELECT doc_id, round(score, 6) AS score, source, count(*) OVER () AS total FROM outcome JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY round(score, 9) DESC, doc_id LIMIT 10 OFFSET 5"


@query(f"{PLAIN_HEAD} {PAGE}")
def filter_sort_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter, the stable order, one page and the exact total."""
    kept = _ranked(spark, sf_dir, PLAIN).join(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "source"), "doc_id").select("doc_id", "score", "source")
    page = kept.orderBy(F.round("score", 9).desc(), "doc_id").offset(5).limit(10)
    return page.crossJoin(F.broadcast(kept.agg(F.count("*").alias("total")))).select("doc_id", F.round("score", 6).alias("score"), "source", "total")


MISSPELT = ("apaxhe", "idiott", "licensd")
SUGGEST = f"""WITH {TOK}, lex AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term), asked(word) AS (VALUES ('apaxhe'), ('idiott'), ('licensd')),
near AS (SELECT word, term, df, levenshtein(word, term) AS d FROM asked JOIN lex ON abs(length(term) - length(word)) <= 1 AND df >= 2 AND regexp_matches(term, '^[a-z0-9]+$') AND (left(term, 1) = left(word, 1) OR right(term, 1) = right(word, 1)))
SELECT word, term, d::INT AS distance, df FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, abs(length(term) - length(word)), df DESC, term) AS k FROM near WHERE d <= CASE WHEN length(word) <= 4 THEN 1 ELSE 2 END) WHERE k = 1"""


@query(SUGGEST)
def suggest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest known term of each misspelt word."""
    return suggest.suggestions(stored_index(spark, sf_dir).lexicon, list(MISSPELT))


@query(f"WITH {TOK}, lex AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY term) SELECT term, df FROM lex WHERE df >= 2 AND length(term) BETWEEN 4 AND 6 AND (left(term, 1) = 'i' OR right(term, 1) = 't')")
def lexicon_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate terms of a word by length and first or last letter."""
    return suggest.candidates(stored_index(spark, sf_dir).lexicon, "idiot").select("term", "df")


@query()
def snippet_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three windows of each document of the first page."""
    page = ranking.cut(_ranked(spark, sf_dir, PLAIN)).orderBy(F.col("score").desc(), "doc_id").limit(50)
    return snippets.snippets(table(spark, sf_dir, "documents").join(F.broadcast(page.select("doc_id")), "doc_id"), [(s, u.weight) for u in PLAIN for s in u.spellings])


@query(f"""{PLAIN_HEAD}, vec AS (SELECT vec_id AS id, row_number() OVER (ORDER BY sim DESC, vec_id) AS rank FROM (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS sim FROM embeddings e, embeddings q WHERE q.vec_id = 0) ORDER BY sim DESC, vec_id LIMIT 30),
words AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM outcome ORDER BY rank LIMIT 30),
both_lists AS (SELECT id, rank, 1 AS k FROM words UNION ALL SELECT id, rank, 2 FROM vec)
SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, CASE WHEN count(*) = 2 THEN 'both' WHEN min(k) = 1 THEN 'keyword' ELSE 'semantic' END AS match FROM both_lists GROUP BY id""")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector lists fused by rank; how each result was found."""
    from lexarium.operators import vectors

    e = table(spark, sf_dir, "embeddings")
    near = vectors.topk(e, vectors.vector_of(e, 0), 30).select(F.col("vec_id").alias("id"), "rank")
    words = vectors.numbered(_ranked(spark, sf_dir, PLAIN).select(F.col("doc_id").alias("id"), F.round("score", 9).alias("score")), [F.col("score").desc(), F.col("id")], 30)
    lists = words.select("id", "rank", F.lit(1).alias("k")).unionAll(near.select("id", "rank", F.lit(2).alias("k")))
    how = F.when(F.count("*") == 2, "both").when(F.min("k") == 1, "keyword").otherwise("semantic")
    return lists.groupBy("id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"), how.alias("match"))


#: A query string, what it means to the language below, and the units that it must give (typed in for the SQL alone).
ASKED = "The Idiot, licensed under apache"
SPOKEN = queries.Language(aliases=queries.alias_groups(["idiot moron", "licensed under\tlicenced under"]))
MEANT = [Unit((("the",),), 0.15, False), Unit((("idiot",), ("moron",))), Unit((("licensed", "under"), ("licenced", "under"))), Unit((("apache",),))]
_MEANT_TITLE = " + ".join(f"CASE WHEN {' OR '.join(f'contains(t, {chr(39)} {chr(32).join(s)} {chr(39)})' for s in u.spellings)} THEN {float(u.weight)}::DOUBLE ELSE 0 END" for u in MEANT)
SEARCHED = f"WITH {TOK}, {LENGTHS}, {hits_sql(MEANT)}, {SCORED}, {GATED}, {NEAR}, {TITLE}, shown AS (SELECT doc_id, round(score * (1.0::DOUBLE + ({_MEANT_TITLE}) / (SELECT sum(weight) FROM units)), 6) AS score, source FROM outcome JOIN titles USING (doc_id) JOIN documents USING (doc_id) WHERE score >= 0.2::DOUBLE * (SELECT max(score) FROM outcome))"


@query(f"{SEARCHED} SELECT doc_id, score, source FROM shown")
def search_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results of a query string on the stored index: parsed, ranked, cut, raised by titles."""
    found, _ = queries.results(stored_index(spark, sf_dir), ASKED, SPOKEN)
    return found.select("doc_id", F.round("score", 6).alias("score"), "source")


@query(f"{SEARCHED} SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM shown GROUP BY source")
def facets_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by channel, the most first."""
    found, _ = queries.results(stored_index(spark, sf_dir), ASKED, SPOKEN)
    by = found.groupBy("source").agg(F.count("*").alias("n"))  # a row a channel
    return by.withColumn("place", F.row_number().over(W.orderBy(F.col("n").desc(), "source")).cast("long"))


@query("""SELECT 'suggested' AS what, 'idiot apache' AS value UNION ALL SELECT 'question', 'false' UNION ALL SELECT 'units', 'idiott|apache'""")
def search_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a misspelt query could have meant."""
    at = stored_index(spark, sf_dir)
    units = queries.parsed("Idiott apache")
    rows = [("suggested", queries.suggestion(at, "Idiott apache", units)), ("question", str(queries.is_question("Idiott apache", units)).lower()), ("units", "|".join(u.name for u in units))]
    return spark.createDataFrame(rows, "what string, value string")


#: The SQL of a set of queries of single words: asked (query, unit, name, weight, core) stands before it.
MANY = """hits AS (SELECT a.query, a.unit, t.doc_id, t.pos AS start FROM tok t JOIN asked a ON a.name = t.term),
counted AS (SELECT query, unit, doc_id, count(*)::DOUBLE AS tf FROM hits GROUP BY ALL),
wanted AS (SELECT query, sum(weight) AS total FROM asked GROUP BY query),
of_unit AS (SELECT a.query, a.unit, any_value(a.weight) AS weight, any_value(a.core) AS core, count(*)::DOUBLE AS df FROM counted c JOIN asked a ON a.query = c.query AND a.unit = c.unit GROUP BY ALL),
levels AS (SELECT query, count(*) FILTER (WHERE core AND 2 * df <= n) AS rare, count(*) FILTER (WHERE core) AS cores, count(*) AS every FROM of_unit, stats GROUP BY query),
opens AS (SELECT o.query, o.unit, o.weight, o.df, CASE WHEN rare > 0 THEN core AND 2 * df <= n WHEN cores > 0 THEN core ELSE true END AS gating FROM of_unit o JOIN levels USING (query), stats),
summed AS (SELECT c.query, c.doc_id, sum(weight * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 0.3::DOUBLE + 0.9::DOUBLE * length / avg_length)) * (0.1::DOUBLE + 0.9::DOUBLE * sum(weight) / any_value(total)) AS score, count(*) FILTER (WHERE gating) AS gate_hits
  FROM counted c JOIN opens o ON o.query = c.query AND o.unit = c.unit JOIN lengths ON lengths.doc_id = c.doc_id JOIN wanted w ON w.query = c.query, stats GROUP BY c.query, c.doc_id),
k_of AS (SELECT query, CASE WHEN rare > 0 THEN rare WHEN cores > 0 THEN cores ELSE every END AS k FROM levels),
needs AS (SELECT s.query, greatest(1, least(CASE WHEN any_value(k) < 3 THEN any_value(k) WHEN any_value(k) < 5 THEN 2 ELSE (any_value(k) + 1) // 2 END, max(gate_hits))) AS need FROM summed s JOIN k_of USING (query) GROUP BY s.query),
beside AS (SELECT DISTINCT b.query, b.doc_id FROM hits a JOIN hits b ON a.query = b.query AND a.doc_id = b.doc_id AND b.unit = a.unit + 1 AND b.start - (a.start + 1) BETWEEN 0 AND 2),
outcome AS (SELECT s.query, s.doc_id, score * CASE WHEN b.doc_id IS NULL THEN 1.0::DOUBLE ELSE 1.3::DOUBLE END AS score FROM summed s JOIN needs USING (query) LEFT JOIN beside b ON b.query = s.query AND b.doc_id = s.doc_id WHERE gate_hits >= need),
best AS (SELECT query, max(score) AS best FROM outcome GROUP BY query),
words_of_title AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(""" + LOWER.format("split_part(text, chr(10), 1)") + """, '[\\p{L}\\p{N}]+'))) AS name FROM documents),
in_title AS (SELECT a.query, t.doc_id, sum(a.weight) AS weight FROM asked a JOIN words_of_title t USING (name) GROUP BY ALL),
shown AS (SELECT o.query, o.doc_id, score * (1.0::DOUBLE + coalesce(i.weight, 0) / total) AS score FROM outcome o JOIN best USING (query) JOIN wanted USING (query) LEFT JOIN in_title i ON i.query = o.query AND i.doc_id = o.doc_id WHERE score >= 0.2::DOUBLE * best)"""
_INTENT = ", ".join(f"'{w}'" for w in sorted(queries.INTENT))
#: Query strings of the corpus: the first four words of each benchmark item.
ASKED_MANY = (
    "asked AS (SELECT query, (row_number() OVER (PARTITION BY query ORDER BY first))::INT - 1 AS unit, name, CASE WHEN name IN (" + _INTENT + ") THEN 0.15::DOUBLE ELSE 1.0::DOUBLE END AS weight, length(name) > 1 AND name NOT IN (" + _INTENT + ") AS core "
    "FROM (SELECT query, name, min(i) AS first FROM (SELECT item_id AS query, unnest(w[1:4]) AS name, generate_subscripts(w[1:4], 1) AS i FROM (SELECT item_id, regexp_extract_all(" + LOWER.format("text") + ", '[\\p{L}\\p{N}]+') AS w FROM benchmark)) GROUP BY query, name))"
)


def asked_many(spark: SparkSession, sf_dir: str) -> dict[int, str]:
    """Query strings by item: a set of queries is read on the driver, as all query strings are."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.slice(text.tokens("text"), 1, 4).alias("w")).collect()
    return {r.item_id: " ".join(r.w) for r in rows if r.w}


@query(f"WITH {TOK}, {LENGTHS}, {ASKED_MANY}, {MANY} SELECT query, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc_id) AS rank FROM shown) WHERE rank <= 10")
def search_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each of a set of query strings, from one scan of their postings."""
    found = queries.answered(stored_index(spark, sf_dir), asked_many(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return queries.first_of_each(found, 10).select(F.col("query").cast("long").alias("query"), "doc_id", "score", "rank")
