"""Ranked keyword search as one plan, for one query or a set of them: gate, BM25, coverage, proximity, titles, cutoff.

Postings are read once for all queries of a set and meet once, by document; what a document has of a query is then one row
(units with their frequencies and places), and phrases, frequencies, scores and proximity are computed inside it. Document
frequencies and gates are small aggregates over these rows, which Spark computes from the same exchange.

A query is at most 64 units (`check`) and a set at most QUERIES queries, so the frames made of them are small by construction and
are broadcast. Places are a line times LINE plus a token's number in it, or, for analyzers whose words overlap, its first
character; a unit then says where its words begin (`offsets`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarium.operators.index import LINE
from lexarium.sources import shared

#: Fixed values of the ranking.
K1, B, COMMON_SHARE, COVERAGE_FLOOR, PROXIMITY_BONUS, NEAR_TOKENS, NEAR_CHARACTERS, RELATIVE_CUTOFF, TITLE_BONUS = 1.2, 0.75, 0.5, 0.1, 1.3, 2, 12, 0.2, 1.0
MAX_UNITS, MAX_TERM = 64, 64
#: Queries of one plan.
QUERIES = 1000


@dataclass(frozen=True)
class Unit:
    """A query word or phrase: its spellings (each a tuple of words), weight, and whether it is core. offsets: of each spelling
    where its words begin, in characters; without them words are counted."""

    spellings: tuple[tuple[str, ...], ...]
    weight: float = 1.0
    core: bool = True
    offsets: tuple[tuple[int, ...], ...] | None = None
    text: str | None = None

    @property
    def name(self) -> str:
        return self.text if self.text is not None else " ".join(self.spellings[0])

    def placed(self, spelling: int) -> tuple[list[tuple[int, str]], int]:
        """(place, word) of a spelling's words, and its length."""
        words = self.spellings[spelling]
        if self.offsets is None:
            return list(enumerate(words)), len(words)
        at = self.offsets[spelling]
        return list(zip(at, words, strict=True)), at[-1] + len(words[-1])


def check(units: list[Unit]) -> list[Unit]:
    if not 1 <= len(units) <= MAX_UNITS or any(len(u.name) > MAX_TERM or "\0" in u.name for u in units):
        raise ValueError("a query has 1 to 64 units of at most 64 characters")
    return units


Asked = dict[int, list[Unit]]


def units_frame(spark: SparkSession, asked: Asked) -> DataFrame:
    """query, total (weight of all units), unit, name, weight, core."""
    rows = [(q, float(sum(u.weight for u in units)), k, u.name, float(u.weight), u.core) for q, units in asked.items() for k, u in enumerate(check(units))]
    return F.broadcast(spark.createDataFrame(rows, "query int not null, total double, unit int not null, name string, weight double, core boolean"))


def parts_frame(spark: SparkSession, asked: Asked) -> DataFrame:
    rows = [(q, k, v, len(s), u.placed(v)[1], at, word) for q, units in asked.items() for k, u in enumerate(units) for v, s in enumerate(u.spellings) for at, word in u.placed(v)[0]]
    return F.broadcast(spark.createDataFrame(rows, "query int not null, unit int not null, variant int, n_parts int, length int, at int, term string"))


def found(postings: DataFrame, asked: Asked) -> DataFrame:
    """query, unit, variant, doc_id, n_parts, length, starts: where each spelling stands, dealt by document.

    A phrase's places are those of its rarest word that all others share, each shifted by its own place in the phrase. Rows without an
    id have no document to rank."""
    if len(asked) > QUERIES:
        raise ValueError(f"a set has at most {QUERIES} queries")
    return _placed(postings, asked)


def _placed(postings: DataFrame, asked: Asked) -> DataFrame:
    words = sorted({w for units in asked.values() for u in units for s in u.spellings for w in s})
    rows = postings.where(F.col("term").isin(words) & F.col("doc_id").isNotNull()).join(parts_frame(postings.sparkSession, asked), "term")
    rows = rows.select("query", "unit", "variant", "n_parts", "length", "at", "doc_id", "positions").repartition("doc_id")
    both = rows.groupBy("doc_id", "query", "unit", "variant", "n_parts", "length").agg(F.sort_array(F.collect_list(F.struct(F.size("positions").alias("size"), "at", "positions"))).alias("parts"))
    shifted = lambda p: F.transform(p["positions"], lambda x: x - p["at"])
    first = F.col("parts")[0]
    starts = F.when(F.col("n_parts") == 1, first["positions"]).otherwise(F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(1))), shifted(first), lambda s, p: F.array_intersect(s, shifted(p))))
    return both.where(F.size("parts") == F.col("n_parts")).select("query", "unit", "variant", "doc_id", "n_parts", "length", F.array_sort(starts).alias("starts")).where(F.size("starts") > 0)


def hits(postings: DataFrame, units: list[Unit]) -> DataFrame:
    """found() of one query."""
    return found(postings, {0: units}).drop("query")


def matched(places: DataFrame) -> DataFrame:
    """doc_id, query, units (unit, tf, spots: length and starts of each spelling) of found(): a row for each document of a query."""
    by_unit = places.groupBy("doc_id", "query", "unit").agg(F.sum(F.size("starts")).cast("double").alias("tf"), F.collect_list(F.struct("length", "starts")).alias("spots"))
    return by_unit.groupBy("doc_id", "query").agg(F.sort_array(F.collect_list(F.struct("unit", "tf", "spots"))).alias("units"))


def _frequencies(of: DataFrame) -> DataFrame:
    """query, unit, df of matched()."""
    # spots are asked for, which no unit lacks: what is read here is then what the scores read, and comes from the same exchange
    units = of.select("query", F.explode("units").alias("u")).where(F.size("u.spots") > 0).select("query", "u.unit")
    return units.groupBy("query", "unit").agg(F.count("*").cast("double").alias("df"))  # at most a row a unit


def _gates(df: DataFrame, stats: DataFrame, asked: Asked) -> DataFrame:
    """query, total, n, avg_length, k (gating units), by_unit (name, weight, idf, gating by unit): a row a query. df: query, unit, df."""
    ranked = df.join(units_frame(df.sparkSession, asked), ["query", "unit"]).crossJoin(F.broadcast(stats))
    tier = F.when(F.col("core") & (F.col("df") <= COMMON_SHARE * F.col("n")), 1).when(F.col("core"), 2).otherwise(3)
    gating = (F.col("tier") == F.min("tier").over(W.partitionBy("query"))).cast("int")
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = ranked.withColumn("tier", tier).select("query", "total", "avg_length", "unit", "name", "weight", idf.alias("idf"), gating.alias("gating"))
    return rows.groupBy("query").agg(F.first("total").alias("total"), F.first("avg_length").alias("avg_length"), F.sum("gating").alias("k"), F.map_from_entries(F.collect_list(F.struct("unit", F.struct("name", "weight", "idf", "gating")))).alias("by_unit"))


def _is_near(units: Column, within: int) -> Column:
    """A unit begins at most `within` after an end of the unit before it, on one line."""
    reach = lambda u: F.flatten(F.transform(u["spots"], lambda s: F.flatten(F.transform(s["starts"], lambda x: F.sequence(x + s["length"], x + s["length"] + within)))))
    begins = lambda u: F.flatten(F.transform(u["spots"], lambda s: s["starts"]))
    pairs = F.sequence(F.lit(1), F.size(units) - 1)
    return (F.size(units) > 1) & F.exists(F.when(F.size(units) > 1, pairs).otherwise(F.array().cast("array<int>")), lambda i: (F.get(units, i)["unit"] == F.get(units, i - 1)["unit"] + 1) & F.arrays_overlap(reach(F.get(units, i - 1)), begins(F.get(units, i))))


def near(places: DataFrame, units: list[Unit], within: int = NEAR_TOKENS) -> DataFrame:
    """doc_id of documents where neighbouring units stand close. places: hits() of the units."""
    return matched(places.withColumn("query", F.lit(0))).where(_is_near(F.col("units"), within)).select("doc_id")


def scored(of: DataFrame, lengths: DataFrame, stats: DataFrame, asked: Asked, gate: bool = True, within: int | None = None) -> DataFrame:
    """query, doc_id, score, gate_hits, terms (matched names in query order) of matched(). Without gate every match counts; with
    `within` close units raise the score."""
    out = _scores(of, lengths, _gates(_frequencies(of), stats, asked), within)
    if not gate:
        return out.drop("k")
    required = _required(out.groupBy("query").agg(F.max("gate_hits").alias("most"), F.first("k").alias("k")))
    return out.drop("k").join(F.broadcast(required), "query").where(F.col("gate_hits") >= F.col("required")).drop("required")


def _required(most: DataFrame) -> DataFrame:
    """query, required: how many gating units a document must have. most: query, k (gating units), most (of a document)."""
    need = F.when(F.col("k") <= 2, F.col("k")).when(F.col("k") <= 4, F.lit(2)).otherwise(F.ceil(F.col("k").cast("double") / 2.0))
    return most.select("query", F.greatest(F.lit(1), F.least(need, F.col("most"))).alias("required"))


def _scores(of: DataFrame, lengths: DataFrame, gates: DataFrame, within: int | None) -> DataFrame:
    """query, doc_id, score, gate_hits, terms, k of matched()."""
    own = lambda u: F.element_at("by_unit", u["unit"])
    part = lambda u: own(u)["weight"] * own(u)["idf"] * u["tf"] * (K1 + 1) / (u["tf"] + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    total = lambda f: F.aggregate("units", F.lit(0.0), lambda s, u: s + f(u))
    score = total(part) * (COVERAGE_FLOOR + (1 - COVERAGE_FLOOR) * total(lambda u: own(u)["weight"]) / F.col("total"))
    if within is not None:
        score = score * F.when(_is_near(F.col("units"), within), PROXIMITY_BONUS).otherwise(1.0)
    hit = F.aggregate("units", F.lit(0), lambda s, u: s + own(u)["gating"]).cast("long")
    return of.join(lengths, "doc_id").join(F.broadcast(gates), "query").select("query", "doc_id", score.alias("score"), hit.alias("gate_hits"), F.transform("units", lambda u: own(u)["name"]).alias("terms"), "k")


def scores(places: DataFrame, lengths: DataFrame, stats: DataFrame, units: list[Unit], gate: bool = True) -> DataFrame:
    """doc_id, score, gate_hits, terms of hits() of one query."""
    return scored(matched(places.withColumn("query", F.lit(0))), lengths, stats, {0: units}, gate).drop("query")


def ranked_many(postings: DataFrame, lengths: DataFrame, stats: DataFrame, asked: Asked, within: int = NEAR_TOKENS) -> DataFrame:
    """query, doc_id, score, gate_hits, terms of a set of queries, from one scan of their postings.

    What documents have of a unit is found once for all queries that ask for it. Frequencies and so gates follow from that alone; only
    documents that pass a query's gate are then given what they have of its units, and scored."""
    if len(asked) > QUERIES:
        raise ValueError(f"a set has at most {QUERIES} queries")
    spark, kinds = postings.sparkSession, {}
    listed = [(q, k, kinds.setdefault((u.spellings, u.offsets), len(kinds))) for q, units in asked.items() for k, u in enumerate(check(units))]
    of_query = F.broadcast(spark.createDataFrame(listed, "query int not null, unit int not null, kind int not null"))
    held = _placed(postings, {n: [Unit(spellings, offsets=offsets)] for (spellings, offsets), n in kinds.items()}).withColumnRenamed("query", "kind")
    held = shared.staged(held.groupBy("doc_id", "kind").agg(F.sum(F.size("starts")).cast("double").alias("tf"), F.collect_list(F.struct("length", "starts")).alias("spots")))
    df = held.groupBy("kind").agg(F.count("*").cast("double").alias("df")).join(of_query, "kind").select("query", "unit", "df")
    gates = shared.staged(_gates(df, stats, asked))  # a row a query
    gating = gates.select("query", "k", F.explode("by_unit").alias("unit", "u")).where("u.gating = 1").join(of_query, ["query", "unit"]).select("query", "k", "kind")
    passing = held.select("doc_id", "kind").join(F.broadcast(gating), "kind").groupBy("query", "doc_id").agg(F.count("*").alias("gate_hits"), F.first("k").alias("k"))
    required = _required(passing.groupBy("query").agg(F.max("gate_hits").alias("most"), F.first("k").alias("k")))
    passed = passing.join(F.broadcast(required), "query").where(F.col("gate_hits") >= F.col("required")).select("query", "doc_id")
    own = held.join(passed.join(of_query, "query"), ["doc_id", "kind"])
    of = own.groupBy("doc_id", "query").agg(F.sort_array(F.collect_list(F.struct("unit", "tf", "spots"))).alias("units"))
    return _scores(of, lengths, gates, within).drop("k")


def ranked(postings: DataFrame, lengths: DataFrame, stats: DataFrame, units: list[Unit], within: int = NEAR_TOKENS) -> DataFrame:
    """doc_id, score, gate_hits, terms with gate, coverage and proximity. Stored postings are pruned to the query's few words."""
    asked = {0: units}
    return scored(matched(found(postings, asked)), lengths, stats, asked, within=within).drop("query")


def cut_many(results: DataFrame, share: float = RELATIVE_CUTOFF) -> DataFrame:
    """Results of at least that share of their query's best score."""
    best = results.groupBy("query").agg(F.max("score").alias("best"))
    return results.join(F.broadcast(best), "query").where(F.col("score") >= share * F.col("best")).drop("best")


def with_titles_many(results: DataFrame, titles: DataFrame, asked: Asked) -> DataFrame:
    """query, doc_id, score times 1 + the share of the units' weight that the title has; titles (doc_id, title_terms) never add results."""
    rows = [(q, float(sum(u.weight for u in units)), [(float(u.weight), [list(s) for s in u.spellings]) for u in units]) for q, units in asked.items()]
    spelled = F.broadcast(results.sparkSession.createDataFrame(rows, "query int, total double, spelled array<struct<weight:double,ways:array<array<string>>>>"))
    terms = F.coalesce("title_terms", F.array().cast("array<string>"))
    places = lambda n: F.sequence(F.lit(1), F.greatest(F.size(terms) - n + 1, F.lit(1)))
    has = lambda way: F.exists(places(F.size(way)), lambda i: F.slice(terms, i, F.size(way)) == way)
    weight = F.aggregate("spelled", F.lit(0.0), lambda s, u: s + F.when(F.exists(u["ways"], has), u["weight"]).otherwise(0.0))
    return results.join(titles, "doc_id", "left").join(spelled, "query").select("query", "doc_id", (F.col("score") * (1.0 + TITLE_BONUS * weight / F.col("total"))).alias("score"))


def cut(results: DataFrame, share: float = RELATIVE_CUTOFF) -> DataFrame:
    """Results of at least that share of the best score."""
    best = results.agg(F.max("score").alias("best"))
    return results.crossJoin(F.broadcast(best)).where(F.col("score") >= share * F.col("best")).drop("best")


def with_titles(results: DataFrame, titles: DataFrame, units: list[Unit]) -> DataFrame:
    """with_titles_many() of one query."""
    return with_titles_many(results.withColumn("query", F.lit(0)), titles, {0: units}).drop("query")


def fused(*lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (id, rank) lists: id, score."""
    one = lists[0]
    for other in lists[1:]:
        one = one.unionByName(other)
    return one.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


__all__ = ["LINE", "Unit", "check", "cut", "cut_many", "found", "fused", "hits", "matched", "near", "ranked", "ranked_many", "scored", "scores", "with_titles", "with_titles_many"]
