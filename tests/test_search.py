"""Query strings, the stored index, and search."""

import pytest
from pyspark.sql import functions as F

from lexarium.operators import index, queries, store
from lexarium.operators.ranking import Unit

DOCS = [
    (1, "Alpha report\nred fox and blue fish\nthe red river", "a"), (2, "Beta report\nblue river runs north", "b"), (3, "Gamma\nred fox sleeps; the red fox wakes", "a"),
    (4, "", "a"), (5, None, "b"), (6, "Delta\nnothing of it here", "b"), (6, "Delta\nsecond row of six", "b"),
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return store.build(spark.createDataFrame(DOCS, "doc_id long, text string, source string"), f"file://{tmp_path_factory.mktemp('index')}/s1")


def test_units_of_a_query():
    language = queries.Language(aliases=queries.alias_groups(["# names", "fox vulpes", "red river\tred stream"]))
    units = queries.parsed("The Red River fox fox?", language)
    assert units == [Unit((("the",),), 0.15, False), Unit((("red", "river"), ("red", "stream"))), Unit((("fox",), ("vulpes",)))]
    assert queries.is_question("Where is it", queries.parsed("Where is it")) and not queries.is_question("red fox", queries.parsed("red fox"))
    for bad in ("", "?!", "x" * 513, "a\0b", " ".join(f"w{k}" for k in range(65)), "y" * 65):
        with pytest.raises(ValueError):
            queries.parsed(bad)


def test_touching_fragments_form_phrases():
    one_by_one = queries.Language(words=lambda q: [(c, k, k + 1) for k, c in enumerate(q) if c.strip()], fragment=lambda w: w in "甲乙丙")
    units = queries.parsed("甲乙不好 丙", one_by_one)
    assert [u.spellings[0] for u in units] == [("甲", "乙", "不"), ("好",), ("丙",)] and units[0].core and not units[1].core
    assert [u.name for u in queries.split(units, one_by_one)] == ["不", "好", "丙"]


def test_index_is_whole(spark, stored):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string")
    assert {r.check: r.wrong for r in store.checks(stored, docs).collect()} == dict.fromkeys(("documents", "coverage", "lexicon", "lengths", "statistics", "positions", "texts"), 0)
    other = docs.where("doc_id <> 2").unionAll(spark.createDataFrame([(9, "new words", "a")], docs.schema))
    wrong = {r.check for r in store.checks(stored, other).where("wrong > 0").collect()}
    assert {"documents", "coverage"} <= wrong
    with pytest.raises(FileExistsError):
        store.build(docs, stored.at)


def test_failed_build_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "statistics", lambda of: of.agg(F.count("*").alias("n"), F.lit(-1.0).alias("avg_length")) if "_building" in str(of.inputFiles()) else of.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length")))
    monkeypatch.setattr(store, "checks", lambda s, d: spark.createDataFrame([("statistics", 1)], "check string, wrong long"))
    with pytest.raises(ValueError, match="statistics"):
        store.build(spark.createDataFrame(DOCS, "doc_id long, text string, source string"), f"file://{tmp_path}/s2")
    assert list(tmp_path.iterdir()) == []


def test_empty_table(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    at = store.build(none, f"file://{tmp_path}/s3")
    assert queries.search(at, "red fox").total == 0 and at.statistics.first().n == 0


def test_search(stored):
    found = queries.search(stored, "red fox")
    assert [r.doc_id for r in found.rows] == [3, 1] and found.total == 2 and found.suggestion is None and [(r.source, r.n) for r in found.by_source] == [("a", 2)]
    assert queries.search(stored, "red fox") is found  # kept
    assert [r.doc_id for r in queries.search(stored, "river", source="b").rows] == [2]
    second = queries.search(stored, "red fox", page=1, size=1)
    assert [r.doc_id for r in second.rows] == [1] and second.total == 2
    wrong = queries.search(stored, "blue rivr")
    assert queries.suggestion(stored, "blue rivr", wrong.units) == "blue river"
    joined = queries.Language(aliases=queries.alias_groups(["north blue\tsouth blue"]))
    assert {r.doc_id for r in queries.search(stored, "north blue", joined).rows} == {2}  # the phrase is nowhere, its words are


def test_pruned_postings(stored):
    plan = stored.postings.where(F.col("term").isin("red", "fox"))._jdf.queryExecution().toString()
    assert "In(term" in plan.replace(" ", "")


def test_languages_share_no_results(stored):
    one, two = (queries.Language(aliases=queries.alias_groups([line])) for line in ("fox\tfish", "fox\triver"))
    assert {r.doc_id for r in queries.search(stored, "fox", one).rows} == {1, 3} and {r.doc_id for r in queries.search(stored, "fox", two).rows} == {1, 2, 3}
    assert hash(one) != hash(two) and one != two


def test_search_gives_snippets(stored):
    found = queries.search(stored, "red river")
    assert [r.doc_id for r in found.rows] == [1] and [s.snippet[int(a) : int(b)] for s in found.snippets[1] for a, b in (m.split("-") for m in s.marks.split(","))] == ["red", "red", "river"]
