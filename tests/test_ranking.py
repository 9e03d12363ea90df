"""Ranking of sets of queries, and of very long texts."""

import re
import time

import numpy as np
import pytest

from lexarium.operators import queries, ranking, segmentation, snippets, store
from lexarium.operators.ranking import Unit


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    draw = np.random.default_rng(4)
    words = ["red", "river", "fox", "vixen", "the", "blue", "fish", "\n", "stone", "licensed", "under"]
    rows = [(k, " ".join(draw.choice(words, draw.integers(0, 60))), "ab"[k % 2]) for k in range(120)]
    return store.build(spark.createDataFrame(rows, "doc_id long, text string, source string"), f"file://{tmp_path_factory.mktemp('ranking')}/s1")


def test_a_set_is_its_queries_one_by_one(stored):
    language = queries.Language(aliases=queries.alias_groups(["fox\tvixen", "licensed under\tred stone"]))
    asked = {1: "red river", 4: "the fox, licensed under blue", 2: "zzz", 9: "stone stone vixen", 7: "the"}
    many = {(r.query, r.doc_id): round(r.score, 9) for r in queries.answered(stored, asked, language).collect()}
    one = {(q, r.doc_id): round(r.score, 9) for q, text in asked.items() for r in queries.results(stored, text, language)[0].collect()}
    assert many == one and {q for q, _ in many} == {1, 4, 7, 9}
    first = queries.first_of_each(queries.answered(stored, asked, language), 3).collect()
    for q in (1, 4, 7, 9):
        want = sorted((-s, d) for (k, d), s in many.items() if k == q)[:3]
        assert sorted((r.rank, r.doc_id) for r in first if r.query == q) == [(k + 1, d) for k, (_, d) in enumerate(want)]


def test_sets_are_bounded(stored, monkeypatch):
    monkeypatch.setattr(ranking, "QUERIES", 2)
    got = {r.query for r in queries.answered(stored, {1: "red", 2: "river", 3: "fox"}).collect()}
    assert got == {1, 2, 3}
    with pytest.raises(ValueError, match="at most 2"):
        ranking.found(stored.postings, {k: [Unit((("red",),))] for k in range(3)})


def test_the_plan_reads_postings_once(stored):
    plan = ranking.ranked(stored.postings, stored.lengths, stored.statistics, queries.parsed("red river fox the stone"))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[term", final)) == 1 and "CartesianProduct" not in final


def test_a_set_finds_a_unit_once_for_all_its_queries(stored, monkeypatch):
    """What documents have is found before queries are told apart, and only what passes a query's gate is scored."""
    found, scored = [], []
    placed, scores = ranking._placed, ranking._scores
    monkeypatch.setattr(ranking, "_placed", lambda postings, asked: found.append(len(asked)) or placed(postings, asked))
    monkeypatch.setattr(ranking, "_scores", lambda of, *more: scored.append(of) or scores(of, *more))
    asked = {q: queries.parsed("the red river" if q % 2 else "the red fox") for q in range(40)}
    got = ranking.ranked_many(stored.postings, stored.lengths, stored.statistics, asked).collect()
    assert found == [4] and scored[0].count() == len(got) < 40 * stored.documents.count()
    one = {(r.doc_id, round(r.score, 9)) for r in ranking.ranked(stored.postings, stored.lengths, stored.statistics, asked[1]).collect()}
    assert one == {(r.doc_id, round(r.score, 9)) for r in got if r.query == 39}


def test_phrases_in_a_long_text_are_linear(spark):
    n = 100_000
    places = list(range(0, 2 * n, 2))
    rows = [("a", 1, n, places), ("b", 1, n, [p + 1 for p in places]), ("a", 2, 1, [5]), ("b", 2, 1, [7])]
    postings = spark.createDataFrame(rows, "term string, doc_id long, tf long, positions array<long>").coalesce(1)
    unit = [Unit((("a", "b", "a"),))]
    ranking.hits(postings.where("doc_id = 2"), unit).collect()
    began = time.time()
    got = {r.doc_id: len(r.starts) for r in ranking.hits(postings, unit).collect()}
    assert got == {1: n - 1} and time.time() - began < 10  # seconds of a busy machine; it was 15.8 for a third of the places


def test_places_by_character(spark):
    """Phrases of overlapping words: each word stands where the phrase has it."""
    own = segmentation.with_dictionary([("房地产", 5000), ("地产", 4000), ("税", 30000), ("收", 10)])
    rows = [(r.term, r.doc_id, r.tf, r.positions) for r in segmentation.postings(spark.createDataFrame([(1, "房地产税收"), (2, "税 地产")], "doc_id long, text string"), own).collect()]
    postings = spark.createDataFrame(rows, "term string, doc_id long, tf long, positions array<long>")
    units = queries.parsed("税收", queries.language_of(own))
    assert units == [Unit((("税", "收"),), offsets=((0, 1),), text="税收")]
    assert [(r.doc_id, r.starts, r.length) for r in ranking.hits(postings, units).collect()] == [(1, [3], 2)]


def test_snippets_of_many_hits_are_linear():
    text = "needle hay. " * 16_000
    began = time.time()
    found = snippets.windows(text, [(("needle",), 1.0), (("hay",), 0.5)])
    assert len(found) == snippets.WINDOWS and found[0][0] == 0 and time.time() - began < 5
    assert all(text[a:b][x:y] in ("needle", "hay") for a, b, marks in found for x, y in marks)
