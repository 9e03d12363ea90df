"""Citations by name, evaluation, lists and model hooks on small inputs."""

import pytest

from lexarium.operators import anchors, catalogue, citations, evaluation

A, B = "[[Tea]](/read/t.md#x)", "[[Sea]](/read/s.md)"
LINKS = {"t.md": ("t.md", A), "Tea": ("t.md", A), "t.md#x": ("t.md", A), "t.md#y": ("t.md", "[[Tea]](/read/t.md#y)"), "Sea": ("s.md", B)}


def test_links_of_names():
    sections = {"t.md": {"x": "green leaves", "y": "black pots"}}
    assert citations.linked("On black pots it says so. [[Tea]] And `[[Sea]]`", LINKS, sections)[0] == f"On black pots it says so（[[Tea]](/read/t.md#y)）. And（{B}）"
    assert citations.linked("So it is [[Nobody]].", LINKS, {})[0] == "So it is [[Nobody]]."
    assert citations.linked("It is so.《Tea》", LINKS, {}) == (f"It is so（{A}）.", 1)
    assert citations.section_of("x", {}) is None and citations.section_of("x", {"a": "b"}) == "a" and citations.section_of("", {"a1": "b", "c1": "d"}) is None


def test_runs_of_links():
    assert citations.without_repeats(f"{A} {A} {B} {A}") == f"{A} {B}"
    one = citations.once_a_run(f"One. {A} Two. {A} Three. {B}")
    assert one == f"One. Two. {A} Three. {B}"
    assert citations.once_a_run(f"One. {A}\n\nTwo. {A}") == f"One. {A}\n\nTwo. {A}" and citations.once_a_run(f"- {A}\n- {A}") == f"- {A}\n- {A}"
    placed = citations.in_sentences(f"One! {A} Two ({B}).\n1. {A}")
    assert placed == f"One（{A}）! Two ({B}).\n1. {A}" and citations.in_sentences(placed) == placed


def test_citation_map_of_odd_rows(spark):
    rows = [("a.md", "T", "H", "h", 0.5, 0), ("a.md", "T", "G", "g", 0.9, 1), ("b.md", None, None, "", None, 2), ("c.md", "T", "H", "h", 0.1, 3)]
    chunks = spark.createDataFrame(rows, "doc_id string, title string, heading string, anchor string, similarity double, place long")
    got = {r.spelling: r.link for r in citations.citation_map(chunks).collect()}
    assert got["T"] == got["a.md"] == got["a.md#g"] == "[[T]](/read/a.md#g)" and got["b.md"] == "[[b.md]](/read/b.md)" and got["T#h"] == "[[T]](/read/a.md#h)"
    assert citations.citation_map(chunks.limit(0)).count() == 0


def test_history_and_models(spark, tmp_path):
    root = f"file://{tmp_path}"
    evaluation.record_run(spark, root, {"at": 1, "recall": 0.5})
    evaluation.record_run(spark, root, {"at": 2, "recall": 0.7})
    assert {(r.at, r.recall) for r in evaluation.history(spark, root, "at int, recall double").collect()} == {(1, 0.5), (2, 0.7)}

    def embed(texts):
        return [[float(len(t)), 1.0] for t in texts]

    docs = spark.createDataFrame([(f"c{k}", "x" * k) for k in range(9)], "chunk_id string, text string")
    vectors = evaluation.embedded(docs, embed)
    assert evaluation.same_model(vectors, embed) and not evaluation.same_model(vectors, lambda ts: [[-1.0, 1.0] for _ in ts])
    results = spark.createDataFrame([(k, 1.0 - k / 10, "x" * k) for k in range(6)], "doc_id long, score double, text string")
    got = evaluation.reranked(results, lambda ts: [len(t) / 10 for t in ts], head=3).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 1, 0, 3, 4, 5]


def test_queries_without_results_count(spark):
    truth = spark.createDataFrame([("q", 1), ("q", 2), ("r", 1)], "query string, doc_id long")
    ranked = spark.createDataFrame([("q", 2, 2), ("q", 3, 1), ("z", 1, 1)], "query string, doc_id long, rank int")
    got = {r.query: r for r in evaluation.search_quality(ranked, truth).collect()}
    assert set(got) == {"q", "r"} and (got["q"].precision, got["q"].recall, got["q"].mrr) == (0.5, 0.5, 0.5) and got["r"].recall == 0 and got["r"].hit_20 == 0


def test_lists(spark):
    docs = spark.createDataFrame([(1, "a", "2020-01-02"), (2, "b", None), (3, "c", "2021-13-01"), (4, "d", "2021-05-05")], "doc_id long, title string, published string")
    chunks = spark.createDataFrame([("c1", 4, 1, "Z", "z", "t1"), ("c2", 4, 0, "Y", "y", "t2"), ("c3", 4, 2, "Y", "y", "t3"), ("c4", 9, 0, None, "", "t4")], "chunk_id string, doc_id long, chunk_index int, heading string, heading_anchor string, text string")
    assert [r.doc_id for r in catalogue.archive(docs).collect()] == [4, 1, 3, 2]
    assert {r.doc_id: r.headings for r in catalogue.newest(docs, chunks, 3).collect()} == {3: [], 4: ["Y", "Z"], 1: []}
    assert {r.chunk_id: r.title for r in catalogue.with_documents(chunks, docs).collect()} == {"c1": "d", "c2": "d", "c3": "d", "c4": None}
    assert {tuple(r) for r in catalogue.texts_of(chunks, ["c2", "c9"]).collect()} == {("c2", "t2")} and catalogue.by_key(docs, "published", None).count() == 1
    assert catalogue.sample(docs, "doc_id", 2).collect() == catalogue.sample(docs, "doc_id", 2).collect()
    with pytest.raises(ValueError):
        catalogue.texts_of(chunks, ["c"] * 1001)


def test_fragments_are_encoded_alike(spark):
    names = ["a b", "x*~'()!", "Größe-1", "北京/50%", "a+b&c=d#e", "-._"]
    got = spark.createDataFrame([(n,) for n in names], "name string").select(anchors.encoded_column("name").alias("to")).collect()
    assert [r.to for r in got] == [anchors.encoded(n) for n in names]


def test_answers_are_linked_by_scope(spark):
    answers_ = spark.createDataFrame([("1", "It fell [[Report]]. It rose [[Report]]. [[Unknown]] stays.", "s"), ("2", "None here", "t"), ("3", None, "t")], "id string, answer string, scope string")
    spellings = spark.createDataFrame([("s", "Report", "d1", "[[Report]](/read/d1)"), ("t", "Report", "d2", "[[Report]](/read/d2)")], "scope string, spelling string, doc_id string, link string")
    sections = spark.createDataFrame([("s", "d1", "", None)], "scope string, doc_id string, anchor string, heading string")
    got = {r.id: (r.answer, r.changed) for r in citations.linked_answers(answers_, spellings, sections).collect()}
    assert got["1"] == ("It fell. It rose（[[Report]](/read/d1)）. [[Unknown]] stays.", 2) and got["2"] == ("None here", 0) and got["3"] == ("", 0)
