"""Builds of a tree of texts, one after the other."""

import hashlib

import pytest

from lexarium.functions import text
from lexarium.operators import builds, chunking, queries, segments
from lexarium.sources import files

SIZES = chunking.Sizes(target=20, most=40, least=3, overlap=0)


def embed(texts: list[str]) -> list[list[float]]:
    return [[b / 255 for b in hashlib.sha256(t.encode()).digest()[:4]] for t in texts]


def write(at, name: str, title: str, body: str, note: str = "") -> None:
    (at / name).parent.mkdir(parents=True, exist_ok=True)
    (at / name).write_text(f"# {title}\n\nPublished 2024-03-0{len(title) % 9 + 1}\n{note}\n## Body\n\n{body}\n\n## Appendix\n\nnot indexed\n")


@pytest.fixture
def tree(tmp_path):
    at = tmp_path / "tree"
    for k in range(4):
        write(at, f"news/{k:04d}.md", f"Report {k}", f"Common words of all reports here.\n\n## Part {k}\n\nThe red river number{k} flows north and south.")
    return at


def test_builds_in_turn(spark, tmp_path, tree):
    root = f"file://{tmp_path}/root"
    run = lambda **more: builds.run_once(spark, files.markdown_tree(spark, str(tree)), root, embed, sizes=SIZES, **more)
    first = run()
    assert first.published and first.work == {"reindex": 4} and first.embedded == 5  # the paragraph of all is embedded once
    assert builds.chunk_vectors(first.index).count() == 8 and {r.source for r in first.index.documents.select("source").collect()} == {"news"}
    again = run()
    assert not again.published and again.index.number == 1 == segments.current(spark, root).number
    write(tree, "news/0001.md", "Report 1", "Common words of all reports here.\n\n## Part 1\n\nA blue lake lies still and cold.")
    write(tree, "news/0002.md", "Report 2", "Common words of all reports here.\n\n## Part 2\n\nThe red river number2 flows north and south.", note="a new note")
    (tree / "news/0003.md").unlink()
    third = run()
    assert third.work == {"reindex": 1, "render": 1, "remove": 1} and third.embedded == 1 and third.index.number == 2
    assert sorted(r.doc_id for r in queries.search(third.index, "red river").rows) == ["news/0000.md", "news/0002.md"]
    found = queries.search(third.index, "blue lake", year=2024)
    assert [r.doc_id for r in found.rows] == ["news/0001.md"] and "blue lake" in found.snippets["news/0001.md"][0].snippet and queries.search(third.index, "blue lake", year=1999).total == 0
    assert builds.chunk_vectors(third.index).count() == 6
    assert sorted((r.doc_id[-7:], r.work, r.build) for r in builds.audit(third.index).where("build = 2").collect()) == [("0001.md", "reindex", 2), ("0002.md", "render", 2), ("0003.md", "remove", 2)]
    renamed = run(titles=spark.createDataFrame([("news/0000.md", "The first report")], "doc_id string, title string"))
    assert renamed.work == {"render": 1} and renamed.embedded == 0 and [r.title for r in renamed.index.documents.where("doc_id LIKE '%0000.md'").collect()] == ["The first report"]


def test_a_build_that_fails_leaves_nothing(spark, tmp_path, tree):
    root = f"file://{tmp_path}/root"
    run = lambda how=embed, **more: builds.run_once(spark, files.markdown_tree(spark, str(tree)), root, how, sizes=SIZES, **more)
    base = run().index
    before = sorted(p.name for p in (tmp_path / "root").iterdir())
    write(tree, "news/0001.md", "Report 1", "Other words stand in it now, enough of them.")
    with pytest.raises(Exception, match="model"):
        run(lambda texts: (_ for _ in ()).throw(RuntimeError("no model")))
    assert sorted(p.name for p in (tmp_path / "root").iterdir()) == before
    run()
    before = sorted(p.name for p in (tmp_path / "root").iterdir())
    with pytest.raises(segments.LostRaceError):
        run(base=base)
    assert sorted(p.name for p in (tmp_path / "root").iterdir()) == before
    write(tree, "news/0001.md", "Report 1", "# a deep fault\n\nwords")
    with pytest.raises(ValueError, match=r"news/0001.md \(level-one heading\)"):
        run()


def test_a_body_is_cut_out_once(spark):
    """Its lines are split and looked through once, however often its parts are used."""
    assert str(text.body("raw")).count("split(") == 1
    odd = ["a\r\n ## Body \rx\n\ty\r## Appendix\nz", "## Body", "x", None, "## Appendix\n## Body\n\n## Body\nq\n \x0b## Appendix\f\n", "## Body\n a \n## Appendix \nb\n## Appendix"]
    found = spark.createDataFrame(list(enumerate(odd)), "n int, raw string").orderBy("n").select(text.body("raw").alias("body")).collect()
    assert [r.body for r in found] == ["x\n\ty", "", "", "", "\n## Body\nq", " a "]
