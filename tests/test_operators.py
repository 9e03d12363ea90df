"""Sequential functions and plans on small inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lexarium.functions import text
from lexarium.operators import anchors, chunking, citations, index, paging, projection, ranking, snapshots, snippets
from lexarium.operators.ranking import Unit


def test_sections_and_preamble():
    assert chunking.sections("a\n## B\nc\n## D\n") == [(None, "a\n"), ("B", "## B\nc\n"), ("D", "## D\n")]
    assert chunking.sections("### no") == [(None, "### no")]


def test_packing_flushes_and_overlaps():
    text_ = "\n\n".join(f"{'word ' * 5}p{'x' * (k + 1)}." for k in range(6))
    found = chunking.pack(text_, chunking.Sizes(target=12, most=12, least=1, overlap=6))
    assert len(found) > 2 and all(f for f in found)
    assert found[1].startswith(chunking.tail(found[0], 6))
    assert chunking.pack("short one", chunking.Sizes()) == ["short one"]


def test_chunks_number_kept_ones(spark):
    docs = spark.createDataFrame([(1, "a b\n## H\n" + "w " * 60), (2, None)], "doc_id long, text string")
    got = chunking.chunks(docs).collect()
    assert [(r.chunk_id, r.heading) for r in got] == [("1_chunk_000", "H")]


def test_anchors():
    assert anchors.slug("## **A [b](c) d**") == "A-b-d"
    assert anchors.unique(["x", "x-2", "x", "", ""]) == ["x", "x-2", "x-3", "", ""]
    assert anchors.slug("`a b`") == "a-b" and anchors.slug("**a** and **b**") == "**a**-and-**b**" and anchors.unique(["a"] * 3 + ["a-2"]) == ["a", "a-2", "a-3", "a-2-2"]
    assert anchors.rewritten("../b.md#q", "x/y/a.md", "old.example") == "/read/x/b.md#q"
    assert anchors.rewritten("../../../b.md", "x/a.md", "old.example") is None
    assert anchors.rewritten("javascript:1", "a.md", "h") is None
    assert anchors.rewritten("https://h/p", "a.md", "h") == "/read/p"


def test_citations_twice_is_once():
    a = citations.tidy("One. [doc: 1] [1] Two `[2]` [9].", {1, 2})
    assert a == citations.tidy(a, {1, 2}) and "[9]" not in a and "[1]." in a


def test_snippets_mark_terms():
    needle = [(("needle",), 1.0), (("sharp", "pin"), 1.0), (("the",), 0.15)]
    text_ = "x" * 100 + " needle " + "y" * 100
    (a, b, marks), *_ = snippets.windows(text_, needle)
    assert [text_[a + s : a + e] for s, e in marks] == ["needle"]
    assert snippets.windows("none", needle) == snippets.windows("", needle) == snippets.windows("moderate needles", needle) == []
    far = "the " * 60 + "A needle lies here! " + "filler words go on " * 20 + "and a sharp pin there. " + "end " * 50
    best = snippets.windows(far, needle)
    assert "needle" in far[best[0][0] : best[0][1]] and any("sharp pin" in far[a:b] for a, b, _ in best) and len(best) <= 3
    two = "one needle" + " z" * 10 + "second needle"
    cut = two.index("second")
    for a, b, _ in snippets.windows(two, needle, [(0, cut), (cut, len(two))]):
        assert b <= cut or a >= cut


def test_body_title_and_uri(spark):
    df = spark.createDataFrame([("# *T* [l](u)\nx\n## Body\nb1\nb2\n## Appendix\nz", "a/b.md"), ("no", "../b.md")], "t string, u string")
    got = df.select(text.body("t").alias("b"), text.title("t").alias("h"), text.valid_uri("u").alias("ok")).collect()
    assert got[0].b == "b1\nb2" and got[0].ok and got[1].b == "" and not got[1].ok


def test_gate_wants_rare_units(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "red"), (3, "red dog"), (4, None), (5, "")], "doc_id long, text string")
    tok = index.tokens(docs)
    n = index.lengths(tok)
    units = [Unit((("red",),)), Unit((("fox",),))]
    got = ranking.ranked(index.postings(tok), n, index.statistics(n), units).collect()
    assert [r.doc_id for r in got] == [1]  # red is in more than half of the documents, so fox gates


def test_phrase_stays_on_a_line(spark):
    docs = spark.createDataFrame([(1, "new york"), (2, "new\nyork")], "doc_id long, text string")
    got = ranking.hits(index.postings(index.tokens(docs)), [Unit((("new", "york"),))]).collect()
    assert [r.doc_id for r in got] == [1]


def test_query_limits():
    with pytest.raises(ValueError):
        ranking.check([])
    with pytest.raises(ValueError):
        ranking.check([Unit((("x" * 65,),))])


def test_publish_is_whole(spark, tmp_path):
    df = spark.range(3)
    at = snapshots.publish({"a": df, "b": df.select(F.col("id") + 1)}, str(tmp_path), "s1")
    assert snapshots.open_snapshot(spark, at, "a").count() == 3
    with pytest.raises(FileExistsError):
        snapshots.publish({"a": df}, str(tmp_path), "s1")
    assert len(snapshots.fingerprint(1, "x")) == 16


REG = "snapshot_id string, lineage string, embedding_space string, format_version int, status string, pinned boolean, published_at timestamp, retired_at timestamp, stats string"


def registry(spark):
    rows = [("s1", "a", "m", 4, "published", False, 1, '{"search_version": 1}'), ("s2", "a", "m", 5, "published", False, 2, '{"search_version": 2}'), ("s3", "b", "m", 5, "published", False, 3, '{"search_version": 2}'), ("s4", "b", "n", 5, "retired", False, 4, None)]
    return spark.createDataFrame([(*r[:6], datetime(2024, 1, r[6]), None, r[7]) for r in rows], REG)


def test_registry_actions(spark):
    reg = registry(spark)
    now = F.lit("2024-02-01").cast("timestamp")
    gone = snapshots.with_status(reg, ["s1", "s4"], "retire", now)
    assert {r.snapshot_id: r.status for r in gone.collect()} == {"s1": "retired", "s2": "published", "s3": "published", "s4": "retired"}
    assert [r.snapshot_id for r in gone.where("retired_at IS NOT NULL").collect()] == ["s1"]
    assert snapshots.with_status(gone, ["s1"], "unretire", now).where("status = 'published' AND retired_at IS NULL").count() == 3
    pinned = snapshots.with_status(reg, ["s3"], "pin", now)
    assert snapshots.with_status(pinned, ["s3"], "retire", now).where("status = 'retired'").count() == 1  # pinned ones stay
    assert {r.snapshot_id for r in snapshots.previous_lineage(reg, "m", "a").collect()} == {"s3"}
    for bad in (pinned, reg.where("lineage = 'b'")):
        with pytest.raises(ValueError):
            snapshots.previous_lineage(bad, "m", "a")
    assert snapshots.still_base(reg, "s2", "a") and not snapshots.still_base(reg, "s1", "a") and not snapshots.still_base(reg, "x", "c")
    assert snapshots.pick_for_search(reg, "m", [4, 5], 2).first().snapshot_id == "s3" and snapshots.pick_for_search(reg, "m", [4, 5], 2, "s2").first().snapshot_id == "s2"
    assert snapshots.snapshot_id(datetime(2024, 1, 1), "abcdef012", {"s20240101000000_abcdef0"}) == "s20240101000001_abcdef0"


def test_build_steps(spark):
    changes = spark.createDataFrame([(1, "added"), (2, "unchanged"), (3, "unchanged"), (4, "source_only"), (5, "deleted"), (6, "legacy")], "key long, change string")
    titles = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "key long, title string")
    base = spark.createDataFrame([(2, "b"), (3, "old"), (4, "d"), (5, "e")], "key long, title string")
    assert {r.key: r.work for r in snapshots.plan_of(changes, base, titles).collect()} == {1: "reindex", 3: "render", 4: "render", 5: "remove", 6: "reindex"}
    assert {r.key for r in snapshots.plan_of(changes, None, titles).collect()} == {1, 2, 3, 4, 6}
    assert snapshots.has_changes(changes) and not snapshots.has_changes(changes.where("change = 'unchanged'"))
    state = spark.createDataFrame([(1, "x"), (2, "y")], "key long, source_hash string")
    assert {tuple(r) for r in snapshots.with_source_hashes(state, spark.createDataFrame([(2, "z")], state.schema)).collect()} == {(1, "x"), (2, "z")}
    for bad in ([(3, "z")], [(1, "z"), (1, "w")]):
        with pytest.raises(ValueError):
            snapshots.with_source_hashes(state, spark.createDataFrame(bad, state.schema))
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "doc_id long, title string")
    new = snapshots.with_titles_refreshed(docs, spark.createDataFrame([(1, "a"), (2, "b")], docs.schema))
    assert {(r.doc_id, r.title, r.changed) for r in new.collect()} == {(1, "a", False), (2, "b", True), (3, "c", False)}
    runs = spark.createDataFrame([("j", k, o) for k, o in enumerate(["failed", "success", "failed", "skipped", "failed"])] + [("i", 1, "failed"), ("i", 2, "no_change")], "job string, started_at long, outcome string")
    assert {tuple(r) for r in snapshots.failures_in_a_row(runs).collect()} == {("j", 2), ("i", 0)}


def test_publish_checks_and_drops(spark, tmp_path):
    df = spark.range(3)
    with pytest.raises(ValueError, match="few"):
        snapshots.publish({"a": df}, str(tmp_path), "s1", lambda at: ["few rows"] if spark.read.parquet(f"{at}/a").count() < 9 else [])
    assert list(tmp_path.iterdir()) == []
    snapshots.publish({"a": df}, str(tmp_path), "s1", lambda at: [])
    assert snapshots.drop(spark, str(tmp_path), ["s1", "s2"]) == ["s1"] and list(tmp_path.iterdir()) == []


def test_numbers_across_buckets(spark):
    rows = [(k % 2, k // 7, k) for k in range(100)]
    got = paging.numbered_within(spark.createDataFrame(rows, "g int, b int, v int"), ["g"], "b", [F.col("v").desc()], "place")
    assert all(r.place == (99 - r.v) // 2 + 1 if r.v % 2 else r.place == (98 - r.v) // 2 + 1 for r in got.collect())
    many = spark.createDataFrame([("l", datetime(2024, 1, 1 + k // 24, k % 24)) for k in range(200)], "lineage string, published_at timestamp")
    by = {r.second: r.superseded_at for r in snapshots.superseded(many).collect()}
    at = sorted(by)
    assert [int(by[s].timestamp()) if by[s] else None for s in at] == [*at[1:], None]


def test_contract_is_kept_by_chunks(spark):
    sizes = chunking.Sizes(least=1)
    assert chunking.chunks_of("## A\nx\n### B\ny", sizes) == [] and chunking.chunks_of("## `A`\nx", sizes) == [] and chunking.chunks_of("note[^1]", sizes) == []
    assert chunking.chunks_of("## A b\nx\n## A b\ny", sizes) == [("A b", "A-b", "## A b\nx", 3), ("A b", "A-b-2", "## A b\ny", 3)]
    docs = spark.createDataFrame([(1, "a_b", "## H\nword\n" * 3), (2, "c", None), (3, "d", "")], "doc_id long, slug string, text string")
    got = chunking.chunks(docs, sizes).collect()
    assert [(r.chunk_id, r.chunk_index, r.heading_anchor) for r in got] == [("a_b_chunk_000", 0, "H"), ("a_b_chunk_001", 1, "H-2"), ("a_b_chunk_002", 2, "H-3")]
    same = spark.createDataFrame([(t,) for t in ("# a", "### b", "x[^1]", "## [l](u)", "## **w**", "## **a** b", "## `c`", "## ok", None)], "text string").select("text", text.contract_violation("text").alias("v"))
    assert all((r.v == chunking.violation(r.text)) if r.text is not None else r.v is None for r in same.collect())


def test_tail_takes_the_first_mark_that_occurs():
    words = "one two three four five six. seven eight; nine ten eleven twelve"
    assert chunking.tail(words, 4) == "seven eight; nine ten eleven twelve"  # . comes before ; in the list
    assert chunking.tail("a b c", 5) == "a b c" and chunking.tail("a b c", 0) == ""


def test_plain_text_of_markdown():
    cases = {
        "# T\n\nA *b* **c** `d*e*` [l](u \"t\") ![i](x)": "T\n\nA b c d*e* l i", "a_b_c 1 < 2 and 3 > 2": "a_b_c 1 < 2 and 3 > 2", "x <b>y</b> &amp; z[^1]": "x y & z", "- one\n- two": "one\n\ntwo",
        "| h | i |\n|---|---|\n| 1 | 2 |": "h\n\ni\n\n1\n\n2", "```py\ncode *x* <y>\n```": "code *x* <y>", "***both*** _em_ \\*no\\*": "both em *no*", "[[in](a)](b) [ref][x]": "in [ref][x]",
        "T\n===\nnext": "T\n\nnext", "<script>hide()</script>see<br>me": "see\nme", "é": "é", "": "", "> quoted\n> more": "quoted\nmore",
    }
    for markdown, want in cases.items():
        assert projection.plain(markdown) == want, markdown
    body, spans = projection.projected("pre\n## H *x*\nbody\n## H *x*\n\n## Z\n")
    assert [(body[a:b].split("\n")[0], h, x) for a, b, h, x in spans] == [("pre", None, ""), ("H x", "H x", "H-*x*"), ("H x", "H x", "H-*x*-2"), ("Z", "Z", "Z")]
    with pytest.raises(ValueError):
        projection.projected("a\0b")


def test_search_documents_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, "a\0b"), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.body_text, r.error) for r in projection.search_documents(docs).collect()}
    assert got == {1: ("", None), 2: (None, "NUL in a text"), 3: ("x", None)} and projection.search_documents(docs.limit(0)).count() == 0
