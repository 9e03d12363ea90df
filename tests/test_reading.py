"""Projection, paging and answers."""

import pytest

from lexarium.operators import answers, projection
from lexarium.operators.paging import Cursor, page


def test_projection_offsets():
    body, spans = projection.projected("pre\n\n## **One** [l](u)\na [x](y) **b** &amp; c[^1]\n\n## One l\n<script>z</script><p>d</p>\n## Empty\n")
    assert [body[a:b] for a, b, _, _ in spans] == ["pre", "One l\n\na x b & c", "One l\n\n\nd", "Empty"]
    assert [s[3] for s in spans] == ["", "**One**-l", "One-l", "Empty"]
    with pytest.raises(ValueError):
        projection.projected("\0")


def test_cursor_round_trip_and_binding():
    c = Cursor("s1", ("a", "b"), offset=20)
    assert Cursor.read(c.written()) == c and c.bound_to(Cursor("s1", ("a", "b"))) and not c.bound_to(Cursor("s2", ("a", "b")))
    for bad in ("", "!!", "e30", Cursor("s", (), limit=99).written()):
        with pytest.raises(ValueError):
            Cursor.read(bad)


def test_pages_are_stable(spark):
    rows = spark.createDataFrame([(k, 1.0, "c", None if k % 2 else f"20{k:02d}-01-01") for k in range(7)], "doc_id long, score double, channel string, publication_date string")
    first, total, more = page(rows, Cursor("s", ("a",), limit=5))
    second, _, end = page(rows, more)
    assert total == 7 and [r.doc_id for r in first.collect()] + [r.doc_id for r in second.collect()] == list(range(7)) and end is None
    assert [r.doc_id for r in page(rows, Cursor("s", ("a",), sort="date", limit=5))[0].collect()] == [6, 4, 2, 0, 1]
    assert page(rows, Cursor("s", ("a",), year=2004))[1] == 1


def test_answer_flow(spark):
    chunks = spark.createDataFrame([("a", "text one"), ("b", "text two")], "id string, text string")
    seen = []
    models = answers.Models(lambda q, h: q + "?", lambda q: [q, q + "!"], lambda qs: seen.append(qs) or chunks, lambda q, ts: "2" if len(seen) > 1 else "NONE", lambda q, ts: f"It is {ts[0]}. [doc: 1] [7] --- \n- What else?\n- x" if ts else "no")
    got = answers.answer("why", [("user", "hi", True), ("assistant", "yo", False)], models)
    assert got.grounded and got.text == "It is text two [1]." and got.followups == ["What else?"] and seen[1] == ["why"]
    assert [len(b) for b in answers.batches(40)] == [13, 13, 13, 1]
    assert answers.condensed("q", "x" * 200) == "q" and answers.graded("1, 9 and 2", 3) == [0, 1]
