"""Best paths against all segmentations, and an index and queries that share a dictionary."""

import math
from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexarium.operators import segmentation
from lexarium.sources import files

WORDS = {"ab": 30, "abc": 8, "bc": 20, "a": 50, "c": 9, "cab": 5, "ccc": 2, "bca": 1}


def every_cut(run: str):
    if not run:
        yield ()
    for k in range(1, len(run) + 1):
        if k == 1 or run[:k] in WORDS:
            for rest in every_cut(run[k:]):
                yield (run[:k], *rest)


@given(st.text("abcx", min_size=1, max_size=9))
@settings(max_examples=300, deadline=None)
def test_best_path_is_the_best_of_all(run):
    own = segmentation.Dictionary(WORDS.items())
    weight = lambda cut: sum(math.log(WORDS.get(w, 1)) - own.total for w in cut)
    path = own.path(run)
    assert path[0][0] == 0 and path[-1][1] == len(run) and all(a[1] == b[0] for a, b in pairwise(path))
    assert weight([run[a:b] for a, b in path]) == pytest.approx(max(map(weight, every_cut(run))), abs=1e-7)


HAN = [("北京", 34000), ("大学", 20000), ("北京大学", 2000), ("学生", 15000), ("大学生", 1000), ("生活", 9000), ("房地产", 5000), ("地产", 4000), ("税", 30000), ("房地产税", 10000), ("的", 300000)]


def test_words_inside_words():
    own = segmentation.with_dictionary(HAN, stop=["的"])
    assert own.query("北京大学生的生活") == [("北京", 0, 2), ("大学生", 2, 5), ("生活", 6, 8)]
    assert own.index("房地产税") == [("地产", 1, 3), ("房地产", 0, 3), ("房地产税", 0, 4)]
    assert own.query("iphone15 plus税été") == [("iphone15", 0, 8), ("plus", 9, 13), ("税", 13, 14), ("été", 14, 17)]
    assert [own.fragment(w) for w in ("税", "活", "北京")] == [False, True, False]
    assert own.query("") == own.query("!?") == []


def test_normal_form():
    assert segmentation.normal("ÉTÉ Ab") == "É" + "tÉ ab" and segmentation.normal(None) == ""
    assert segmentation.places_of("Café b\ncafé", segmentation.PLAIN) == {"café": [0, 1 << 32], "b": [1]}


def test_word_list_feeds_it(spark, tmp_path):
    (tmp_path / "words.txt").write_text("# frequent\n北京 34000\n大学 20000\n北京大学 2000 # name\n学生\n")
    own = segmentation.from_word_list(files.word_list(spark, str(tmp_path / "words.txt")), more=[("大学生", 900)])
    assert [w for w, _, _ in own.query("北京大学生")] == ["北京", "大学生"]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(segmentation, "WORDS", 2)
        with pytest.raises(ValueError, match="at most 2"):
            segmentation.from_word_list(files.word_list(spark, str(tmp_path / "words.txt")))


def test_postings_are_those_of_each_text(spark):
    docs = [(1, "北京大学生\nAB ab, ab"), (2, None), (3, ""), (4, "大学生的大学")]
    own = segmentation.with_dictionary(HAN, stop=["的"])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for analysis in (own, segmentation.PLAIN):
        got = {(r.term, r.doc_id): (r.tf, r.positions) for r in segmentation.postings(df, analysis).collect()}
        assert got == {(w, d): (len(p), p) for d, t in docs for w, p in segmentation.places_of(t, analysis).items()}
        assert {r.doc_id: r.length for r in segmentation.lengths(df, analysis).collect()} == {d: n for d, t in docs if (n := sum(map(len, segmentation.places_of(t, analysis).values())))}
    assert got[("ab", 1)] == (3, [segmentation.LINE, segmentation.LINE + 1, segmentation.LINE + 2])
