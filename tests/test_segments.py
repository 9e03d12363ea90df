"""An index that grows by segments equals one built anew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarium.operators import queries, ranking, segmentation, segments, store
from lexarium.operators.ranking import Unit

UNITS = [Unit((("red", "river"),)), Unit((("fox",), ("vixen",))), Unit((("the",),), 0.15, False)]
SCHEMA = "doc_id long, text string, source string"


def made(ids, seed: int) -> list[tuple]:
    draw = np.random.default_rng(seed)
    words = ["red", "river", "fox", "vixen", "the", "blue", "fish", "\n", "stone", "x1"]
    return [(int(k), " ".join(draw.choice(words, draw.integers(0, 40))), "ab"[k % 2]) for k in ids]


def shown(index) -> tuple:
    found = ranking.ranked(index.postings, index.lengths, index.statistics, UNITS)
    rows = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    one = index.statistics.first()
    return (
        sorted((r.doc_id, round(r.score, 9), r.gate_hits, tuple(r.terms)) for r in found.collect()), rows(index.lexicon, "term", "df", "cf"), rows(index.lengths, "doc_id", "length"),
        rows(index.postings, "term", "doc_id", "tf", F.col("positions").cast("string")), rows(index.bodies, "doc_id", "text"), (one.n, round(one.avg_length, 9)),
    )


def test_builds_equal_one_built_anew(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    now = dict((r[0], r) for r in made(range(60), 1))
    index = segments.update(segments.current(spark, root), spark.createDataFrame(list(now.values()), SCHEMA))
    steps = [(made(range(50, 70), 2), []), ([], [3, 4, 999]), (made([3, 61, 5], 3), [5, 6]), ([(70, None, "a"), (71, "", "b"), (2, "red river red river", "a")], [0])]
    for k, (given, removed) in enumerate(steps):
        for d in removed:
            now.pop(d, None)
        now.update((r[0], r) for r in given)
        index = segments.update(index, spark.createDataFrame(given, SCHEMA), spark.createDataFrame([(d,) for d in removed], "doc_id long"))
        assert index.number == k + 2 == segments.current(spark, root).number
    anew = store.build(spark.createDataFrame(list(now.values()), SCHEMA), f"file://{tmp_path}/anew")
    assert shown(segments.current(spark, root)) == shown(anew)
    assert [r.doc_id for r in queries.search(index, "red river").rows] == [r.doc_id for r in queries.search(anew, "red river").rows]


def test_a_build_writes_what_has_changed(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    first = segments.update(segments.current(spark, root), docs)
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "root").rglob("*.parquet"))
    whole = size()
    second = segments.update(first, docs.where("doc_id IN (17, 42)").withColumn("text", F.lit("short red river")))
    assert len(second.segments) == 2 and second.segments[0].gone_n == 2 and second.segments[1].n == 2
    assert size() - whole < 0.12 * whole
    assert segments.update(second) is second and segments.update(second, docs.limit(0), docs.where("doc_id < 0").select("doc_id")) is second


def test_only_one_build_on_a_base_publishes(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    base = segments.update(segments.current(spark, root), spark.createDataFrame(made(range(5), 1), SCHEMA))
    one = segments.update(base, spark.createDataFrame(made([7], 2), SCHEMA))
    before = sorted(p.name for p in (tmp_path / "root").iterdir() if not p.name.startswith("."))
    with pytest.raises(segments.LostRaceError):
        segments.update(base, spark.createDataFrame(made([8, 1], 3), SCHEMA))
    assert sorted(p.name for p in (tmp_path / "root").iterdir() if not p.name.startswith(".")) == before
    assert segments.current(spark, root).segments == one.segments


def test_segments_of_a_class_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 3)
    root = f"file://{tmp_path}/root"
    index = segments.current(spark, root)
    for k in range(3):
        index = segments.update(index, spark.createDataFrame(made(range(3 * k, 3 * k + 4), k), SCHEMA))
    want = shown(index)
    after = segments.merged(index)
    assert len(after.segments) == 1 and after.number == 4 and shown(after) == want and segments.merged(after) is after
    assert len(segments.swept(after)) == 3 + 2 + 3 and shown(segments.current(spark, root)) == want


def test_with_a_dictionary(spark, tmp_path):
    own = segmentation.with_dictionary([("北京", 34000), ("大学", 20000), ("大学生", 1000), ("房地产", 5000), ("地产", 900)])
    rows = [(1, "北京大学生买房地产", "a"), (2, "大学 地产", "b"), (3, "北京", "a")]
    index = segments.update(segments.current(spark, f"file://{tmp_path}/root", own), spark.createDataFrame(rows, SCHEMA))
    index = segments.update(index, spark.createDataFrame([(3, "地产在北京", "a")], SCHEMA))
    ids = lambda q: sorted(r.doc_id for r in queries.search(index, q).rows)
    assert ids("地产") == [1, 2, 3] and ids("大学") == [1, 2] and ids("北京 大学生") == [1]
    assert {r.term: r.df for r in index.lexicon.collect()}["地产"] == 3
