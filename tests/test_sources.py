"""File sources and streams."""

from pyspark.sql import functions as F

from lexarium.sources import files
from lexarium.streaming import clicks


def test_markdown_tree_and_missing(spark, tmp_path):
    (tmp_path / "c" / "d").mkdir(parents=True)
    (tmp_path / "c" / "d" / "01.md").write_text("# T")
    (tmp_path / "c" / "x.txt").write_text("no")
    found = files.markdown_tree(spark, str(tmp_path))
    assert [(r.doc_id, r.raw) for r in found.collect()] == [("c/d/01.md", "# T")]
    assert [r.doc_id for r in files.missing(found, ["c/d/01.md", "q.md"]).collect()] == ["q.md"]
    assert files.matching(found, "doc_id", "size", ["c/**/*.md"], ["*.txt"]).count() == 1
    assert files.matching(found, "doc_id", "size", [], ["c/**"]).count() == 0


def test_mapping_table_last_wins(spark, tmp_path):
    (tmp_path / "m.md").write_text("| file | title |\n|---|---|\n| a.md | One |\n| `a.md` | Two |\n| c/0/007.md | x | Three |\nnone")
    found = files.mapping_table(spark, str(tmp_path / "m.md"))
    assert {r.uri: r.title for r in found.collect()} == {"a.md": "Two", "c/0/007.md": "Three"}
    docs = spark.createDataFrame([("a.md",), ("n/0/0012.md",), ("z.md",)], "doc_id string")
    assert {r.doc_id: r.title for r in files.canonical_title(docs, found).collect()} == {"a.md": "Two", "n/0/0012.md": "n 12", "z.md": "z.md"}


def test_word_list(spark, tmp_path):
    (tmp_path / "w.txt").write_text("alpha 5\n# no\nbeta\n")
    assert {r.word: r.frequency for r in files.word_list(spark, str(tmp_path / "w.txt")).collect()} == {"alpha": 5, "beta": None}


def test_click_log_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('x search_click {"q":"a","doc_id":"d","rank":2}\nsearch_click {bad\nother\n')
    assert [r.rank for r in files.click_log(spark, str(tmp_path / "in")).collect()] == [2]
    q = clicks.click_lines(spark, str(tmp_path / "in")).groupBy("q").agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName("clicked").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("clicked").first().n == 1


def test_windows_and_incremental_index(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:01:00", "a", 1.0), ("2024-01-01 00:02:00", "a", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(str(tmp_path / "e"))
    q = clicks.windowed(events).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.mean) for r in spark.table("windows").collect()] == [(2, 2.0)]
    spark.createDataFrame([(1, "a b a")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    out = str(tmp_path / "postings")
    q = clicks.incremental_index(spark, str(tmp_path / "d"), "doc_id long, text string", lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.term, r.tf) for r in spark.read.parquet(out).collect()} == {("a", 2), ("b", 1)}
