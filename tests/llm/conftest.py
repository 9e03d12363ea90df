"""Small tables with every odd case: nulls in any column, empty and very long texts, ties, repeated rows, clashing extra columns."""

import pytest

LONG = " ".join(f"w{k % 997} the" for k in range(60_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. You are a stupid idiot and a moron.", "en", "s", 80, 9, "x"),
    (1, "The quick brown fox jumps over the lazy dog. You are a stupid idiot and a moron.", "en", "s", 80, 9, "x"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "s", 0, 1, "y"),
    (4, LONG, "en", "s", len(LONG), 1, "y"),
    (5, "mail me: jo.hn@mail1.example.com or 10.0.0.7, card 4111 1111 1111 1111, +1 (487) 555-7209 4111111111111111.", "en", None, 9, 1, "y"),
    (6, "É́ ǅ İ𠀀 \x00\x1c  ##", "fr", "s", 1, 1, "y"),
    (7, "The quick brown fox jumps over the lazy dog. You are a stupid idiot and a moron!", "en", "s", 80, 9, "x"),
    (None, "no id here", "en", "s", 10, 9, "x"),
    (8, "   \n\t ", "en", "s", 6, 9, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score long, fp string"


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder with odd documents and labels, and one with empty tables."""
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "empty"))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 1, "z"), (3, 1, 0, "z"), (4, 0, 0, "z"), (5, None, 0, None), (None, 1, 1, None), (7, 1, 1, "z"), (99, 1, 1, "z"), (8, 0, 0, "z")], "doc_id long, quality int, toxic int, text string")
    nan = float("nan")
    v = [(0, [1.0, 0.0, 2.0], 1, "a"), (50, [1.0, 0.0, 2.0], 1, "a"), (1, [1.0, 0.0, 2.0], 1, "a"), (2, [0.0, 0.0, 0.0], 1, None), (3, None, 1, None), (4, [1.0, None, 2.0], 1, None), (5, [nan, 1.0, 2.0], 1, None), (6, [-1.0, 3.0, 0.5], None, None), (6, [-1.0, 3.0, 0.5], None, None), (None, [1.0, 1.0, 1.0], 2, None), (7, [1.0], 2, None), (8, [2.0, 0.0, 4.0], 2, None)]
    vectors = spark.createDataFrame(v, "vec_id long, embedding array<float>, label int, score string")
    said = [(0, 0, "user", "hi there", 1, "a"), (0, 1, None, None, 1, "a"), (0, None, "user", "first of all", 1, None), (3, 0, "user", "hi there", 2, "b"), (3, 0, "user", "hi there", 2, "b"), (None, 0, "user", "nobody", 2, None), (7, 5, "", "", None, None), (9, 0, "user", LONG, 1, "x")]
    conversations = spark.createDataFrame(said, "conv_id long, turn long, role string, text string, depth long, keys string")
    for name, df in (("documents", docs), ("labels", labels), ("embeddings", vectors), ("conversations", conversations)):
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return full, empty
