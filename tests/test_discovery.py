"""Word discovery against a plain version, on lines, letters, repeated ids and empty texts."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lexarium.functions import reading
from lexarium.operators import discovery, index, segmentation

ODD = ["", None, "\n\n", "Ab aB AB ab\nab AB", "straße ÉTÉ été x_y ²³ ٣٤ straße ÉTÉ", "a\x00b c\rd " * 3, "one " * 40, "\U0001d7ce\U0001d7cf 漢字 kana漢字"]


def rows(seed: int = 3) -> list[tuple]:
    draw = np.random.default_rng(seed)
    words = ["Red", "river", "the", "of", "fox", "x1", "straße", "ÉTÉ", "-", "\n", "blue"]
    texts = ODD * 3 + [" ".join(draw.choice(words, draw.integers(0, 60))) for _ in range(60)]
    return [*enumerate(texts), (5, "the red fox of the red river"), (5, "the red fox")]


def plain(docs: list[tuple], least_df: int = 3, longest: int = 5) -> dict:
    by_id = defaultdict(list)
    for k, t in docs:
        by_id[k].append(t or "")
    tf, df, sides, words = Counter(), Counter(), defaultdict(Counter), Counter()
    for texts in by_id.values():
        seen = set()
        for line in "\n".join(sorted(texts)).split("\n"):
            w = re.findall(r"[^\W_]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))
            words.update(w)
            for size in range(2, longest + 1):
                for i in range(len(w) - size + 1):
                    term = tuple(w[i : i + size])
                    tf[term] += 1
                    seen.add(term)
                    sides[term, 0][w[i - 1] if i else ""] += 1
                    sides[term, 1][w[i + size] if i + size < len(w) else ""] += 1
        df.update(seen)
    out = {}
    for term in (t for t in tf if df[t] >= least_df):
        h = min(-sum(c / tf[term] * math.log(c / tf[term]) for c in sides[term, k].values()) for k in (0, 1))
        most = max((c for k in (0, 1) for x, c in sides[term, k].items() if x), default=0)
        out[" ".join(term)] = (len(term), tf[term], df[term], round(tf[term] / min(words[w] for w in term), 9), round(abs(h), 4), round(most / tf[term], 9) if len(term) < longest else 0.0)
    return out


def of(found) -> dict:
    return {r.term: (r.size, r.tf, r.df, round(r.dominance, 9), round(r.entropy, 4), round(r.extends, 9)) for r in found.collect()}


def test_runs_of_odd_texts(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(3)
    want = plain(rows())
    assert len(want) > 200 and of(discovery.discovered(docs)) == want
    assert of(discovery.discovered(docs, seed=1)) == want and discovery.discovered(docs.limit(0)).count() == 0


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(t):
        read.add(1)
        return t

    docs = spark.createDataFrame([r for r in rows() if r[0] != 5], "doc_id long, text string").withColumn("text", F.udf(counted)("text"))
    assert discovery.discovered(docs).count() > 200 and read.value == len(rows()) - 3


def test_words_of_one_hash_are_seen():
    reader = reading.Reader()
    reader.of_place[0][:] = 1
    words, w, n, _, _ = reader.read(["stop other", "pots stop"]).distinct()
    assert sorted(zip(words.to_pylist(), n.tolist(), strict=True)) == [("other", 1), ("pots", 0), ("stop", 3)] and len(set(w.tolist())) == 2
    terms, of, each, places = segmentation.plain_postings(["stop other", "pots\n pots stop"], reader)
    assert {(t, d): n for t, d, n in zip(terms.to_pylist(), of.tolist(), each.tolist(), strict=True)} == {("stop", 0): 1, ("other", 0): 1, ("pots", 1): 2, ("stop", 1): 1}
    assert sorted(places.tolist()) == [0, 0, 1, index.LINE, index.LINE + 1]


def test_tokens_of_texts():
    reader = reading.Reader()
    read = reader.read(["", "A b\nc", "x" * 300 + " É", "\n"])
    words, w, _, _, _ = read.distinct()
    of = dict(zip(words.to_pylist(), w.tolist(), strict=True))
    found = [np.frombuffer(t, np.uint64).tolist() for t in discovery.tokens(read).to_pylist()]
    assert found == [[0], [of["a"], of["b"], 0, of["c"], 0], [of["x" * 300], of["É"], 0], [0, 0]]


def test_plain_postings_are_those_of_places():
    texts = [segmentation.normal(t) for _, t in rows()]
    terms, of, each, places = segmentation.plain_postings(texts, reading.Reader())
    ends = np.cumsum(each)
    got = {(d, t): places[e - n : e].tolist() for t, d, n, e in zip(terms.to_pylist(), of.tolist(), each.tolist(), ends.tolist(), strict=True)}
    assert got == {(d, t): p for d, text in enumerate(texts) for t, p in segmentation.places_of(text, segmentation.PLAIN).items()}
    assert reading.starts(texts).tolist() == [sum(map(len, segmentation.places_of(t, segmentation.PLAIN).values())) for t in texts]
