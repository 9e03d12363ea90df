"""Spelling variants against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexarium.llm import registry, spelling
from tests.conftest import SF


def distance_is_one(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_words(rows: list[tuple]) -> dict[str, int]:
    n: Counter[str] = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 199 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            n[low] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def plain_variants(n: dict[str, int]) -> dict[str, tuple]:
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and distance_is_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def found(df) -> dict[str, tuple]:
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@given(st.sets(st.text("abé", max_size=7), max_size=60))
@settings(max_examples=200, deadline=None)
def test_self_join_is_all_pairs(words):
    words = sorted(words)
    x, y = spelling.self_join(words)
    got = sorted(tuple(sorted((words[a], words[b]))) for a, b in zip(x.tolist(), y.tolist(), strict=True))
    assert got == sorted((a, b) for i, a in enumerate(words) for b in words[i + 1 :] if distance_is_one(a, b))


@pytest.mark.parametrize("rows", [1, 3, 40, 10_000])
def test_near_words_for_any_cuts(spark, rows):
    draw = np.random.default_rng(rows)
    words = sorted({"".join(draw.choice(list("aabcé"), draw.integers(1, 9))) for _ in range(500)} | {"a" * k for k in (5, 6, 7, 8, 9, 3000, 3001)})
    n = {w: int(draw.integers(1, 4)) for w in words}
    got = {r.word: (r.n_near, r.best) for r in spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), rows).collect()}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and distance_is_one(w, v)] for w in words}
    assert got == {w: (len(v), min(v, key=lambda x: (-n[x], x))) for w, v in near.items() if v}


def test_variants_of_documents(spark):
    base = ["misspelling", "receive", "Straße", "accommodate", "señorita"]
    texts = [(k, " ".join([*(w.upper() if k % 5 == 0 else w for w in base), "receve recieve! accomodate-misspeling" if k % 6 == 0 else "", f"word{k}x"])) for k in range(400)]
    texts += [(None, "receive " * 7), (1, None), (2, ""), (3, "accommodate,acommodate " * 9), (3, "accommodate,acommodate " * 9), (4, "é" * 50_000 + " " + "abcdef " * 3000)]
    got = found(spelling.variants(spark.createDataFrame(texts, "doc_id long, text string"), rows=4))
    assert got == plain_variants(plain_words(texts))
    assert got["receve"][:2] == ("receive", "receive") and got["misspeling"][1] == "misspelling"


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = found(registry.queries()["op13_spelling"](spark, SF))
    assert got == plain_variants(plain_words(rows)) and sum(v[3] for v in got.values()) > 0


def test_roots_follow_many_forms(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(11)]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{k}": "w11" for k in range(11)}
