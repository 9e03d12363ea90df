"""SetSketch: registers against their definition, estimates against true similarities, components against all pairs."""

import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from lexarium.llm import blocks, registry, setsketch, sets, simhash
from tests.conftest import SF


def plain_set(text: str | None) -> set[str]:
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {" ".join(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {" ".join(w)} - {""}


def plain_classes(rows: list[tuple]) -> list[tuple]:
    sets = [plain_set(t) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holders[x].append(k)
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for other in holders[x]:
                if other < k:
                    shared[other] += 1
        for other, n in shared.items():
            if 100 * n >= 85 * (len(s) + len(sets[other]) - n):
                parent[root(k)] = root(other)
    least = defaultdict(list)
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(k)].append(doc_id)
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    return sorted(((d, len(sets[k]), c := min(least[root(k)], default=None), d == c) for k, (d, _) in enumerate(rows)), key=key)


def found(df) -> list[tuple]:
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=lambda r: (str(r[0]), *map(str, r[1:])))


def near_texts(seed: int) -> list[tuple]:
    """Families around a text with passages of growing length replaced, so that similarities lie on both sides of the threshold, and one of hundreds."""
    draw = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in draw.integers(0, 5000, n)]
    rows, k = [], 0
    for family in range(30):
        base = word(int(draw.integers(4, 400)))
        for _ in range(8 if family else 300):
            own = list(base)
            cut = int(draw.integers(0, max(1, len(own) // 5)))
            at = int(draw.integers(0, len(own)))
            own[at : at + cut] = word(int(cut * draw.random()) + 1)
            rows.append((k, " ".join(own)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \n\t"), (k + 3, "two Words"), (k + 4, "TWO words"), (k + 5, "one"), (None, "two words"), (None, "no id at all"), (k + 6, "a\x1cb c d É"), (0, rows[50][1])]
    rows += [(5000 + x, rows[10][1]) for x in range(100)] + [(6000, " ".join(f"w{x % 997} the" for x in range(60_000)))]
    return rows


@pytest.mark.parametrize("size", [2048, 40])
def test_classes_are_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "ROWS", size)
    rows = near_texts(size)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, node string")
    got = found(setsketch.classes(df).withColumn("kept", setsketch.F.col("doc_id").eqNullSafe(setsketch.F.col("component_id"))))
    assert got == plain_classes(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(registry.queries()["op12_setsketch"](spark, SF)) == plain_classes(rows)


def test_before_any_links_a_node_is_known_by_itself(spark):
    rows = spark.createDataFrame([(7, 1, 5), (7, 2, 6)], "value long, node long, n long")
    assert sorted(simhash._known(rows, None).collect()) == [(7, 1, 5, 1), (7, 2, 6, 2)]
    assert [(r.a, r.b) for r in setsketch.star_pairs(simhash._known(rows, None), 0.8, 0).collect()] in ([(1, 2)], [(2, 1)])


def test_registers():
    draw = np.random.default_rng(1)
    a, b = (draw.integers(0, 1 << 63, n, dtype=np.uint64) for n in (700, 5000))
    r = setsketch.registers(a)
    u = (a * setsketch._FACTORS[7]).min()
    x = -np.log1p(-(float(u) + 1) / 2**64) / setsketch.RATE
    assert r[7] == int(np.floor(1 - np.log(x) / np.log(setsketch.BASE)))
    assert (setsketch.merged(r, setsketch.registers(b)) == setsketch.registers(np.concatenate([a, b]))).all()
    assert (setsketch.registers(a[:0]) == 0).all()


def test_estimates():
    """Of the joint likelihood: within a few standard errors of the true similarity, also for sets of unequal sizes."""
    draw = np.random.default_rng(2)
    errors = []
    for shared, a, b in ((900, 50, 50), (900, 0, 150), (300, 300, 300), (100, 1000, 50), (5, 0, 1)) * 20:
        x = draw.integers(0, 1 << 63, shared + a + b, dtype=np.uint64)
        s, t = x[: shared + a], np.concatenate([x[:shared], x[shared + a :]])
        ll = setsketch.log_likelihood(setsketch.registers(s)[None], setsketch.registers(t)[None], np.array([len(s)]), np.array([len(t)]))[0]
        j = shared / len(x)
        errors.append((setsketch.GRID[ll.argmax()] - j) / np.sqrt(j * (1 - j) / 160))
        assert ll[setsketch.GRID >= j - 0.03].max() >= ll.max() - setsketch.DOUBT
    assert abs(np.mean(errors)) < 0.5 and np.abs(errors).max() < 6


def test_forest_joins_what_all_pairs_join():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    own = [np.unique(np.concatenate([draw.permutation(base)[: int(draw.integers(250, 300))], draw.integers(0, 1 << 63, 10, dtype=np.uint64)])) for _ in range(60)]
    every = np.arange(60)
    links = {(i, j) for i in range(60) for j in range(i) if sets.jaccard(own[i], own[j]) >= 0.85}
    got = blocks.forest(own, list(range(60)), every, every, 0.85)

    def parts(edges):
        p = list(range(60))
        for a, b in edges:
            p = [p[a] if x == p[b] else x for x in p]
        return [p.index(x) for x in p]

    assert {(max(e), min(e)) for e in got} <= links and parts(got) == parts(links) and len(got) < 60
    together = [0] * 30 + list(range(30, 60))
    assert all(together[a] != together[b] for a, b in blocks.forest(own, together, every, every, 0.85))


def test_overlaps_hold_a_bounded_part(monkeypatch):
    r = np.random.default_rng(6)
    own = [np.unique(r.integers(0, 2000, size=r.integers(0, 90)).astype(np.uint64)) for _ in range(50)]
    left, right = np.arange(30), np.arange(30, 50)
    want = [[len(np.intersect1d(own[a], own[b])) for b in right] for a in left]
    for columns in (64, blocks.COLUMNS):
        monkeypatch.setattr(blocks, "COLUMNS", columns)
        assert blocks.overlaps(own, left, right).tolist() == want
    monkeypatch.setattr(blocks, "COLUMNS", 1024)
    own = [np.unique(r.integers(0, 300_000, size=200).astype(np.uint64)) for _ in range(4000)]
    tracemalloc.start()
    blocks.forest(own, list(range(4000)), np.arange(2), np.arange(2, 4000), 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(x.nbytes for x in own)
