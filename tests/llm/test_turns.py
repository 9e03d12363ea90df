"""The trie of conversations against nodes counted one by one, for any cut into partitions."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexarium.llm import registry, turns
from tests.conftest import SF


def plain_trie(rows: list[tuple]) -> set[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    path = {}
    for c in own:
        digest = lambda t: hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()
        ordered = {x: [t[2:] for t in sorted(own[x], key=lambda t: (t[0], t[1], t[2], digest(t)))] for x in (c, c - c % 20) if x in own}
        h = zlib.crc32(str(c).encode()) % 4
        path[c] = tuple(ordered.get(c - c % 20, [])[:h] + ordered[c][h:])
    members = defaultdict(list)
    for c, p in path.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        found = [below(k) for k in kids[p]]
        words = len(p[-1][1].encode().split()) if p else 0
        totals[p] = sum(f[0] for f in found) or 1, sum(f[1] for f in found) + (len(members[p]) - 1) * words
        return totals[p]

    totals = {}
    if members:
        below(())
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if path[c] == p).encode()).hexdigest()
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *totals[p], ends(p)) for p, m in members.items()}


def made_rows(seed: int) -> list[tuple]:
    draw = np.random.default_rng(seed)
    rows = []
    for c in range(300):
        for t in range(int(draw.integers(1, 7))):
            rows.append((c, t, "user" if t % 2 == 0 else None, "the same long beginning" if t == 0 and c % 3 else f"w {draw.integers(3)}" if draw.random() < 0.9 else None))
    rows += [(400 + k, t, "user", f"copy {t}") for k in range(60) for t in range(5)]  # one conversation many times
    rows += [(500, t, "user", f"turn {t} of many") for t in range(400)] + [(None, 1, "user", "no id"), (7, None, None, "first"), (7, None, None, "first"), (7, 2, "b", "tie"), (7, 2, "a", "tie"), (900, 0, "", ""), (-21, 3, "user", "below zero")]
    return rows


def rows_of(df) -> list[tuple]:
    return [tuple(r[c] for c in turns.NODE) for r in df.collect()]


@pytest.mark.parametrize(("parts", "waiting", "chunk"), [(1, 50_000, 50_000), (3, 5, 2), (40, 50_000, 50_000), (40, 0, 1)])
def test_any_partitions(spark, parts, waiting, chunk):
    rows = made_rows(parts)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("keys", F.lit(1)).withColumn("words", F.lit(2))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(turns.trie(turns.rebuilt(df), waiting, chunk))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_one_sweep_of_one_row_partitions():
    """Every row a partition of its own, so all nodes are stitched."""
    rows = sorted([([b"a"], 3), ([b"a"], 5), ([b"a", b"b"], 1), ([b"a", b"c"], 9), ([], 7), ([b"d", b"e"], 2)])
    parts = []
    for k, (keys, c) in enumerate(rows):
        own = turns.Sweep(k)
        own.row(keys, [2] * len(keys), c)
        own.finish()
        parts += own.out
    names = turns._SCHEMA.names
    parts = [dict(zip(names, p, strict=True)) for p in parts]
    stitch = turns.Stitch(-1)
    for r in sorted(parts, key=lambda r: (r["part_at"], r["stage"], r["seq"])):
        stitch.part(r)
    stitch.down_to(0)
    found = {(r[4], r[5], r[6], r[7], r[8], r[9], r[10]) for r in stitch.out if r[0] == turns.WHOLE}
    assert found == {(1, 0, None, 6, 2, 3, 6), (1, 1, 1, 4, 2, 2, 6), (1, 2, 1, 1, 0, 1, 0), (9, 2, 1, 1, 0, 1, 0), (2, 1, 1, 1, 1, 1, 0), (2, 2, 2, 1, 0, 1, 0)}
    assert isinstance(pa.schema(turns._SCHEMA), pa.Schema)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = rows_of(registry.queries()["op11_trie"](spark, SF))
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)
