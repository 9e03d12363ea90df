"""Operators against plain versions of what they compute."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from lexarium.llm import bpe, fingerprint, licences, neighbours, ngrams, packing, pii, quality, registry, simhash, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas().sort_values("doc_id").reset_index(drop=True)


def run(spark, name):
    return registry.queries()[name](spark, SF).toPandas()


def test_simhash(spark, docs):
    def plain(text):
        w = WORD.findall(text.translate(LOW))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = run(spark, "op3_simhash").set_index("doc_id")
    fp = [plain(t) for t in docs.text]
    assert [f"{x:016x}" for x in fp] == got.loc[docs.doc_id].fingerprint.tolist()
    least = list(range(len(fp)))
    for _ in range(len(fp)):
        new = [min(least[j] for j in range(len(fp)) if (fp[i] ^ fp[j]).bit_count() <= 4) for i in range(len(fp))]
        if new == least:
            break
        least = new
    assert docs.doc_id.iloc[least].tolist() == got.loc[docs.doc_id].component_id.tolist()


def test_pigeonhole_finds_all_links(spark, monkeypatch):
    r = random.Random(1)
    fps = [r.getrandbits(64) for _ in range(300)]
    fps += [x ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 8))) for x in fps for _ in range(2)]
    fps = list(dict.fromkeys(fps))
    want = {tuple(sorted((i, j))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 6}
    nodes = spark.createDataFrame([(simhash.signed(x), k, k) for k, x in enumerate(fps)], "fp long, node long, known long")
    chosen = simhash.probing(nodes, 6)
    assert {(min(e), max(e)) for e in simhash.links(nodes, chosen, 6).collect()} == want

    def parts(edges):
        return {frozenset(g) for g in _groups(edges, len(fps))}

    monkeypatch.setattr(simhash, "HOT_ROWS", -10_000)  # every bucket in blocks
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert parts([tuple(e) for e in simhash.links(nodes, chosen, 6).collect()]) == parts(want)


def _groups(edges, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for k in range(n):
        out.setdefault(find(k), []).append(k)
    return out.values()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert set(got) == {*range(1, 201), 501} and all(got[k] == 0 for k in range(1, 201)) and got[501] == 500


def test_allocation_is_the_cheapest():
    costs = [[0.0, 1, 5, 9], [0.0, 2, 3, 20], [0.0, 4, 4, 4]]
    best = min((costs[0][a] + costs[1][b] + costs[2][c], (a - 1, b - 1, c - 1)) for a in range(4) for b in range(4) for c in range(4) if a + b + c - 3 == 2)
    t = simhash.allocate(costs, 2)
    assert sum(t) == 2 and sum(costs[k][x + 1] for k, x in enumerate(t)) == best[0]


@pytest.mark.parametrize("dense", [simhash.DENSE, 2])  # by pairs, or every bucket by links to a few of its nodes first
def test_similar_documents(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "CHUNK", simhash.CHUNK if dense > 2 else 600)
    r = random.Random(2)
    words = [f"{a}{b}" for a in "kltmnp" for b in "aeiou"] + [str(k) for k in range(300)]
    base = [[r.choice(words) for _ in range(150)] for _ in range(40)]
    rows, k = [], 0
    for w in base:
        for edits in (0, 1, 3):
            x = list(w)
            for i in r.sample(range(len(x)), edits):
                x[i] = "changed"
            rows.append((k, " ".join(x)))
            k += 1
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for _, t in rows]
    want = [(i, j) for i in range(k) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    groups = {x: min(g) for g in _groups(want, k) for x in g}
    assert all(groups[i] == got[i] for i in got)


def _same_groups(spark, texts):
    """similar_documents against all pairs; the pairs of 0.8 or more that aren't equal."""
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    want = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    groups = {x: min(g) for g in _groups(want, len(sets)) for x in g}
    assert [got[i] for i in range(len(sets))] == [groups[i] for i in range(len(sets))]
    return [(i, j) for i, j in want if sets[i] != sets[j]]


def _replaced(r, w, similarity):
    """w with one passage replaced, at its end or inside, so that about this similarity is left."""
    n = round((len(w) - 4) * (1 - similarity) / (1 + similarity))
    at = r.choice([len(w) - n, r.randrange(len(w) - n)])
    return [*w[:at], *(f"new{r.randrange(10**6)}" for _ in range(n)), *w[at + n :]]


def test_similar_documents_with_replaced_passages(spark):
    r = random.Random(8)
    texts = []
    for _ in range(60):
        w = [str(r.randrange(900)) for _ in range(r.randrange(60, 240))]
        texts += [" ".join(w), " ".join(_replaced(r, w, r.uniform(0.72, 0.95)))]
    assert len(_same_groups(spark, texts)) > 30


def test_similar_documents_by_fingerprints(spark, monkeypatch):
    """Without least hashes and prefixes, what links by fingerprints is found, and only if the whole sets are alike."""
    monkeypatch.setattr(simhash, "TURNS", 0)
    monkeypatch.setattr(simhash, "meeting", lambda nodes, least: spark.createDataFrame([], "value long, a long, n int, b long, m int"))
    r = random.Random(4)
    texts = ["of nine words only", "of nine words only now", *["the same words again and again " * k for k in (5, 6)]]
    for _ in range(30):
        w = [str(r.randrange(900)) for _ in range(400)]
        texts += [" ".join(w), " ".join([*w[:-1], "changed"]), " ".join([*w, *w[:5]])]
    got = {x.doc_id: x.component_id for x in simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    fp, sets = [simhash.fingerprint(t, 5) for t in texts], [simhash.shingle_set(t, 5) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4 and simhash.jaccard(sets[i], sets[j]) >= 0.8]
    groups = {x: min(g) for g in _groups(near, len(texts)) for x in g}
    assert len(near) > 20 and [got[i] for i in range(len(texts))] == [groups[i] for i in range(len(texts))]


def test_similar_documents_of_long_texts(spark):
    r = random.Random(9)
    texts = []
    for k in range(80):
        w = [str(r.randrange(5000)) for _ in range((300, 700, 2000, 5000)[k % 4])]
        texts += [" ".join(w), " ".join(_replaced(r, w, r.uniform(0.77, 0.83)))]
    assert len(_same_groups(spark, texts)) > 20


def test_dense_groups_are_sent_only_what_they_share(spark, monkeypatch):
    """Of long texts that meet in many dense groups, what no other text holds isn't shuffled once a group."""
    monkeypatch.setattr(simhash, "LATE", 0)  # what is shared by many stays in the prefixes
    r = random.Random(12)
    passages = [[f"p{k}of{i}" for i in range(8)] for k in range(120)]
    texts = []
    for k in range(60):
        parts = [passages[p] for p in r.sample(range(120), 60)] + [[f"own{k}of{i}at{j}" for j in range(100)] for i in range(60)]
        r.shuffle(parts)
        texts.append(" ".join(w for x in parts for w in x))
    texts += [f"{t} and a few words more" for t in texts[:5]]
    numbers = sum(len(simhash.shingle_set(t, 5)) // 5 * 8 for t in texts)
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: store.executorList(True).head().totalShuffleWrite()
    before = written()
    assert len(_same_groups(spark, texts)) == 5
    assert written() - before < 9 * numbers


def test_bpe(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = run(spark, "op9_bpe").set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode_ordinary(t)
        assert got.loc[d].n_tokens == len(ids) and got.loc[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.loc[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    own = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    r = random.Random(4)
    odd = ["a" * 300, " " * 77, "é" * 40, "🙂🙂", "'ll", "́"] + ["".join(r.choice("aAé \n.9𠀀'") for _ in range(r.randrange(1, 30))) for _ in range(300)]
    for t, pieces in zip(odd, own.split(odd), strict=True):
        assert own.ids(pieces).tolist() == library.encode_ordinary(t) and own.decode([own.ids(pieces)]) == [t.encode()]


def test_bpe_of_long_pieces():
    at = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(at, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, r = bpe.Encoder(at, public_tokenizers.PATTERN), random.Random(13)
    odd = ["".join(r.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "的一是不了人我在有他这为之大来以个中上们", "éèa", "=-", "thean") for n in (97, 300, 5000)]
    odd += ["a" * 10_000, "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(100_000))]
    for t in odd:
        assert own.ids(own.split([t])[0]).tolist() == library.encode_ordinary(t)


def test_pieces_that_recur_stay_known(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 60)
    own = bpe.Encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    learnt = Counter()
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda pieces: (learnt.update(pieces), learn(pieces)))
    for k in range(12):
        texts = ["recurringpiece", " ".join(f"x{a}q{k}" for a in "abcdefghijklmnop")]
        assert [own.ids(p).tolist() for p in own.split(texts)] == [x.tolist() for t in texts for x in [np.concatenate([np.frombuffer(own.met[p], np.uint32) for p in own.pattern.findall(t)])]]
    assert learnt["recurringpiece"] == 1 and len(own.met) + len(own.before) < 200


def test_decoding_is_of_the_ids(spark, tmp_path):
    at = str(tmp_path / "own.tiktoken")
    names = [bytes([k]) for k in range(256)] + [b"ab", b"abc"]
    open(at, "wb").write(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(names)))
    rows = spark.createDataFrame([(1, [257, 97, 256]), (2, []), (3, None), (4, [0xC3, 0xA9])], "doc_id long, ids array<int>")
    got = {x.doc_id: bytes(x.decoded) for x in bpe.decode(rows, at).collect()}
    assert got == {1: b"abcaab", 2: b"", 3: b"", 4: "é".encode()}
    own = bpe.Encoder(at, ".+")
    own.met["abc"] = np.array([97, 256], dtype=np.uint32).tobytes()  # other ids decode to other bytes
    assert own.decode([own.ids(own.split(["abc"])[0])]) == [b"aab"]


def test_packing(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array(library.encode(t, add_special_tokens=False).ids + [2], dtype="<u4") for d, t in zip(docs.doc_id, docs.text, strict=True)}
    got = run(spark, "op5_packing")
    for d, g in got.sort_values(["doc_id", "start"]).groupby("doc_id"):
        at = 0
        for p in g.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[d]) and p.ids_crc32 == zlib.crc32(ids[d][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[d])
    padding = 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
        n = int(g.length.sum())
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    assert padding == 0


def test_column_generation_is_optimal_on_a_known_case():
    demand = np.zeros(64)
    demand[47], demand[15] = 10, 10  # three quarters and one quarter go together
    assert abs(sum(v for _, v in packing.patterns(demand)) - 10) < 1e-6


def test_tokenizer_runs():
    own, library = packing.Tokenizer(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(3)
    parts = [*"aAbÉé'.,!?|<>$9 5#\t\ńß…(sS", "<|endoftext|>", "'s", "'ll", "İ", "ǅ", "\x1c", " "]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        assert np.frombuffer(own.ids(t), np.uint16).tolist() == library.encode(t, add_special_tokens=False).ids


def test_ngrams_base(spark, docs):
    got = run(spark, "op6_ngrams").set_index("doc_id")
    c = Counter()
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        if zlib.crc32(str(d).encode()) % 10:
            c.update([*WORD.findall(t.translate(LOW)), ""])
    n, v = sum(c.values()), len(c)
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        w = [*WORD.findall(t.translate(LOW)), ""]
        x = got.loc[d]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(c[a] > 0 for a in w), n)
        assert abs(x.base_score - sum(log10((c[a] + 0.1) / (n + 0.1 * (v + 1))) for a in w)) < 1e-6 * abs(x.base_score)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_ngram_probabilities_against_counts(spark):
    rows = [(k, "a b c d a b c x a b d") for k in range(6)] + [(9, "b c a q")]
    about = ngrams.train(spark.createDataFrame(rows, "doc_id long, text string"), ngrams.F.lit(True))
    m = ngrams.Model(*about)
    texts = ["a b c d a b z", "q q"]
    ids, starts, _ = ngrams.sequence(m.words, texts)
    got = m.log10(ids, starts)
    grams = [Counter(), Counter(), Counter()]
    for _, t in rows:
        s = ["", *t.split(), ""]
        grams[0].update(s[1:])
        grams[1].update(zip(s, s[1:], strict=False))
        grams[2].update(zip(s, s[1:], s[2:], strict=False))
    kept = [grams[0], {k: v for k, v in grams[1].items() if v >= 2}, {k: v for k, v in grams[2].items() if v >= 2}]
    n, v = sum(grams[0].values()), len(grams[0])

    def p(history, w):
        if not history:
            return (grams[0][w] + 0.1) / (n + 0.1 * (v + 1))
        level = len(history)
        shorter = p(history[1:], w)
        of = kept[0].get(history[0], 0) if level == 1 else kept[1].get(history, 0)
        if not of:
            return shorter
        follow = {k[-1]: x for k, x in kept[level].items() if k[:-1] == history}
        left = max(1 - sum(x - 0.9 for x in follow.values()) / of, 1e-6)
        return max(follow.get(w, 0) - 0.9, 0) / of + left * shorter

    at = 0
    for t in texts:
        s = ["", *t.split(), ""]
        for k in range(1, len(s)):
            assert abs(got[at + k] - log10(p(tuple(s[max(0, k - 2) : k]), s[k]))) < 3 * ngrams.STEP
        at += len(s)


def test_ngrams_look_words_up_once(spark, docs):
    texts = dict(zip(docs.doc_id.tolist(), docs.text, strict=True)) | {None: None, -5: "", -6: "words nobody else has\x85 \u3000 Words"}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    about, rows = ngrams.trained(d, ngrams.F.col("doc_id") % 2 == 0)
    own = ngrams.Model(*about).words
    for r in rows.collect():
        ids, starts, lengths = ngrams.read_ids(ngrams.pa.array([bytes(r.ids)]))
        want = ngrams.sequence(own, [texts[r.doc_id] or ""])
        assert ids.tolist() == want[0].tolist() and lengths.tolist() == want[2].tolist() and starts.tolist() == [0]
        assert r.trains == (None if r.doc_id is None else r.doc_id % 2 == 0)
    one, two = (sorted(map(tuple, x.collect()), key=str) for x in (ngrams.scored(d, about), ngrams.scored_ids(rows, about)))
    assert one == two and len(one) == len(texts)


def test_elias_fano():
    r = np.random.default_rng(1)
    for top in (10, 5000, 10**7, 10**12):
        v = np.sort(r.integers(0, top, 3000).astype(np.uint64))
        e = ngrams.EliasFano.build(v)
        assert (e.all() == v).all() and (e.get(np.arange(3000)) == v).all()
        x = np.concatenate([v, r.integers(0, top, 3000).astype(np.uint64)])
        found = e.find(x)
        assert (v[found[found >= 0]] == x[found >= 0]).all() and ((found >= 0) == np.isin(x, v)).all()


def test_fingerprints(spark, docs):
    got = run(spark, "op2_fingerprint").set_index("doc_id")
    d = docs.sort_values("doc_id", ascending=False).reset_index(drop=True)
    for k, (i, t) in enumerate(zip(d.doc_id, d.text, strict=True)):
        after = d.text[(k + 1) % len(d)]
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        x = got.loc[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = fingerprint.sketch(t), fingerprint.sketch(edited)
        assert x.fingerprint == fingerprint.written(a) and abs(x.near_edited - fingerprint.likeness(a, b)) < 1e-12
        assert abs(x.near_next - fingerprint.likeness(a, fingerprint.sketch(after))) < 1e-12 and x.edited_fingerprint == fingerprint.written(b)
    assert (got.near_edited > got.near_next).mean() > 0.95


def test_sketches_merge_and_contain():
    r = random.Random(5)
    for _ in range(300):
        few = ["".join(r.choice("abcdefgh ") for _ in range(r.choice((0, 5, 12, 20, 200)))) for _ in range(2)]
        s, t = map(fingerprint.sketch, few)
        both = np.unique(np.concatenate([fingerprint._kept(np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32))[0] for x in few if x] or [np.zeros(0, np.uint64)]))
        m = fingerprint.merged(s, t)
        assert (m == (both & fingerprint.KEPT_BITS if len(both) else np.sort(np.concatenate([s, t]))[:1])).all() and (fingerprint.read(fingerprint.written(m)) == m).all()
        assert (fingerprint.merged(t, s) == m).all() and fingerprint.likeness(s, s) == 1.0
    a, b = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (60_000, 3000))
    both = fingerprint.sketch(a + b)
    assert len(np.setdiff1d(fingerprint.merged(fingerprint.sketch(a), fingerprint.sketch(b)), both)) == 0
    assert fingerprint.containment(fingerprint.sketch(b), both) == 1.0
    assert (fingerprint.read(fingerprint.written(both)) == both).all()


def test_licences(spark, docs):
    mit = licences.TEMPLATES[0][1]
    texts = ["Released under the MIT License.", "released under the MIT licence", "x\n" + mit.replace(". ", ".\n") + "\ny", "nothing of the sort", ""]
    r = random.Random(15)
    vague = [" ".join(r.choice("red under the blue of and to with this".split()) for _ in range(200)) for _ in range(2)]
    inside = [f"{vague[0]} Released under the MIT License. {vague[1]}", f"{vague[0]}\n{vague[0]} {mit} {vague[1]}", "one\n\ntwo Licensed under\nthe Apache License,\nVersion 2.0. three"]
    s = licences.Scanner()
    assert [s.scan(t)[0] for t in texts] == ["MIT", "MIT", "MIT", None, None]
    assert [s.scan(t)[::2] for t in inside] == [("MIT", 0), ("MIT", 1), ("Apache-2.0", 2)]
    few = licences.Scanner(tuple(t for t in licences.TEMPLATES if len(t[1]) < 120) + (("Odd", "the of the of the red of the"),))
    sources = [*texts[:2], *inside[::2], *vague, *(" ".join(w) for t in docs.text[docs.text.str.contains("icense")][:10] for w in [t.split()[:150]]), "the of the of the red of the of the red the of the of"]
    for t in sources:
        w = licences.words_of(t)
        best = 0.0
        for a in range(len(w)):
            for b in range(a + 2, min(len(w), a + 40) + 1):
                bag = Counter(zip(w[a:b], w[a + 1 : b], strict=False))
                best = max([best, *(licences.dice(bag, x) for x in few.bags)])
        assert few.scan(t)[1] == pytest.approx(best if best >= 0.8 else 0.0)
    long = (mit + " ") * 300
    began = time.time()
    assert s.scan(long)[0] == "MIT" and time.time() - began < 60


def _nearest(ids, v, q, k=5):
    """Row q's nearest: (id, cosine), ties to the smaller id."""
    norms = np.sqrt((v * v).sum(1))
    s = (v * v[q]).sum(1) / (norms * norms[q])
    order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
    return [(int(ids[j]), float(s[j])) for j in order]


def test_neighbours(spark):
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet").to_pandas()
    v, ids = np.array(t.embedding.tolist(), dtype=np.float64), t.vec_id.to_numpy()
    got = registry.queries()["op8_neighbours"](spark, "/root/testdata/sf0.01").toPandas().sort_values(["query_id", "rank"])
    hit = 0
    for q in np.nonzero(ids % 50 == 0)[0]:
        g, want = got[got.query_id == ids[q]], _nearest(ids, v, q)
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and g.score.is_monotonic_decreasing
        for x in g.itertuples():
            j = int(np.nonzero(ids == x.vec_id)[0][0])
            assert abs(x.score - (v[j] @ v[q]) / np.sqrt((v[j] @ v[j]) * (v[q] @ v[q]))) < 1e-12
        hit += len({i for i, _ in want} & set(g.vec_id))
    assert hit / len(got) >= 0.99


def test_neighbours_ties_ids_and_lengths(spark):
    rows = [(k, [float(k % 4 == 0), float(k % 4 == 1), 1.0 + k % 2]) for k in range(1, 60)] + [(100, [1.0, 0.0, 1.0]), (100, [0.0, 1.0, 1.0]), (7, [1.0, 0.0, 1.0]), (200, [1.0, 2.0]), (3, [1.0, 2.0, 3.0, 4.0, 5.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), neighbours.F.col("vec_id") % 50 == 0).toPandas()
    three = [r for r in rows if len(r[1]) == 3]
    ids, v = np.array([r[0] for r in three]), np.array([r[1] for r in three])
    want = []
    for q in np.nonzero(ids % 50 == 0)[0]:
        want += [(int(ids[q]), k + 1, i, round(s, 9)) for k, (i, s) in enumerate(_nearest(ids, v, q))]
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got.itertuples(index=False)) == sorted(want)


def test_few_vectors_are_reranked():
    r = np.random.default_rng(0)
    u = r.standard_normal((16384, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    m = u.mean(0)
    found, share = neighbours.search(np.arange(len(u)), np.arange(len(u)), u, neighbours.Codes.of(u, m), np.arange(100), u[:100], neighbours.Asked.of(u[:100], m), 5)
    s = u[:100] @ u.T
    s[np.arange(100), np.arange(100)] = -9
    want = {(q, int(j)) for q in range(100) for j in np.argsort(-s[q])[:5]}
    assert share < 0.1 and len(want & {(a, b) for a, b, _, _ in found}) >= 0.99 * len(want)


def test_bounds_hold():
    r = np.random.default_rng(0)
    for dim in (3, 64, 300):
        u = r.standard_normal((500, dim))
        u /= np.linalg.norm(u, axis=1)[:, None]
        m = u.mean(0)
        estimate, error = neighbours.bounds(neighbours.Codes.of(u, m), neighbours.Asked.of(u[:50], m))
        assert (np.abs(estimate - u[:50] @ u.T) <= error).mean() > 0.99


def test_base_spans_and_added_ones(spark, docs):
    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(x := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(x)]
        return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15])

    got = run(spark, "op4_pii").set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        want = plain(t)
        assert got.loc[d].base_sha256 == hashlib.sha256(pii.written(want).encode()).hexdigest()
        assert set(pii.written(want).split(",")) <= set(got.loc[d].spans.split(",")) | {""}
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_field_splits_neighbouring_numbers(spark):
    field = pii.train(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    t = "call +1 (487) 555-7209 4111111111111111 now"
    assert pii.base_spans(t) == []
    assert pii.written(pii.all_spans(field, t)) == "phone:5:22,card:23:39"
    assert pii.redacted(t, pii.all_spans(field, t)) == "call [PHONE] [CARD] now"
    assert pii.all_spans(field, "room 12 at 10.30 in 1999, id 4f3a9c0b11") == []


def test_field_finds_what_patterns_miss(spark):
    field = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    for text, want in (
        ('and token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" with', "secret:13:53"),
        ("tel: (487) 555-7209 again", "phone:5:19"),
        ("in 1999 there were 12345678 of them, v2.1.33 and 10.5", ""),
        ("on 2024-05-17 word123 came", ""),
    ):
        assert pii.base_spans(text) == [] and pii.written(pii.all_spans(field, text)) == want, text
    made = pii.examples(300, seed=99)
    got = [set(pii.all_spans(field, t)) for t, _ in made]
    hit = sum(len(g & set(s)) for g, (_, s) in zip(got, made, strict=True))
    assert hit >= 0.9 * sum(len(s) for _, s in made) and hit >= 0.9 * sum(map(len, got))


def test_base_spans_of_odd_and_long_texts():
    def plain(t):
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(x := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(x)]
        return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15])

    r = random.Random(14)
    for _ in range(6000):
        t = "".join(r.choice("aZ09.@-+ %(1é\n") for _ in range(r.randrange(40)))
        assert pii.base_spans(t) == plain(t), t
    began, field = time.time(), pii.Field()
    for t in ("a" * 400_000 + "@", "1" * 400_000, "@" * 400_000, "1." * 200_000, "+" * 400_000, "+1" + "(" * 400_000, "a" * 400_000 + " 1", "x1" * 200_000):
        pii.base_spans(t)
        sum(1 for _ in pii.REGION.finditer(t))
    assert time.time() - began < 20
    pii.all_spans(field, "12 345 " * 3000)


def test_automata_match_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    terms = {"idiot": 1, "worthless": 2, "scum": 0, "moron": 1}
    a, r = toxicity.Automaton(terms), random.Random(6)
    words = ["idi0t", "idoit", "worthles", "wurthlss", "scum", "scam", "idiots", "diot", ""] + ["".join(r.choice("idotworthlescumn") for _ in range(r.randrange(3, 10))) for _ in range(3000)]
    words += [t[:i] + c + t[i:] for t in terms for i in range(len(t)) for c in "xy"]
    for w in words:
        near = sorted((d, t) for t, e in terms.items() if (d := distance(w, t)) <= e)
        assert a.match(w) == ((near[0][1], near[0][0]) if near else None)


def test_quotation_scores_less_than_abuse():
    m = toxicity.Matcher({"idiot": 5.0}, {"idiot": 1})
    abuse, quoted = m.features("you are an idi0t my friend"), m.features('he said the word "idiot" is rude')
    assert abuse[0] > 0 and abuse[6] > 0 and quoted[0] == 0 and quoted[5] > 0
    assert m.features("") == [0.0] * 7


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.93), ("op10_quality", "quality", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()[name](spark, sf).toPandas().merge(pq.read_table(f"{sf}/labels.parquet").to_pandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held[label]).mean() >= least
    assert ((got.score >= (toxicity.THRESHOLD if label == "toxic" else quality.THRESHOLD)) == (got.predicted == 1)).all()


def test_trees_fit_a_step():
    r = np.random.default_rng(3)
    x = r.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((quality.fit(x, y).score(x) > 0.5) == (y == 1)).mean() > 0.98


def test_pipeline_stage_by_stage(spark, docs):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == list(corpus_pipeline.COLUMNS)
        before_ids, ids = {r.doc_id for r in kept.select("doc_id").collect()}, {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= before_ids
        if name == "pii":
            assert ids == before_ids and all("@mail" not in r.text for r in after.select("text").collect())
        if name == "near_copies":
            texts = [r.text for r in after.select("text").collect()]
            assert len(texts) == len(set(texts))
        kept = simhash.common.staged(after)
    tokens = corpus_pipeline.STAGES[-1][1](spark, kept, SF).toPandas()
    assert set(tokens.doc_id) == ids


def test_automaton_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "PAIRS", 3000)
    r = random.Random(12)
    terms = {"".join(r.choice("abcdefgh") for _ in range(r.randrange(5, 9))): 1 for _ in range(300)}
    a, fresh = toxicity.Automaton(terms), {}
    for k in range(3000):
        w = "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 10)))
        fresh[w] = a.match(w)
        assert a.pairs < 3000 * 3
    monkeypatch.setattr(toxicity, "PAIRS", 10**9)
    free = toxicity.Automaton(terms)
    assert all(free.match(w) == x for w, x in fresh.items())


def test_quotations_end_with_their_marks():
    m = toxicity.Matcher({"idiot": 5.0}, {"idiot": 1})
    of = lambda t: [m.features(t)[k] > 0 for k in (0, 5)]  # noqa: E731  abuse, quotation
    assert of("er rief „du bist ein idiot“ und ging") == [False, True]
    assert of("er rief „das ist gut“ und du bist ein idiot") == [True, False]
    assert of("“a mark that nobody closed\n" + "plain " * 40 + "you idiot") == [True, False]
    assert of("she wrote to him “you are an idiot” and left") == [False, True]
    assert of("il a dit « tu es un idiot » hier") == [False, True]
