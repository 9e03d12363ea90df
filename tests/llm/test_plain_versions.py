"""Classifiers and pipeline stages against plain versions of what they compute."""

import math
import random
import re

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from lexarium.llm import common, pii, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_flat_trees_are_walked_like_trees():
    r = np.random.default_rng(4)
    x = r.random((300, 5))
    x[:40, 2] = 0.5  # ties with a cut
    y = ((x[:, 0] > 0.4) & (x[:, 2] >= 0.5)).astype(float)
    model = quality.fit(x, y, trees=12, depth=3)

    def walked(row):
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(model.score(x), [walked(row) for row in x]) and model.score(x[:0]).shape == (0,)
    cuts = np.unique(model.cut[np.isfinite(model.cut)])
    assert all((model.cut[model.feature == j][np.isfinite(model.cut[model.feature == j])] <= x[:, j].max()).all() for j in range(5)) and len(cuts)


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_toxicity_scores_like_a_plain_matcher():
    weights = {"idiot": 5.0, "moron": 4.0, "scum": 3.0, "worthless": 6.0}
    edits = {"idiot": 1, "moron": 0, "scum": 0, "worthless": 2}
    model = toxicity.Model(weights, edits, np.zeros(7), np.ones(7), np.array([-3.0, 2.0, 0.1, 0.2, 0.3, 0.4, -1.0, 0.5]))

    def plain(text):
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"\w+", text)]
        abuse = quoted = addressed = top = 0.0
        seen = set()
        for k, (w, a, b) in enumerate(words):
            near = sorted((d, t) for t, e in edits.items() if (d := _distance(w, t)) <= e)
            if not near:
                continue
            weight = weights[near[0][1]] * 0.8 ** near[0][0]
            before = [x for x, _, _ in words[max(0, k - 6) : k]]
            marked = 0 < a and b < len(text) and text[a - 1] in toxicity.QUOTES and text[b] in toxicity.QUOTES
            if marked or any(x in toxicity.REPORTING for x in before):
                quoted += weight
                continue
            abuse, top = abuse + weight, max(top, weight)
            seen.add(w)
            addressed += any(x in toxicity.ADDRESS for x in before + [y for y, _, _ in words[k + 1 : k + 7]])
        if not abuse and not quoted:
            return [0.0] * 7
        n = len(words)
        return [math.log1p(abuse), top, math.log1p(len(seen)), abuse / n, math.log1p(abuse * 100 / n), math.log1p(quoted), math.log1p(addressed)]

    r = random.Random(16)
    pool = "you are an idi0t idiot idiots idit moron mor0n scum worthles wurthless worhtless fine day he said the word 'idiot' quoted".split()
    texts = ["", " ", "Idiot", *(" ".join(r.choice(pool) for _ in range(r.randrange(1, 30))) for _ in range(300))]
    m = toxicity.Matcher(weights, edits)
    for t in texts:
        assert np.allclose(m.features(t), plain(t)), t
    x = np.array([plain(t) for t in texts])
    assert np.allclose(model.score(np.array([m.features(t) for t in texts])), [1 / (1 + math.exp(-(model.beta[0] + row @ model.beta[1:]))) for row in x])


def _shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_near_copies_against_all_pairs(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    r = random.Random(17)
    rows = [(int(d), t, "en", "s", len(t)) for d, t in zip(docs.doc_id, docs.text, strict=True)]
    top = max(x[0] for x in rows) + 1
    for k, (_, t, *_) in enumerate(r.sample(rows, 40)):  # copies with a passage replaced
        w = t.split()
        n = max(1, round(len(w) * r.uniform(0.02, 0.2)))
        at = r.randrange(max(1, len(w) - n))
        rows.append((top + k, " ".join([*w[:at], *(f"new{r.randrange(10**6)}" for _ in range(n)), *w[at + n :]]), "en", "s", 1))
    rows += [(rows[5][0], "another text under a known id, long enough to have shingles", "en", "s", 2), rows[7], (None, "x", "en", "s", 1), (top + 90, None, "en", None, None), (top + 91, "", "en", "s", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((x.doc_id, x.text or "") for x in corpus_pipeline.near_copies_out(spark, frame, SF).collect() if x.doc_id is not None)
    judged = [x for x in rows if x[0] is not None]
    sets = [_shingles(x[1] or "") for x in judged]
    root = list(range(len(judged)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(judged)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= 0.8 * union:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(judged)):
        groups.setdefault(find(i), []).append(judged[i])
    assert len(got) == len(groups) < len(judged) - 20
    for members in groups.values():
        least = min(m[0] for m in members)
        assert sum((m[0], m[1] or "") in got for m in {(m[0], m[1]) for m in members}) == 1 and any((least, m[1] or "") in got for m in members if m[0] == least)


def test_pipeline_private_against_plain(spark):
    docs = common.table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    field = pii.train(docs)
    got = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.private_out(spark, docs, SF).collect()}
    for x in docs.collect():
        out, at = "", 0
        for a, k, b in sorted(pii.all_spans(field, x.text)):
            if a >= at:
                out += x.text[at:a] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, b)
        out += x.text[at:]
        assert got[x.doc_id] == (out, len(out))


def test_pipeline_filters_by_their_scores(spark):
    docs = common.table(spark, SF, "documents").select(*corpus_pipeline.COLUMNS)
    labels = common.table(spark, SF, "labels")
    toxic = toxicity.train(docs, labels, common.remainder("label_id", 3) == 1)
    m = toxicity.Matcher(toxic.weights, toxic.edits)
    trees = quality.train(docs, labels, common.remainder("label_id", 5) == 0)
    clean, good = set(), set()
    for x in docs.collect():
        if toxic.score(np.array([m.features(x.text)]))[0] < toxicity.THRESHOLD:
            clean.add(x.doc_id)
        if trees.score(np.array([quality.statistics(x.text)]))[0] >= quality.THRESHOLD:
            good.add(x.doc_id)
    assert {x.doc_id for x in corpus_pipeline.toxic_out(spark, docs, SF).collect()} == clean
    assert {x.doc_id for x in corpus_pipeline.quality_in(spark, docs, SF).collect()} == good


def test_secrets_of_any_length(spark):
    """Keys of 32 to 128 hex digits are found whole, with and without quotes; precision and recall by kind on examples that didn't train."""
    field = pii.train(spark.read.parquet(f"{SF}/documents.parquet"))
    draw = random.Random(5)
    for n in (32, 40, 64, 128):
        for form, least in (('token = "{}" x', 20), ("key: {}", 20), ("secret={} and", 20), ('token = "{}"###', 20), ("{}", 16)):
            hits = 0
            for _ in range(20):
                key = "".join(draw.choice("0123456789abcdef") for _ in range(n))
                text = form.format(key)
                at = text.index(key)
                hits += (at, pii.KINDS.index("secret"), at + n) in pii.all_spans(field, text)
            assert hits >= least, (n, form, hits)
    for kind in range(len(pii.KINDS)):
        hit = wrong = lost = 0
        for text, spans in pii.examples(300, seed=99):
            got, want = ({s for s in of if s[1] == kind} for of in (pii.all_spans(field, text), spans))
            hit, wrong, lost = hit + len(got & want), wrong + len(got - want), lost + len(want - got)
        assert hit / (hit + wrong) > 0.9 and hit / (hit + lost) > 0.9, pii.KINDS[kind]


def test_a_lost_made_span_is_an_error():
    x = pii.Lattice("ab12cd34ef56 x", 0, 14)
    assert pii.gold_of(x, [(0, 4, 12)]) == [(0, 1, 4)] and pii.gold_of(x, [(2, 4, 12)]) is None
