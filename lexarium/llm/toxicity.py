"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows.

The lexicon is learned: terms that are far more frequent in toxic than in clean training texts, with their log odds. A
trie of the terms is walked by Levenshtein automata, one lazily built deterministic automaton for all of them: a state
holds (trie node, edits) pairs, and each (state, character) step is worked out once. Misspellings of a term count only
if no clean training text has a word that near to it, so terms with common neighbours match exactly.

Each hit is weighed by a window of words around it: words of reporting, quotation marks around the hit or one that is
open in the window (and line) make it a quotation, words of address make it abuse. A logistic model over the weighed hits of a whole text gives the score; it
is fitted, like the lexicon, on at most `sample` labelled rows (a documented bound; every row is scored in whole).

Defined cases: a null or empty text has no hits and the score of such texts; null labels or ids don't train; without
toxic labels only the SEEDS are known; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.llm import common
from lexarium.llm.quality import labelled_sample

SAMPLE = 20_000
THRESHOLD = 0.7
#: Terms of the lexicon at most, the least log odds, and the least toxic texts of a term: the model's size. Those of the strongest
#: evidence stay; the sample's words are the only ones there are to choose from.
TERMS, ODDS, LEAST = 4000, 2.0, 3
WINDOW = 6
#: Words that a worker keeps, and (trie node, edits) pairs of its automaton's states: beyond them both are dropped and made anew.
CACHE_WORDS, PAIRS = 300_000, 300_000
#: Insults known before any label is seen, words of reporting, and words of address.
SEEDS = "bastard bitch clown coward cretin disgusting dumb fool idiot imbecile jerk loser lunatic moron parasite pathetic pig rat scum stupid trash vermin worthless".split()
REPORTING = frozenset("called calling quote quoted quotes quoting said says saying term word words phrase wrote written citing cited".split())
ADDRESS = frozenset("you your yours yourself youre u ur".split())
WORD = re.compile(r"\w+")
QUOTES = "\"'“”‘’«»`"


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie and made deterministic as words ask for it.

    Terms that allow no edit are looked up. States are made as they are met and are bounded by PAIRS, so memory doesn't grow with the words."""

    def __init__(self, terms: dict[str, int]) -> None:
        """terms: with the edits that each allows."""
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, str] = {}
        self.limit = [0]  # the most edits that a term under the node allows
        self.parent = [-1]
        self.longest = max((len(t) + e for t, e in terms.items() if e), default=0)
        self.exact = {t for t, edits in terms.items() if not edits}
        for t, edits in terms.items():
            if not edits:
                continue
            node = 0
            self.limit[0] = max(self.limit[0], edits)
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.limit.append(0)
                    self.parent.append(node)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], edits)
            self.term[node] = t
        self.edits = terms
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.pairs = 0
        self.start = self._state({0: 0})

    def _closed(self, least: dict[int, int]) -> dict[int, int]:
        """With the pairs that deletions add: a term's character is left out."""
        least, todo = dict(least), list(least)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = least[node] + 1
                if e <= self.limit[child] and e < least.get(child, 99):
                    least[child] = e
                    todo.append(child)
        return least

    def _state(self, least: dict[int, int]) -> int:
        """A state keeps the pairs before deletions, without those that a deletion below their parent gives anyway."""
        key = frozenset((n, e) for n, e in least.items() if least.get(self.parent[n], 99) >= e)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.pairs += len(key) + 4
            ends = [(e, self.term[n]) for n, e in self._closed(least).items() if n in self.term and e <= self.edits[self.term[n]]]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}
        for node, e in self._closed(dict(self.sets[state])).items():
            if e + 1 <= self.limit[node] and e + 1 < least.get(node, 99):  # c is inserted
                least[node] = e + 1
            for x, child in self.children[node].items():
                after = e + (x != c)
                if after <= self.limit[child] and after < least.get(child, 99):
                    least[child] = after
        self.steps[state][c] = to = self._state(least) if least else -1
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its edits (ties: the first by spelling), or None. Past PAIRS the states met so far are dropped."""
        if word in self.exact:
            return word, 0
        if self.pairs > PAIRS:
            self._forget()
        if len(word) > self.longest:
            return None
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
        return self.accepts[state]


@dataclass
class Model:
    weights: dict[str, float]
    edits: dict[str, int]
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.beta[0] + ((x - self.mean) / self.scale) @ self.beta[1:])))


def opened(before: str) -> bool:
    """Whether a quotation mark of these words (those of the window, of the last line) is still open. “ opens after a blank and closes elsewhere, as after „."""
    deep, last = False, " "
    for c in before.rpartition("\n")[2]:
        if c in "„«" or (c == "“" and not deep and (last.isspace() or last in "([")):
            deep = True
        elif c in "“”»":
            deep = False
        last = c
    return deep


class Matcher:
    """Hits of the lexicon in whole texts. Words met before are kept, up to CACHE_WORDS with hits and without; then they are matched anew."""

    def __init__(self, weights: dict[str, float], edits: dict[str, int]) -> None:
        self.weights, self.automaton = weights, Automaton(edits)
        self.none: set[str] = set()
        self.some: dict[str, float] = {}

    def hits(self, words: list[str]) -> dict[str, float]:
        distinct = set(words)
        if len(self.none) + len(self.some) > CACHE_WORDS:
            self.none.clear()
            self.some.clear()
        out = {}
        for w in sorted(distinct - self.none):
            if w not in self.some:
                if (found := self.automaton.match(w)) is None:
                    self.none.add(w)
                    continue
                self.some[w] = self.weights[found[0]] * 0.8 ** found[1]
            out[w] = self.some[w]
        return out

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = WORD.findall(low)
        hits = self.hits(words)
        if not hits:
            return [0.0] * 7
        spans = list(WORD.finditer(low))
        abuse = quoted = addressed = top = 0.0
        seen = set()
        for k, w in enumerate(words):
            if (weight := hits.get(w)) is None:
                continue
            a, b = spans[k].span()
            around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
            marked = low[max(0, a - 1) : a] in QUOTES and low[b : b + 1] in QUOTES and a > 0 and b < len(low)
            if marked or opened(low[spans[max(0, k - 2 * WINDOW)].start() : a]) or not REPORTING.isdisjoint(words[max(0, k - WINDOW) : k]):
                quoted += weight
                continue
            abuse += weight
            top = max(top, weight)
            seen.add(w)
            addressed += not ADDRESS.isdisjoint(around)
        return [log1p(abuse), top, log1p(len(seen)), abuse / len(words), log1p(abuse * 100 / len(words)), log1p(quoted), log1p(addressed)]


@lru_cache(maxsize=1)
def _matcher(weights: tuple, edits: tuple) -> Matcher:
    return Matcher(dict(weights), dict(edits))


def matcher(weights: dict[str, float], edits: dict[str, int]) -> Matcher:
    """One a worker for each lexicon: the words it has met stay met from batch to batch."""
    return _matcher(tuple(weights.items()), tuple(edits.items()))


def _counted(texts: DataFrame) -> DataFrame:
    """word, toxic, clean: training texts that have the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                for w in set(WORD.findall(t.lower())):
                    counts.setdefault(w, [0, 0])[int(y)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], ["word", "toxic", "clean"])

    return texts.mapInArrow(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _near(words: DataFrame, edits: dict[str, int]) -> DataFrame:
    """term, n: clean training texts with a word that isn't the term but matches it; at most a row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = Automaton(edits)
        for b in batches:
            out: dict[str, int] = {}
            for w, n in zip(b.column("word").to_pylist(), b.column("clean").to_pylist(), strict=True):
                if (found := a.match(w)) is not None and found[1]:
                    out[found[0]] = out.get(found[0], 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["term", "n"])

    # in order, words that share a beginning share the states that are at hand
    return words.where("clean > 0").select("word", "clean").sortWithinPartitions("word").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, scale and coefficients (the constant first) by Newton steps."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale = np.where(scale < 1e-6, 1.0, scale)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta, penalty = np.zeros(z.shape[1]), np.diag([0.01, *[ridge] * x.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(z @ beta)))
        step = np.linalg.solve(z.T * (p * (1 - p)) @ z + penalty, z.T @ (y - p) - penalty @ beta)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def train(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> Model:
    """held_out is of label_id."""
    texts = common.staged(labelled_sample(docs, labels, "toxic", held_out, sample))
    words = common.staged(_counted(texts))
    n = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1.0, 0), n.get(0.0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    found = words.where((F.col("toxic") >= LEAST) & (F.length("word") >= 3)).select("word", "toxic", odds.alias("odds")).where(F.col("odds") >= ODDS)
    terms = found.orderBy((F.col("odds") * F.log1p("toxic")).desc(), "word").limit(TERMS).collect()  # at most TERMS rows
    typical = log((0.5 * n1 + 1) / (n1 + 1)) - log(0.5 / (n0 + 1))
    weights = {s: max(ODDS, typical) for s in SEEDS} | {r.word: r.odds for r in terms}
    edits = {t: edits_allowed(t) for t in weights}
    common_near = {r.term: r.n for r in _near(words, edits).collect()}  # at most a row a term
    edits = {t: 0 if common_near.get(t, 0) > 0.0005 * n0 else e for t, e in edits.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(weights, edits)
        for b in batches:
            x = [own.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = texts.mapInArrow(run, "doc_id long, y double, x array<double>").toPandas().sort_values(["doc_id", "y"], kind="stable")
    x, y = np.array(rows.x.tolist(), dtype=float).reshape(-1, 7), rows.y.to_numpy(dtype=float)
    if n1 and n0:
        mean, scale, beta = fit_logistic(x, y)
    else:  # nothing to tell the two apart: hits alone decide
        mean, scale, beta = np.zeros(7), np.ones(7), np.array([-3.0, 2.0, 0, 0, 0, 0, -1.0, 0.5])
    return Model(weights, edits, mean, scale, beta)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matcher(model.weights, model.edits)
        for b in batches:
            x = np.array([own.features(t) for t in b.column("text").to_pylist()]).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return common.documents(docs).mapInArrow(run, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; rows whose crc32(doc_id) mod 3 is 1 don't train."""
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels, common.remainder("label_id", 3) == 1)
    return scored(docs, model).select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
