"""Word breaking for the index and for queries, alike: plain runs of letters and digits, or a dictionary.

With a dictionary a text is cut along its best path: of all ways to cut a run into words of the dictionary and single characters,
the one of the greatest product of relative frequencies, found from the end of the run by dynamic programming over the words that
a trie finds at each place. A word list is small beside a corpus: it is read once, its size is checked, and it goes to the tasks
with the plan.

Defined cases: a null or empty text has no words; a character outside the dictionary has frequency 1; of two best paths the one
of the longer word is taken, from the left; letters and digits of alphabets stay together where the path leaves them single; a word
without letter or digit is none; stop words are none; texts are in normal form C, and only A-Z are lowered.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexarium.functions import reading
from lexarium.functions.text import LOWER, UPPER
from lexarium.operators.index import LINE
from lexarium.sources import shared

Word = tuple[str, int, int]
_LOW = str.maketrans(UPPER, LOWER)
_WORD = re.compile(r"[^\W_]+")
#: Letters that are words by themselves: Han, kana, Hangul syllables. What is between others stays together.
_ALONE = re.compile("[々-〇぀-ヿ㐀-䶿一-鿿가-힣豈-﫿\U00020000-\U0003ffff]")
#: Words of a list at most, which is what may be sent to every task.
WORDS = 2_000_000
#: Characters of texts that are read at once.
CHARACTERS = 1 << 20


def normal(text: str | None) -> str:
    """Normal form C, A-Z lowered."""
    return unicodedata.normalize("NFC", text or "").translate(_LOW)


def plain_words(text: str) -> list[Word]:
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(text)]


#: Weights are whole numbers, so that paths of the same words weigh the same in any order.
_SCALE = 1e9


class Dictionary:
    """Words with frequencies as a trie, and the best path of a run."""

    def __init__(self, words: Iterable[tuple[str, int | None]]):
        self.trie: dict = {}
        self.known: dict[str, int] = {}
        total = 0
        for word, frequency in words:
            word, n = normal(word), max(1, frequency or 1)
            total += n - self.known.get(word, 0)
            self.known[word] = n
        self.total = math.log(max(total, 1))
        for word, n in self.known.items():
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = round(_SCALE * (math.log(n) - self.total))
        self.lone = round(-_SCALE * self.total)

    def frequency(self, word: str) -> int:
        """0 for a word that isn't known."""
        return self.known.get(word, 0)

    def words_at(self, run: str, at: int) -> Iterator[tuple[int, int]]:
        """(end, log of relative frequency) of the words that begin there; the single character always."""
        node, end = self.trie.get(run[at], {}), at + 1
        yield end, node.get("", self.lone)
        while end < len(run) and run[end] in node:
            node = node[run[end]]
            end += 1
            if "" in node:
                yield end, node[""]

    def path(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of the words of the best path."""
        value, until = [0] * (len(run) + 1), [0] * len(run)
        for at in range(len(run) - 1, -1, -1):
            value[at], until[at] = max((weight + value[end], end) for end, weight in self.words_at(run, at))
        out, at = [], 0
        while at < len(run):
            out.append((at, until[at]))
            at = until[at]
        return out

    def cut(self, run: str) -> list[tuple[int, int]]:
        """The best path, with neighbours that it leaves single put together where their letters don't stand alone."""
        out: list[tuple[int, int]] = []
        joins = False
        for a, b in self.path(run):
            single = b - a == 1 and not _ALONE.match(run[a])
            if single and joins:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            joins = single
        return out

    def within(self, word: str) -> Iterator[tuple[int, int]]:
        """Two- and three-character words inside a longer word."""
        for n in (2, 3):
            if len(word) > n:
                yield from ((k, k + n) for k in range(len(word) - n + 1) if word[k : k + n] in self.known)


@dataclass(frozen=True)
class Analysis:
    """How texts become words. index and query get a text in normal form; by_character: places are first characters, as words of
    the index may overlap, in place of numbers. within: how far apart the ranking takes words as near, in places."""

    index: Callable[[str], list[Word]] = plain_words
    query: Callable[[str], list[Word]] = plain_words
    by_character: bool = False
    within: int = 2
    fragment: Callable[[str], bool] = lambda w: len(w) == 1 and not w.isascii()


PLAIN = Analysis()


def with_dictionary(words: Iterable[tuple[str, int | None]], stop: Iterable[str] = (), rare: int = 20_000) -> Analysis:
    """Best paths over a dictionary; in the index with the words inside words. A single character is a fragment unless it is a word
    of at least that frequency."""
    own, none = Dictionary(words), frozenset(map(normal, stop))

    def pieces(text: str) -> Iterator[tuple[int, int]]:
        for m in _WORD.finditer(text):
            yield from ((m.start() + a, m.start() + b) for a, b in own.cut(m[0]))

    def query(text: str) -> list[Word]:
        return [(text[a:b], a, b) for a, b in pieces(text) if text[a:b] not in none]

    def index(text: str) -> list[Word]:
        out = []
        for a, b in pieces(text):
            out += [(text[a + x : a + y], a + x, a + y) for x, y in own.within(text[a:b])] + [(text[a:b], a, b)]
        return [w for w in out if w[0] not in none]

    return Analysis(index, query, True, 12, lambda w: len(w) == 1 and own.frequency(w) < rare)


def listed_words(listed: DataFrame) -> list[tuple[str, int | None]]:
    """The rows of a word list (word, frequency). An error for a list of over WORDS words, which tasks can't be sent."""
    rows = listed.select("word", "frequency").limit(WORDS + 1).collect()
    if len(rows) > WORDS:
        raise ValueError(f"a word list has at most {WORDS} words")
    return [(r.word, r.frequency) for r in sorted(rows)]


def dictionary_of(listed: DataFrame) -> Dictionary:
    return Dictionary(listed_words(listed))


def from_word_list(listed: DataFrame, stop: Iterable[str] = (), more: Iterable[tuple[str, int]] = ()) -> Analysis:
    """with_dictionary() of a word list and more words."""
    return with_dictionary([*listed_words(listed), *more], stop)


def places_of(text: str | None, analysis: Analysis) -> dict[str, list[int]]:
    """Each word's places in a text, in order: a line times LINE plus its number or its first character in the line."""
    out: dict[str, list[int]] = {}
    for line, part in enumerate(normal(text).split("\n")):
        for k, (word, start, _) in enumerate(analysis.index(part)):
            place = line * LINE + (start if analysis.by_character else k)
            own = out.setdefault(word, [])
            if not own or own[-1] != place:
                own.append(place)
    return out


def plain_postings(texts: list[str], reader: reading.Reader) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in normal form: words, the numbers of their texts, and how many places each has there; and the places, one row after the other."""
    read = reader.read(texts)
    words, _, _, group, hidden = read.distinct()
    group[hidden] = len(words) - len(hidden) + np.arange(len(hidden))
    if len(hidden):  # words of one hash: told apart by themselves
        encoded = words.dictionary_encode()
        words, group = encoded.dictionary, encoded.indices.to_numpy()[group]
    line, k = read.places()
    key = read.text() * len(words) + group
    order = np.argsort(key, kind="stable")
    row, each = np.unique(key[order], return_counts=True)
    return words.take(pa.array(row % max(1, len(words)))), row // max(1, len(words)), each, (line.astype(np.int64) * LINE + k)[order]


def postings(docs: DataFrame, analysis: Analysis = PLAIN) -> DataFrame:
    """term, doc_id, tf, positions of docs (doc_id, text): made where a text lies, a row for each word of a text."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reading.Reader()
        for b in batches:
            texts = [normal(t) for t in b.column("text").to_pylist()]
            for begin, end in reading.slices(texts, CHARACTERS):
                terms, of, each, places = plain_postings(texts[begin:end], reader)
                ends = np.concatenate([[0], np.cumsum(each)]).astype(np.int32)
                ids = b.column("doc_id").take(pa.array(of + begin))
                yield pa.RecordBatch.from_arrays([terms, ids, pa.array(each.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(places))], ["term", "doc_id", "tf", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):  # texts are long: small batches
                part = b.slice(k, 64)
                terms, ids, places = [], [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    own = places_of(text, analysis)
                    terms += own
                    ids += [doc_id] * len(own)
                    places += own.values()
                ends = np.cumsum([0, *map(len, places)], dtype=np.int32)
                flat = np.fromiter((p for own in places for p in own), dtype=np.int64, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ids, b.schema.field("doc_id").type), pa.array(np.diff(ends).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["term", "doc_id", "tf", "positions"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return shared.spread(docs.select("doc_id", "text")).mapInArrow(plain if analysis is PLAIN else run, f"term string, doc_id {kind}, tf long, positions array<long>")


def lengths(docs: DataFrame, analysis: Analysis = PLAIN) -> DataFrame:
    """doc_id, length of the texts that have words: counted in the texts, without their postings."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [unicodedata.normalize("NFC", t or "") for t in b.column("text").to_pylist()]
            n = [reading.starts(texts[begin:end]) for begin, end in reading.slices(texts, CHARACTERS)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate([*n, np.zeros(0, np.int64)]).astype(np.int64))], ["doc_id", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(map(len, places_of(t, analysis).values())) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "length"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return shared.spread(docs.select("doc_id", "text")).mapInArrow(plain if analysis is PLAIN else run, f"doc_id {kind}, length long").where("length > 0")
